import os
import threading
import time

import pandas as pd

from lexmill.operators.memo import Memo

SCHEMA = "path string, width int, text string"


def extractor(folder, slow=0.0):
    """Leaves a file for each key that it is asked for."""

    def run(frames):
        for pdf in frames:
            for path, width in zip(pdf.path, pdf.width, strict=True):
                time.sleep(slow)
                open(os.path.join(folder, f"{path}-{width}-{time.time_ns()}"), "w").close()
            yield pd.DataFrame({"path": pdf.path, "width": pdf.width, "text": pdf.path + "!"})

    return lambda rows: rows.mapInPandas(run, SCHEMA)


def wanted(spark, names, width=1000):
    return spark.createDataFrame([(n, width) for n in names], "path string, width int")


def test_each_key_is_extracted_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    memo = Memo(spark, f"file://{tmp_path}/memo", SCHEMA, ["path", "width"], ranges=3)
    assert memo.read().collect() == []
    got = memo.fill(wanted(spark, ["a", "b", "a"]), extractor(str(seen)))
    assert sorted(r.text for r in got.collect()) == ["a!", "b!"] and len(os.listdir(seen)) == 2
    assert sorted(r.text for r in memo.fill(wanted(spark, ["b", "c"]), extractor(str(seen))).collect()) == ["b!", "c!"]
    assert len(os.listdir(seen)) == 3
    assert [r.width for r in memo.fill(wanted(spark, ["a"], 2000), extractor(str(seen))).collect()] == [2000]
    assert memo.read().count() == 4 and memo.fill(wanted(spark, ["a"]).limit(0), extractor(str(seen))).collect() == []


def test_two_runs_at_once_extract_each_key_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    names, found = [f"f{i}" for i in range(24)], []

    def work(mine):
        memo = Memo(spark, f"file://{tmp_path}/memo", SCHEMA, ["path", "width"], ranges=4)
        found.append(sorted(r.path for r in memo.fill(wanted(spark, mine), extractor(str(seen), 0.05)).collect()))

    threads = [threading.Thread(target=work, args=(names,)) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == [sorted(names)] * 2 and len(os.listdir(seen)) == 24


def test_a_claim_of_a_run_that_is_gone_is_taken_over(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    memo = Memo(spark, f"file://{tmp_path}/memo", SCHEMA, ["path", "width"], ranges=1, lease_s=1)
    (tmp_path / "memo" / "claims").mkdir(parents=True)
    (tmp_path / "memo" / "claims" / "0").touch()
    assert memo.fill(wanted(spark, ["a"]), extractor(str(seen))).count() == 1


def test_a_failed_extraction_leaves_no_claim_and_no_rows(spark, tmp_path):
    memo = Memo(spark, f"file://{tmp_path}/memo", SCHEMA, ["path", "width"], ranges=1)

    def broken(rows):
        raise RuntimeError("no extractor")

    for _ in range(2):
        try:
            memo.fill(wanted(spark, ["a"]), broken)
        except RuntimeError as e:
            assert str(e) == "no extractor"
    assert memo.read().collect() == []
