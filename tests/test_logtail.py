import os
import time

from lexmill.sources import logtail


def tail(spark, path, **options):
    return [r.line for r in logtail.read_tail(spark, str(path), **options).orderBy("path", "line_no").collect()]


def test_last_lines_of_a_range(spark, tmp_path):
    log = tmp_path / "run.log"
    log.write_text("".join(f"line {i}\n" for i in range(1000)), encoding="utf-8")
    assert tail(spark, log, lines=3) == ["line 998", "line 999", ""]
    assert len(tail(spark, log)) == 300
    # The range begins inside a line: the rest of it is the first line.
    assert tail(spark, log, window=13) == ["998", "line 999", ""]
    assert tail(spark, tmp_path / "missing.log") == []
    (tmp_path / "empty.log").write_bytes(b"")
    assert tail(spark, tmp_path / "empty.log") == [""]


def test_a_range_that_begins_inside_a_character_is_empty(spark, tmp_path):
    log = tmp_path / "run.log"
    log.write_bytes("první\nčára\n".encode())
    whole = len("první\nčára\n".encode())
    assert tail(spark, log, window=whole) == ["první", "čára", ""]
    cut = whole - len("první\nč".encode()) + 1
    assert tail(spark, log, window=cut) == [] and tail(spark, log, window=cut + 1) == ["čára", ""]


def test_a_very_large_file_is_read_at_its_end_only(spark, tmp_path):
    log = tmp_path / "large.log"
    with open(log, "wb") as f:
        f.truncate(3 << 30)
        f.seek(0, os.SEEK_END)
        f.write(b"\n" + b"".join(b"event %06d\n" % i for i in range(40_000)))
    reader = logtail.TailReader(str(log), logtail.WINDOW, 10)
    part = reader.partitions()[0]
    assert part.end - part.start == 256 * 1024
    began = time.time()
    assert tail(spark, log, lines=2) == ["event 039999", ""] and time.time() - began < 30


def test_a_folder_of_logs_has_a_range_for_each(spark, tmp_path):
    for name in ("a.log", "b.log", ".hidden", "_SUCCESS"):
        (tmp_path / name).write_text(f"{name}\nend")
    rows = logtail.read_tail(spark, f"file://{tmp_path}").orderBy("path", "line_no").collect()
    assert [(r.path.rsplit("/", 1)[1], r.line_no, r.line) for r in rows] == [("a.log", 1, "a.log"), ("a.log", 2, "end"), ("b.log", 1, "b.log"), ("b.log", 2, "end")]
