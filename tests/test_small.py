"""Helpers that no other test reaches."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexmill.functions import jsonio, text
from lexmill.operators import cache, models, profiles
from lexmill.sources import readers, sinks


def test_documents_without_a_text_layer_go_to_ocr_as_a_whole(spark):
    schema = "doc string, page int, text string"
    layer = spark.createDataFrame([("a", 0, "text"), ("a", 1, ""), ("b", 0, " \n"), ("b", 1, None)], schema)
    ocr = spark.createDataFrame([(d, p, f"read {d}{p}") for d in "abc" for p in (0, 1)], schema)
    got = sorted((r.doc, r.page, r.text) for r in readers.text_layer_or_ocr(layer, ocr).collect())
    assert got == [("a", 0, "text"), ("a", 1, ""), *[(d, p, f"read {d}{p}") for d in "bc" for p in (0, 1)]]


def test_answers_mirror_their_inputs(spark, tmp_path):
    rows = spark.createDataFrame([("in/sub/a.pdf", "A"), ("in/b.txt", None), ("other/c.pdf", "C")], "path string, answer string")
    sinks.write_mirrored(rows, "path", "answer", "in", str(tmp_path))
    found = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {"sub/a.pdf.lm.txt": "A", "b.txt.lm.txt": "", "c.pdf.lm.txt": "C"}


def test_a_summary_is_a_file_of_its_own(tmp_path):
    at = datetime(2024, 3, 5, 7, 8, 9)
    assert sinks.write_summary(None, str(tmp_path / "out"), at) is None and not (tmp_path / "out").exists()
    path = sinks.write_summary("Prompt:\n\nč", str(tmp_path / "out"), at)
    assert path.endswith("/souhrn--20240305-070809--.txt") and open(path, encoding="utf-8").read() == "Prompt:\n\nč"
    assert len(list((tmp_path / "out").iterdir())) == 1


def test_context_errors(spark):
    said = ["Context length exceeded", *(f"x {p.replace(chr(92), '')} y" for p in text.OVERFLOW_PHRASES if p.replace(" ", "").isalpha()), "all is well", None]
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", text.is_context_overflow(F.col("t")).alias("over")).collect()
    assert [bool(r.over) for r in rows][1:] == [True] * (len(said) - 3) + [False, False]


def test_own_profiles_take_the_place_of_built_in_ones(spark):
    built = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    own = spark.createDataFrame([("b", 9, "x"), ("c", 3, "y")], "id string, n int, more string")
    assert sorted(tuple(r) for r in profiles.with_overrides(built, own).collect()) == [("a", 1, None), ("b", 9, "x"), ("c", 3, "y")]


def test_context_length_is_found_in_what_an_object_holds():
    name, second = jsonio.CONTEXT_NAMES[:2]
    assert jsonio.context_length({"x": [{"y": {second: "4096"}}], "z": {name: 1}}) == 4096
    assert jsonio.context_length({second: 5, name: 7}) == 7 and jsonio.context_length([1, "a", {}]) is None


def test_older_retry_rules_reach_the_clients(monkeypatch):
    import io
    import urllib.error

    waits, tries = [], []
    attempts, _, rules = models.retried.__defaults__
    monkeypatch.setattr(models.retried, "__defaults__", (attempts, waits.append, rules))

    def fail(request, timeout):
        tries.append(timeout)
        raise urllib.error.HTTPError("u", 429, "busy", {"Retry-After": "7"}, io.BytesIO(b"later"))

    monkeypatch.setattr(models.urllib.request, "urlopen", fail)
    for client, arguments, rules in ((models.http_chat, ("s", "u"), models.OLDER_CHAT), (models.http_embedder, (["a"],), models.OLDER_EMBEDDING), (models.http_reranker, ("q", ["a"]), models.OLDER_STORE)):
        tries.clear()
        with pytest.raises(urllib.error.HTTPError):
            client("http://h", "m", timeout=5, retry=rules)(*arguments)
        assert tries == [60, 60, 60]
        with pytest.raises(urllib.error.HTTPError):
            client("http://h", "m", timeout=9999)(*arguments)
        assert tries[3:] == [3600]
    assert models.OLDER_CHAT.heeds_server and waits == [7.0, 7.0, 1.5, 3.0, 1.0, 2.0]


def test_rows_of_one_time_have_a_rule(spark):
    rows = [("k", "b", 1), ("k", "a", 1), ("k", "z", 0), ("l", None, 1)]
    store = spark.createDataFrame(rows, "key string, response string, created_at int")
    assert sorted((r.key, r.response) for r in cache.latest(store).collect()) == [("k", "b"), ("l", None)]


def test_collections_keep_their_manifest(spark, tmp_path):
    asked = {"profile": "p", "collection": "c", "size": 1000, "overlap": 120, "model": "m", "vector_size": 2}
    one = profiles.Collection(spark, f"file://{tmp_path}/c", **asked)
    assert one.manifest() is None and one.vectors().collect() == []
    one.upsert(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 1.0])], "key string, vector array<double>"))
    one.upsert(spark.createDataFrame([("a", [3.0, 4.0])], "key string, vector array<double>"))
    assert {r.key: r.vector for r in one.vectors().collect()} == {"a": [3.0, 4.0], "b": [0.0, 1.0]} and one.manifest()["chunk_size"] == 1000
    with pytest.raises(profiles.MismatchError, match="chunk_overlap"):
        profiles.Collection(spark, f"file://{tmp_path}/c", **asked | {"overlap": 9}).vectors()
    with pytest.raises(Exception, match="a vector of length 1"):
        one.upsert(spark.createDataFrame([("x", [1.0])], "key string, vector array<double>"))
