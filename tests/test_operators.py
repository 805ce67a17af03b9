import csv
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill.functions.jsonio import ARRAYS, STRINGS
from lexmill.operators import cache, chunking, cleaning, matching, models, modes, packing, profiles, results
from lexmill.sources import readers, sinks
from lexmill.streaming import incremental


@pytest.mark.parametrize(("size", "overlap"), [(1500, 250), (10, 3), (7, 0), (2, 1)])
def test_chunks_equal_the_loop(spark, size, overlap):
    def loop(t):
        out, at = [], 0
        while t:
            out.append(t[at : at + size])
            if at + size >= len(t):
                break
            at += size - overlap
        return out

    texts = ["", "é" * size, "abc" * 9, *("x" * n for n in range(40))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.c for r in df.select("i", chunking.chunk_array(F.col("text"), size, overlap).alias("c")).collect()}
    assert [got[i] for i in range(len(texts))] == [loop(t) for t in texts]


def test_smart_chunks_hold_all_paragraphs(spark):
    rng = random.Random(1)
    paras = ["p%d %s" % (i, "word " * rng.randint(1, 30)) for i in range(40)] + ["x" * 900]
    got = spark.createDataFrame([("\n\n".join(paras),)], "t string").select(chunking.smart_chunk_array(F.col("t"), 200, 40).alias("c")).first().c
    assert all(any(p.strip() in c for c in got) for p in paras[:-1]) and max(map(len, got)) <= 2 * 200 + 250


def test_cleaner_drops_repeated_headers_whatever_their_case(spark):
    pages = [["Nemocnice X Header\nbody one\nStrana 1", "NEMOCNICE X HEADER\nbody two\nStrana 2"]]
    df = spark.createDataFrame([(p,) for p in pages], "pages array<string>")
    assert cleaning.clean_pages(df).first().cleaned_text == "body one\n\nbody two"
    first = df.select(cleaning.preprocess(F.array_join("pages", "[[PAGE_BREAK]]"), True, True).alias("t")).first().t
    assert "body two" in first


def test_merge_fills_gaps_and_averages(spark):
    schema = "doc string, ord int, patient_name string, patient_id string, diagnoses array<string>, confidence double, warnings array<string>, raw_response string"
    rows = [("d", 2, "", "7", ["I10"], 0.6, ["w"], "b"), ("d", 1, "Jan", "", [], 0.8, [], "a")]
    got = results.merge(spark.createDataFrame(rows, schema), "doc", "ord").first()
    assert (got.patient_name, got.patient_id, got.diagnoses, got.warnings, got.raw_response) == ("Jan", "7", ["I10"], ["w"], "a\n---\nb")
    assert abs(got.confidence - 0.7) < 1e-12


@pytest.mark.parametrize("block_rows", [packing.BLOCK_ROWS, 40, 1])
def test_packing_keeps_order_and_budget(spark, block_rows):
    rng = random.Random(4)
    sizes = {(r, i): rng.choice([0, 3, 80, 300, 500, 1200]) for r in ("a", "b", "c", None) for i in range(1 if r == "c" else 130)}
    df = spark.createDataFrame([(r, i, n) for (r, i), n in sizes.items()], "run string, id int, n int").repartition(5)
    got = packing.pack(df, "run", "id", F.col("n"), 1000, block_rows).collect()
    assert len(got) == len(sizes)
    for run in ("a", "b", "c", None):
        batch, used, n = 1, 0, 0
        for row in sorted((r for r in got if r.run == run), key=lambda r: r.id):
            cost = sizes[run, row.id] + packing.OVERHEAD
            if used + cost > 1000 and n:
                batch, used, n = batch + 1, 0, 0
            used, n = used + cost, n + 1
            assert (row.batch, row.place) == (batch, n)


def test_packing_one_run_of_a_million_rows(spark):
    """One run over all tasks and many blocks, against the fold."""
    n, budget = 1_000_000, 20_000
    size = F.pmod(F.xxhash64("id"), F.lit(3000)) + F.when(F.col("id") % 997 == 0, 30_000).otherwise(0)
    rows = spark.range(n).select(F.lit("all").alias("run"), F.col("id"), size.alias("n"))
    got = packing.pack(rows, "run", "id", F.col("n"), budget).toPandas().sort_values("id")
    batch, used, place, want = 1, 0, 0, []
    for cost in (rows.select("id", "n").toPandas().sort_values("id").n + packing.OVERHEAD).tolist():
        if place and used + cost > budget:
            batch, used, place = batch + 1, 0, 0
        used, place = used + cost, place + 1
        want.append((batch, place))
    assert list(zip(got.batch.tolist(), got.place.tolist(), strict=True)) == want


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None), ("a", 1, None), ("a", 1, 900), ("a", None, 900)], "run string, id int, n int")
    got = sorted((str(r.run), r.batch, r.place) for r in packing.pack(df, "run", "id", F.col("n"), 1000).collect())
    assert got == [("None", 1, 1), ("a", 1, 1), ("a", 2, 1), ("a", 2, 2)] or got == [("None", 1, 1), ("a", 1, 1), ("a", 2, 1), ("a", 3, 1)] or got == [("None", 1, 1), ("a", 1, 1), ("a", 1, 2), ("a", 2, 1)]
    assert packing.pack(df.limit(0), "run", "id", F.col("n"), 1000).collect() == []
    assert [r.batch for r in packing.pack(df.filter("id = 1"), "run", "id", F.col("n"), 10).collect()] in ([1, 2], [2, 1])


def test_cache_round(spark, tmp_path):
    schema = "key string, response string, created_at timestamp"
    path = f"file://{tmp_path}/cache"
    seen = []

    def compute(rows):
        seen.append(rows.count())
        return rows.withColumn("response", F.when(F.col("key") == "none", F.lit("")).otherwise(F.upper("key")))

    asked = spark.createDataFrame([("a",), ("b",), ("a",), ("none",)], "key string")
    answers, fresh = cache.fill(asked, cache.read(spark, path, schema), compute)
    assert sorted(r.response for r in answers.collect()) == ["", "A", "A", "B"]
    fresh.write.parquet(path)
    stored = cache.read(spark, path, schema)
    assert {r.key for r in stored.collect()} == {"a", "b"}
    cache.fill(asked, stored, compute)[0].collect()
    assert seen == [3, 1]
    assert {r.hit for r in cache.lookup(asked, stored, bypass=True).collect()} == {False}


def test_modes_decode_and_keep_errors(spark):
    def failing():
        def chat(system, user):
            if "bad" in user:
                raise RuntimeError("down")
            return models.echo_chat(system, user) if "json" in user else "prose"

        return chat

    docs = spark.createDataFrame([(1, "f/a.pdf", "json text", "f"), (2, "f/b.pdf", "bad", "f"), (3, "f/c.pdf", "plain", "f")], "id int, path string, text string, run string")
    got = {r.id: r for r in modes.fast(docs, "id", "path", "text", "prompt", failing).collect()}
    assert (got[1].patient_name, got[1].source_file, got[1].confidence) == ("chars 9", "f/a.pdf", 0.5)
    assert got[2].warnings == ["down"] and got[3].raw_response == "prose" and got[3].confidence == 0.0
    assert {r.id for r in modes.search(docs, "id", "path", "text", "the prompt").collect()} == {1, 2, 3}
    whole = modes.consolidated(docs, "run", "id", "path", "text", "prompt", context=1024).collect()
    assert [(r.source_file, r.n_docs) for r in whole] == [("Consolidated (3 dokumentů)", 3)]


def test_model_helpers():
    long = "x" * 3000
    small = lambda s, u: "too big: context length" if len(u) > 1200 else "ok"
    assert set(models.split_on_overflow(small, "", "p", long).split("\n\n")) == {"ok"}
    assert models.shrinking(small, "", "p", long, 1000) is None
    tries, waits = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return "done"

    assert models.retried(flaky, sleep=waits.append) == "done" and waits == [1.0, 3.0]
    assert models.folded_events(['data: {"choices":[{"delta":{"content":"a"}}]}', ": x", 'data: {"choices":[{"delta":{"content":"b"}}]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"c"}}]}']) == "ab"


def test_matching(spark):
    rows = [("f", "in", "a.pdf", "a", 0), ("f", "in", "ab.pdf", "ab", 0), ("f", "out", "ab.json", "ab", 5), ("f", "out", "a_x.json", "a_x", 9), ("f", "out", "zz.json", "zz", 1)]
    got = matching.match_outputs(spark.createDataFrame(rows, "folder string, kind string, path string, stem string, bytes int")).collect()
    assert {(r.input, r.output, r.score) for r in got} == {("ab.pdf", "ab.json", 1000), ("a.pdf", "a_x.json", 900)}


def test_profiles(spark):
    df = spark.createDataFrame([("META-Llama",), ("other",)], "m string")
    assert [(r.profile, r.chunk_size) for r in profiles.chunk_profile(df, "m").collect()] == [("llama", 900), ("default", 1000)]
    assert profiles.manifest_mismatches({"chunk_size": 1}, 2, 3, "e", 4, "c", "p")[0] == "profile"


def results_frame(spark):
    rows = [{**dict.fromkeys(STRINGS, "v"), "source_file": f"in/{n}.pdf", **{a: ['q"', "x"] for a in ARRAYS}, "confidence": 0.5, "raw_response": "r"} for n in ("B", "b", "a")]
    schema = ", ".join([*(f"{n} string" for n in STRINGS), *(f"{n} array<string>" for n in ARRAYS), "confidence double, raw_response string"])
    return spark.createDataFrame(rows, schema)


def test_exports(spark, tmp_path):
    sinks.export_all(results_frame(spark), str(tmp_path))
    raw = (tmp_path / "results.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfsource_file,patient_name") and raw.endswith(b"\n") and b"\r" not in raw
    rows = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"))))
    assert len(rows) == 4 and rows[1][6] == 'q" | x' and rows[1][-1] == "0.5000"
    assert [x["source_file"] for x in json.loads((tmp_path / "results.json").read_text())] == ["in/B.pdf", "in/a.pdf", "in/b.pdf"]
    assert {p.name for p in (tmp_path / "documents").iterdir()} == {"B.json", "b_2.json", "a.json"}
    assert (tmp_path / "results.txt").read_text().count("-" * 45) == 3
    sinks.write_workbook(spark.createDataFrame([("a<", "x"), ("b", "x")], "k string, v string"), ("k", "v"), "k", str(tmp_path / "w.xlsx"))
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert b"a&lt;" in z.read("xl/sharedStrings.xml") and z.read("xl/worksheets/sheet1.xml").count(b"<row") == 3
    assert [sinks.column_letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_readers(spark, tmp_path):
    for name, body in {"a.txt": b"caf\xe9", "sub/b.html": "<b>é</b>".encode(), "c.docx": b"PK", ".hidden.txt": b"x", "log--1.txt": b"x", "p.md": b"# prompt"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in readers.text_files(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": "café", "b.html": "<b>é</b>", "c.docx": "", "p.md": "# prompt"}
    assert [r.title for r in readers.prompts(spark, f"file://{tmp_path}").collect()] == ["p"]
    (tmp_path / "x.PDF").write_bytes(b"one\x0ctwo")
    files = readers.binary_files(spark, f"file://{tmp_path}")
    assert files.count() == 1
    raw = spark.read.format("binaryFile").load(f"file://{tmp_path}/x.PDF")
    assert [(r.page, r.text) for r in readers.page_texts(raw, lambda b: b.decode().split("\x0c")).orderBy("page").collect()] == [(0, "one"), (1, "two")]
    assert readers.blocks('[{"text": "a", "page": "2"}, {"kids": [{"content": "b", "type": "heading"}, {"text": "a", "page": 2}]}]') == [(2, None, "a"), (None, "heading", "b")]


def test_stream_works_on_new_content_once(spark, tmp_path):
    schema = "key string, text string"
    source, store = f"file://{tmp_path}/in", f"file://{tmp_path}/out"

    def turn(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = incremental.process_new(incremental.parquet_stream(spark, source, schema), "key", lambda d: d.withColumn("text", F.upper("text")), store, schema, f"file://{tmp_path}/check")
        q.awaitTermination()
        return sorted((r.key, r.text) for r in spark.read.parquet(store).collect())

    assert turn([("a", "x"), ("b", "y"), ("a", "x")]) == [("a", "X"), ("b", "Y")]
    assert turn([("b", "y"), ("c", "z")]) == [("a", "X"), ("b", "Y"), ("c", "Z")]
