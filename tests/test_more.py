import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill import config
from lexmill.operators import chunking, matching, retrieval
from lexmill.sources import sinks


def plain_structured(blocks, most):
    out, open_, last = [], "", None

    def flush():
        nonlocal open_, last
        if open_.strip():
            out.append(open_.strip())
        open_, last = "", None

    for page, kind, text in sorted(blocks, key=lambda b: (b[0] is None, b[0] or 0)):
        if not text.strip():
            continue
        prefix = f"[strana {page}] " if page is not None and page != last else ""
        last = page if prefix else last
        mark = "\n## " if kind and ("heading" in kind or kind == "title") else "\n[TABULKA] " if kind and "table" in kind else "\n"
        piece = mark + prefix + text.strip()
        if open_ and len(open_) + len(piece) > most:
            flush()
        if len(piece) > most:
            out += [x for x in (piece[i : i + most].strip() for i in range(0, len(piece), most)) if x]
        else:
            open_ += piece
    flush()
    return out


def test_structured_chunks(spark):
    blocks = [(2, "table", "t" * 30), (None, None, "end"), (1, "heading", "Head"), (1, "p", "x" * 40), (1, None, "y" * 200), (3, "title", " "), (2, "p", "z" * 50), (2, "p", "w" * 10)]
    df = spark.createDataFrame([(blocks,)], "b array<struct<page:int,type:string,text:string>>")
    for most in (60, 90, 1000):
        assert df.select(chunking.structured_chunk_array(F.col("b"), most).alias("c")).first().c == plain_structured(blocks, most)
    pages = spark.createDataFrame([(list("abcde"),), ([],)], "p array<string>")
    assert [r.x for r in pages.select(chunking.page_batches(F.col("p"), 2).alias("x")).collect()] == [[["a", "b"], ["c", "d"], ["e"]], []]
    sizes = spark.createDataFrame([(4096, 400), (None, 1), (600, 100)], "c int, p int").select(chunking.chunk_size_for(F.col("c"), F.col("p"), 1200).alias("s"))
    assert [r.s for r in sizes.collect()] == [1200, 1200, 1024]


def test_config_and_labels():
    c = config.RunConfig(mode="SEARCH", concurrency=99)
    assert c.concurrency == 16 and config.RunConfig.from_json(c.to_json()) == c
    assert config.RunConfig.from_json("broken") == config.RunConfig() and config.RunConfig.from_json('{"mode": 3}').mode == "FAST"
    assert c.conflicts("FAST") == ["mode", "no_embedding_model"]
    assert c.missing("p", "", 0, "s") == ["model", "output", "documents"]
    assert config.native_endpoint("http://h:1/v1/", "/api/v0/models") == "http://h:1/api/v0/models" and config.endpoint("http://h/v1/", "models") == "http://h/v1/models"
    assert [config.human_eta(s) for s in (0, 42.4, 60, 75, 3720)] == ["—", "~42 s", "~1 min", "~1 min 15 s", "~1 h 2 min"]
    assert config.loaded_model([{"id": "a"}, {"id": "b", "state": "loaded"}], "x")["id"] == "b"
    assert [config.progress_health(*x) for x in ((False, 0, 0, 0), (True, 0, 5, 5), (True, 1, 50, 31), (True, 1, 50, 3), (False, 3, 9, 9))] == ["idle", "starting", "stuck", "ok", "finished"]


def test_logs_and_merged_text(spark, tmp_path):
    rows = spark.sql("select timestamp'2025-01-02 03:04:05.678' ts, 'INFO' level, 'a|b' file, 'ocr' phase, concat('x', chr(10), 'y') message, 12.6D duration_ms")
    sinks.append_log(rows, f"file://{tmp_path}/log")
    sinks.append_log(rows, f"file://{tmp_path}/log")
    got = [r.value for r in spark.read.text(f"file://{tmp_path}/log").collect()]
    assert sorted(got) == ["2025-01-02T03:04:05.678Z | INFO | a¦b | ocr | x y | 13"] * 2 + [sinks.LOG_HEADER]
    answers = spark.createDataFrame([(2, "two"), (1, "one")], "i int, a string")
    sinks.write_merged(answers, "i", "a", " do it ", str(tmp_path / "m.txt"))
    assert (tmp_path / "m.txt").read_text() == "Prompt:\n\ndo it\n\n=== Odpovědi podle souborů ===\n\none\n\n---\n\ntwo"
    paths = spark.createDataFrame([("/in/a/b.pdf",), ("/x/c.txt",)], "p string").select(sinks.mirrored_path(F.col("p"), "/in/").alias("p"))
    assert [r.p for r in paths.collect()] == ["a/b.pdf.lm.txt", "c.txt.lm.txt"]


def _fold_leaders(rows, threshold):
    """The sequential definition: (g, k) to (leader, hit)."""
    def cos(a, b):
        if not a or not b or len(a) != len(b):
            return -1.0
        norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / norms, 9) if norms else 0.0

    out = {}
    for g in {r[0] for r in rows}:
        found = []
        for _, k, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            best = max(((cos(v, w), -i) for i, (_, w) in enumerate(found)), default=(-2, 0))
            if best[0] >= threshold:
                out[g, k] = (found[-best[1]][0], True)
            else:
                found.append((k, v))
                out[g, k] = (k, False)
    return out


@pytest.mark.parametrize("settled", [retrieval.SETTLED, 20])
def test_leaders_over_many_rounds_equal_the_fold(spark, settled):
    gen = np.random.default_rng(9)
    mids = gen.normal(size=(30, 6))
    rows = [("one" if i % 3 else None, i, (mids[gen.integers(30)] + gen.normal(size=6) * 0.3).tolist()) for i in range(300)]
    rows += [("two", 500 + i, v) for i, v in enumerate([None, [], [1.0, 2.0], [2.0, 4.0], [0.0] * 6, [0.0] * 6, [1.0] * 6, None, [1.0], [3.0]])]
    df = spark.createDataFrame(rows, "label string, vec_id long, embedding array<double>").repartition(4)
    got = {(r.label, r.vec_id): (r.leader, r.hit) for r in retrieval.leaders(df, "label", "vec_id", "embedding", 0.8, settled).collect()}
    assert got == _fold_leaders(rows, 0.8)
    assert retrieval.leaders(df.limit(0), "label", "vec_id", "embedding", 0.8).collect() == []


def test_nearest_of_vectors_of_mixed_lengths(spark):
    rows = [(0, "a", [2.0]), (1, "a", [1.0, 0.0]), (2, "b", [0.0, 3.0]), (3, "b", None), (4, None, [1.0, 1.0]), (5, "a", []), (6, "a", [0.0, 0.0]), (7, "a", [4.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = retrieval.nearest_by_group(df, df.filter("vec_id in (0, 1, 3)"), "vec_id", "label", "embedding", 2)
    found = {(r.query, r.label, r["rank"]): (r.vec_id, r.score) for r in got.collect()}
    assert found[1, "a", 1] == (1, 1.0) and found[1, "a", 2] == (7, 1.0) and found[1, "b", 1] == (2, 0.0) and found[1, None, 1] == (4, round(0.5**0.5, 9))
    assert found[0, "a", 1] == (0, 1.0) and found[0, "b", 1] == (2, 0.0) and found[3, "a", 1] == (0, 0.0)


def _choose_in_turn(files):
    """The sequential definition over (folder, kind, path, stem, bytes)."""
    def score(a, b):
        words = lambda t: {w for w in re.split(r"[^\w]+|_", t) if w}
        common = len(words(a) & words(b))
        return 1000 if a == b else 900 if b.startswith(a) else 800 if a in b else 700 if b in a else 500 + 10 * common if common else None

    out = []
    for folder in {f[0] for f in files if f[0] is not None}:
        ins = [(p, s.lower()) for d, k, p, s, _ in files if d == folder and k == "in" and s is not None]
        outs = [(p, s.lower(), b) for d, k, p, s, b in files if d == folder and k == "out" and s is not None]
        wishes = {p: sorted((-v, -b, o, v) for o, t, b in outs if (v := score(s, t)) is not None) for p, s in ins}
        taken = set()
        for p in sorted((p for p in wishes if wishes[p]), key=lambda p: (wishes[p][0][0], p)):
            got = next(((o, v) for _, _, o, v in wishes[p] if o not in taken), None)
            if got:
                taken.add(got[0])
                out.append((folder, p, *got))
    return sorted(out)


@pytest.mark.parametrize("at_once", [matching.AT_ONCE, 13])
def test_matching_in_rounds_equals_choosing_in_turn(spark, at_once):
    rng = random.Random(12)
    names = ["Scan", "scan 1", "scan-1 final", "Report", "report 2024", "my report", "a", "ab", "zpráva o stavu", "zpráva", "x1y", "", "stav", None, "final report 2024"]
    files = [(rng.choice(["f", "g"]), rng.choice(["in", "out"]), f"p{i:03}", rng.choice(names), rng.randrange(5)) for i in range(160)]
    files += [("same", kind, f"{kind}{i:02}", "equal name", i % 3) for kind in ("in", "out") for i in range(30)] + [(None, "in", "q", "Scan", 1), ("lone", "in", "r", "Scan", 1)]
    df = spark.createDataFrame(files, "folder string, kind string, path string, stem string, bytes int")
    got = sorted(tuple(r) for r in matching.match_outputs(df, at_once=at_once).collect())
    assert got == _choose_in_turn(files) and sum(r[0] == "same" for r in got) == 30
    assert matching.match_outputs(df.filter("folder = 'lone'")).collect() == []


@pytest.mark.parametrize("at_once", [matching.AT_ONCE, 40])
def test_matching_of_names_with_many_words_in_common_equals_choosing_in_turn(spark, at_once):
    rng = random.Random(5)
    words = ["scan", "of", "the", "lab", "report", "x"]
    files = [(rng.choice(["f", "f", "g"]), rng.choice(["in", "out"]), f"p{i:03}", " ".join(rng.choices(words, k=rng.randrange(1, 6))), rng.randrange(40)) for i in range(260)]
    files += [("f", kind, f"{kind}{i:02}", "lab of the", i % 3) for kind in ("in", "out") for i in range(25)]
    df = spark.createDataFrame(files, "folder string, kind string, path string, stem string, bytes int")
    assert sorted(tuple(r) for r in matching.match_outputs(df, at_once=at_once).collect()) == _choose_in_turn(files)


def test_names_that_share_one_word_are_not_listed_as_pairs(spark, monkeypatch):
    files = [("f", kind, f"{kind}{i:03}", f"scan {kind}{i}", i % 7) for kind in ("in", "out") for i in range(300)]
    rows, written = [], matching.written

    def counted(df, name):
        out = written(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(matching, "written", counted)
    got = matching.match_outputs(spark.createDataFrame(files, "folder string, kind string, path string, stem string, bytes int"))
    assert sorted(tuple(r) for r in got.collect()) == _choose_in_turn(files)
    assert max(rows) < 300 * 300 / 2
