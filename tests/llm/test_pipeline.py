"""The pipeline's rows against a plain Python version of its first three stages, and the invariants of the others."""

import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

from lexmill.llm import pii, simhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    rng = random.Random(11)
    words = ["stone", "river", "Light", "paper", "garden", "window", "summer", "north", "music", "silver", "carpet", "engine", "bridge", "letter", "mountain", "é"]
    rows = []
    for i in range(60):
        text = ". ".join(" ".join(rng.choice(words) + str(rng.randrange(50)) * (rng.random() < 0.3) for _ in range(9)) for _ in range(12))
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    rows += [(100 + i, rows[i][1], "en", "src9", 1) for i in range(5)]
    rows += [(200, rows[7][1] + " mail me: jo@ex.com", "en", None, 1), (201, "too short", "en", "src0", 9), (202, None, None, None, None), (203, "same again " * 60, "en", "src1", 1), (204, "LOUD WORDS HERE!! " * 30, "en", "src1", 1)]
    return rows


def test_stages_follow_each_other(spark, tmp_path):
    rows = made()
    path = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        kept.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {i: t for i, t, *_ in rows if i not in (201, 202, 203, 204)}
    assert {r.doc_id for r in kept[0]} == set(good)
    prints = {i: simhash.fingerprint(t.encode()) for i, t in good.items()}
    near = lambda a, b: bin((prints[a] ^ prints[b]) % 2**64).count("1") <= 2
    group = {}
    for i in sorted(good):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for j in good:
                if j not in seen and near(x, j):
                    seen.add(j)
                    todo.append(j)
        group[i] = min(seen)
    assert {r.doc_id for r in kept[1]} == set(group.values())
    assert {(r.doc_id, r.text) for r in kept[2]} == {(i, pii.masked(good[i])) for i in set(group.values())}
    assert all(r.n_chars == len(r.text) for r in kept[2])
    mixed = {(r.doc_id, r.text) for r in kept[3]}
    assert mixed <= {(r.doc_id, r.text) for r in kept[2]} and len(kept[3]) > 20
    # The tokens are in training order, which is not that of a table read anew: its files come by size.
    order = [(r.doc_id, r.text) for name in sorted(os.listdir(f"{path}/mixing")) if name.endswith(".parquet") for r in pq.read_table(f"{path}/mixing/{name}").to_pylist() for r in [Row(**r)]]
    assert sorted(order) == sorted((r.doc_id, r.text) for r in kept[3])
    assert [(r.doc_id, r.text) for r in sorted(kept[4], key=lambda r: r.position)] == order
    assert [r.position for r in kept[4]] == list(range(len(order)))
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in kept[4])


@pytest.mark.skipif(not os.path.exists(corpus_pipeline.MODEL_PATH), reason="needs the public model file")
def test_run_gives_the_last_stage(spark, tmp_path):
    spark.createDataFrame(made(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[-3:] == ["ids", "n_tokens", "round_trip"]
