import math
import random

import pytest

from lexmill.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    while free:
        left = total - sum(target[s] for s in sizes if s not in free)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        for s in free:
            target[s] = most * sizes[s] if s in over else share[s]
        if not over:
            break
        free -= over
    return target


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(400):
        source = rng.choice(["b", "b", "b", "a", "Z", "é", "src10", "src9", None])
        out.append((i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 200))), source, "x"))
    return out + [(None, None, "b", "x"), (7, "one\x0btwo three", "only", "x"), (7, "one\x0btwo three", "only", "x")]


SCHEMA = "doc_id long, text string, source string, size string"


def test_targets_and_taken_words(spark, rows):
    got = mixing.assign(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        assert (r.position is None) == (r.taken == 0)
        assert r.position is None or 0 <= r.position <= 1
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert math.isclose(sum(want.values()), sum(sizes.values()))


def test_reruns_agree_whatever_the_partitions(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(repr, mixing.assign(docs.repartition(7)).select("doc_id", "taken", "position").collect()))
    two = sorted(map(repr, mixing.assign(docs.coalesce(1)).select("doc_id", "taken", "position").collect()))
    assert one == two


@pytest.mark.parametrize("knots", [*mixing.SCHEDULES, (0.0, 1.0), (2.0, 0.0), (1.0, 3.0, 0.0, 2.0)])
def test_inverse_demand_inverts_the_integral(spark, knots):
    from pyspark.sql import functions as F

    def integral(t):
        steps = 20000
        return sum(at(t * (i + 0.5) / steps) for i in range(steps)) * t / steps

    def at(t):
        x = t * (len(knots) - 1)
        k = min(int(x), len(knots) - 2)
        return knots[k] + (knots[k + 1] - knots[k]) * (x - k)

    qs = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    got = [r.t for r in spark.createDataFrame([(q,) for q in qs], "q double").select(mixing._inverse_demand(F.col("q"), knots).alias("t")).collect()]
    for q, t in zip(qs, got):
        assert abs(integral(t) - q * integral(1.0)) < 1e-3


def test_mix_repeats_whole_documents_in_order_of_position(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    texts = {(r[0], r[1]) for r in rows}
    got = mixed.collect()
    assert all((r.doc_id, r.text) in texts for r in got)
    assert max(sum(1 for r in got if r.doc_id == i) for i in range(400) if i != 7) <= 3
    assert {r.size for r in got} == {"x"}
    heavy = [i for i, r in enumerate(got) if r.source == "Z"]
    assert sum(heavy) / len(heavy) < len(got) / 2  # the heavy source leads


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.assign(empty).collect() == [] and mixing.mix(empty).collect() == []
    blank = mixing.assign(spark.createDataFrame([(1, None, "a", "x"), (2, " ", None, "x")], SCHEMA)).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in blank] == [(0, 0, 0.0, 0)] * 2
