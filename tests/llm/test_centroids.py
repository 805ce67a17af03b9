import hashlib

import numpy as np
import pytest

from lexmill.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def brute(rows, k=8, dim=64, rounds=10, seed=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) by the plain method on Python's integers."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    by_hash = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in by_hash[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        own = [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in kept]
        if r < rounds:
            for c in range(len(centres)):
                mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
                centres[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)] if mine else centres[c]
    d = [far(v, centres[o]) for (_, v), o in zip(kept, own, strict=True)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i, o, x, sum(e for p, e in zip(own, d, strict=True) if p == o), sum(d), sha[o]) for (i, _), o, x in zip(kept, own, d, strict=True))


def odd_rows():
    gen = np.random.default_rng(5)
    mids = gen.normal(size=(6, 64)) * 0.5
    rows = [(i, (mids[i % 6] + gen.normal(size=64) * 0.2).tolist()) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(60)] + [(7, rows[7][1]), (8, rows[9][1])]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [float("nan")] + [0.0] * 63), (304, [float("inf")] + [0.0] * 63), (305, [None] + [0.0] * 63), (306, [0.0] * 64), (307, [-0.0] * 64), (308, [1e-30] * 64), (309, [-3.5] * 64)]
    return rows


def results(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("groups", [1, 3, 8])
def test_equals_the_plain_method(spark, groups):
    rows = odd_rows()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(5)
    got = results(centroids.cluster(df, groups=groups))
    assert got == brute(rows)


def test_null_ids_fewer_vectors_than_centroids_and_empty_tables(spark):
    rows = [(None, [0.5] * 64), (4, [0.25] * 64), (5, [0.25] * 64)]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    got = {tuple(r) for r in centroids.cluster(df).collect()}
    assert {(r[0], r[2], r[4]) for r in got} == {(None, 0, 0), (4, 0, 0), (5, 0, 0)}
    assert centroids.cluster(df, k=1).filter("vec_id is null").first().distance == max(r[2] for r in brute([(9 if i is None else i, v) for i, v in rows], k=1))
    assert centroids.cluster(df.limit(0)).collect() == []


def test_components_whose_squares_do_not_fit_end_the_query(spark):
    df = spark.createDataFrame([(1, [1e9] * 64, None)], SCHEMA)
    with pytest.raises(Exception, match="would not fit a long"):
        centroids.cluster(df).collect()


@pytest.mark.parametrize("spread", [1, 60, 100_000])
def test_rounds_keep_their_bounds_and_skip_distances(spread):
    """State over rounds against exact distances: bounds hold, ties go to the smaller number, and later rounds compute
    fewer distances than all."""
    gen = np.random.default_rng(spread)
    x = gen.integers(-spread, spread + 1, size=(4000, 16))
    x[:2000] += gen.integers(-40 * spread, 40 * spread + 1, size=(10, 16))[gen.integers(0, 10, 2000)]
    c = x[gen.choice(4000, 12, replace=False)]
    group, before = centroids.group_centroids(c, 4), None
    own, upper, lower = np.full(4000, -1), np.zeros(4000), np.zeros((4000, int(group.max()) + 1))
    asked = []
    for _ in range(8):
        own, upper, lower, n = centroids.Yinyang(c, group, before).assign(x, own, upper, lower)
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (own == d.argmin(axis=1)).all() and (upper >= np.sqrt(d.min(axis=1))).all()
        for g in range(lower.shape[1]):
            others = np.where((group[None, :] == g) & (np.arange(12)[None, :] != own[:, None]), d, np.iinfo(np.int64).max).min(axis=1)
            assert (lower[:, g] <= np.sqrt(others)).all()
        asked.append(n)
        before, c = c, np.array([x[own == k].sum(axis=0) // max(1, (own == k).sum()) if (own == k).any() else c[k] for k in range(12)])
    assert asked[0] == 4000 * 12 and asked[-1] < asked[0]
