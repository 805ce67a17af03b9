import random

import numpy as np
import pytest

from lexmill.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, v string"


def brute(rows, t=0.95):
    usable = {}
    for i, (vec_id, v, _) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            usable[i] = (vec_id, x / np.linalg.norm(x))
    near = {i: [j for j in usable if j != i and len(usable[i][1]) == len(usable[j][1]) and usable[i][1] @ usable[j][1] >= t] for i in usable}
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        first = min(rows[j][0] for j in seen)
        out.append((vec_id, len(near.get(i, [])), first, vec_id == first))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for _ in range(25):
        centre = rng.normal(size=64)
        for _ in range(rng.integers(1, 20)):
            out.append(centre + rng.normal(size=64) * rng.uniform(0.02, 0.5))
    out += list(rng.normal(size=(300, 64)))
    out += [out[3]] * 40 + [out[5] * 3.0] * 2
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(out)]
    random.Random(1).shuffle(rows)
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 0.0], [2.0, 0.001], [1e-30] * 64, [1e30] * 64, [-0.0] + [1.0] * 63, [0.0] + [1.0] * 63]
    return [(i, v, v_) for i, v, v_ in rows] + [(10_000 + i, v, None) for i, v in enumerate(odd)]


@pytest.mark.parametrize("block", [embeddings.BLOCK, 16])
def test_groups_equal_brute_force(spark, rows, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "VISITORS", 2 * block)
    got = sorted(tuple(r) for r in embeddings.group_near(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)


def test_representatives_and_empty(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    kept = embeddings.keep_representatives(table)
    assert kept.columns == table.columns
    assert sorted(r.vec_id for r in kept.collect()) == sorted(i for i, _, _, k in brute(rows) if k)
    assert embeddings.group_near(table.limit(0)).collect() == []


def test_recall_on_pairs_at_the_threshold(spark):
    """Pairs barely over the threshold, the hardest to keep together, among vectors without any clusters."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.normal(size=x.shape)
    w -= (w * x).sum(axis=1, keepdims=True) * x
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    y = 0.952 * x + np.sqrt(1 - 0.952**2) * w
    rows = [(i, [float(c) for c in v], None) for i, v in enumerate(np.vstack([x, y]))]
    got = {r.vec_id: r for r in embeddings.group_near(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = sum(got[i].component_id == got[i + 1500].component_id for i in range(1500))
    print("recall", found / 1500)
    assert found / 1500 >= 0.95
    near = np.array([r[1] for r in rows], np.float32).astype(float)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    links = (near @ near.T >= 0.95).sum(axis=1) - 1
    assert sum(got[i].n_links for i in range(3000)) / links.sum() >= 0.99


def test_a_vector_visits_all_cells_within_the_margin():
    rng = np.random.default_rng(3)
    x, centres = (embeddings._unit(rng.normal(size=(n, 64))) for n in (1500, 800))
    row, cell = embeddings.cells_of(x, centres, 0.12)
    near = x @ centres.T
    within = near >= near.max(axis=1, keepdims=True) - 0.12
    assert within.sum(axis=1).max() > 8
    assert sorted(zip(row.tolist(), cell.tolist())) == list(zip(*(a.tolist() for a in np.nonzero(within))))
    assert (np.diff(row) >= 0).all()
    assert (cell[np.searchsorted(row, np.arange(len(x)))] == near.argmax(axis=1)).all()
