import itertools
import random

import pytest
import xxhash

from lexmill.llm import simhash


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b) and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", None, " \n", "One", "a B", "A b c", "é È x y z\x0bq w", "w " * 5000, "ab cd ef gh " * 20])
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    assert simhash.fingerprint(None if text is None else text.encode()) % 2**64 == brute_fingerprint(text)


@pytest.mark.parametrize("three", [False, True])
def test_every_pair_within_two_bits_shares_a_home_anchor(three):
    import numpy as np

    cover, rng = simhash.Covering(three), random.Random(5)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 2)))
        fp = np.array([a, b], np.uint64).view(np.int64)
        row, anchor, home = cover.replicas(fp)
        homes = {int(x) for r, x, h in zip(row, anchor, home) if r == 0 and h}
        assert len(homes) == 1 and homes <= {int(x) for r, x in zip(row, anchor) if r == 1}


@pytest.mark.parametrize(("hot", "two_codes"), [(simhash.HOT_MEMBERS, simhash.TWO_CODES), (5, simhash.TWO_CODES), (simhash.HOT_MEMBERS, 0), (5, 0)])
def test_links_equal_brute_force(spark, hot, two_codes):
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:40]:
        for _ in range(6):
            values.add(v ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 3))))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    rows = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.label for r in simhash.components(simhash.near_links(rows, hot, two_codes)).collect()}
    want = brute_components(sorted(signed), lambda a, b: bin((a ^ b) % 2**64).count("1") <= 2)
    assert {n: got.get(n, n) for n in signed} == want


def test_groups_over_odd_rows(spark):
    rows = [(5, None, "x"), (3, "", "x"), (9, " \n", None), (4, "one two three four", "x"), (2, "ONE two  three\nfour", "y"), (4, "one two three four", "x"), (None, "one two three four", "z"), (7, "other words " * 400, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.group_near_copies(docs).collect()), key=str)
    prints = {i: f"{brute_fingerprint(t):016x}" for i, (_, t, _) in enumerate(rows)}
    want = sorted([(5, prints[0], 3), (3, prints[1], 3), (9, prints[2], 3), (4, prints[3], 2), (2, prints[4], 2), (4, prints[5], 2), (None, prints[6], 2), (7, prints[7], 7)], key=str)
    assert got == want
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 3, 7, None], key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.group_near_copies(empty).collect() == []
    assert simhash.keep_one_of_each(empty).collect() == []


def test_clashing_columns_pass_through(spark):
    names = ["place", "__place", "fp", "component_id"]
    docs = spark.createDataFrame([(1, "a b c d", "x", "y", "z", "w"), (1, "a b c d", "x", "y", "z", "w"), (2, "other words stand here", "p", "q", "r", "s")], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "a b c d", "x", "y", "z", "w"), (2, "other words stand here", "p", "q", "r", "s")]
