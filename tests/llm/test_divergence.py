import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, i long, cells string"


def brute(rows, min_docs=3, top=200):
    docs = [((lang or ""), (source or ""), re.findall(divergence.TERM_RE, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    seen, here, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        groups[lang].add(source)
        seen[lang].update(set(terms))
        here[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)
        whole = Counter()
        for s in sources:
            whole.update({t: here[lang, s][t] for t in kept})
        weigh = lambda count: {t: 1 + 10**9 * (count[t] + 1) // (sum(count[k] for k in kept) + len(kept)) for t in kept}
        p = {s: weigh(here[lang, s]) for s in sources}
        q = weigh(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if here[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def odd_rows():
    rows = [("the Stone the river", "en", "a"), ("THE stone of é É Straße", "en", "b"), ("the of of stone", "en", None), ("the the", "en", "b"), ("stone of the x1y", "en", "c")]
    rows += [("the stone " * (3 + i % 5) + "of river " * (i % 3), "en", "abc"[i % 3]) for i in range(30)]
    rows += [(None, "en", "empty"), ("", "en", "d"), ("12 ... \x00@[`{", "de", "a"), ("eins zwei", "de", "b"), (None, None, None), ("x " * 40_000 + "y z", None, "a"), ("x y z", None, "b"), ("x y z w", None, "b"), ("日本 語 x", "ja", "one"), ("日本 語", "ja", "one"), ("日本 Ω", "ja", "one")]
    return rows + rows[:2] * 2


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "t", i, "c") for i, (t, lang, s) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("small", [1 << 15, 0])
@pytest.mark.parametrize("top", [200, 2])
def test_equals_brute_force(spark, small, top):
    rows = odd_rows()
    got = divergence.audit(frame(spark, rows).repartition(3), top_terms=top, broadcast_groups=small)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, top=top)


def test_languages_without_kept_terms_have_pairs_of_value_zero(spark):
    rows = [("a", "x", "s"), ("b", "x", "t"), (None, "x", "u")]
    got = sorted(tuple(r) for r in divergence.audit(frame(spark, rows)).collect())
    assert got == brute(rows) and len(got) == 6 and {r[4] for r in got} == {0}


def test_empty_table(spark):
    assert divergence.audit(frame(spark, odd_rows()).limit(0)).collect() == []


def test_weights_are_exact_beyond_products_that_fit_a_long(spark):
    cases = [(0, 1), (10**12, 9 * 10**15), (9 * 10**14, 9 * 10**15 - 7), (5, 3 * 10**9), (7_777_777_777, 7_777_777_779)]
    df = spark.createDataFrame(cases, "c long, t long").select("c", "t", divergence.weight(F.col("c"), F.col("t")).alias("p"))
    assert [r.p for r in df.collect()] == [1 + 10**9 * (c + 1) // t for c, t in cases]
