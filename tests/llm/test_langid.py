import math
import os
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import langid


def fold(text):
    out = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    return " " + " ".join(out.split()) + " "


def windows(text):
    s = fold(text)
    s = " " if not s.strip() else s
    padded = " " * 3 + s
    return [padded[i - 3 : i + 1] for i in range(4, len(padded))]


class Brute:
    """Interpolated Kneser-Ney by dictionaries."""

    def __init__(self, texts, alphabet):
        self.v, grams = alphabet, Counter(w for t in texts for w in windows(t))
        self.levels = {}
        for n in (4, 3, 2, 1):
            ones, twos = sum(c == 1 for c in grams.values()), sum(c == 2 for c in grams.values())
            d = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.05), 0.95)
            total, kinds = Counter(), Counter()
            for g, c in grams.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.levels[n] = (grams, total, kinds, d)
            grams = Counter(g[1:] for g in grams)

    def p(self, w):
        if not w:
            return 1 / self.v
        grams, total, kinds, d = self.levels[len(w)]
        h, lower = w[:-1], self.p(w[1:])
        return (max(grams[w] - d, 0) + d * kinds[h] * lower) / total[h] if total[h] else lower


DOCS = [(i, t, x) for i, (t, x) in enumerate([("The cat sat on the mat.", "en"), ("the hat, that ONE", "en"), ("der Hund und die Katze", "de"), ("das große Haus über dem Fluß", "de"), ("le chat noir", "fr"), ("où est l'été ?", "fr"), ("Привет мир", "ru"), ("no language here", None)] * 4)]


def test_cross_entropy_equals_brute_force(spark):
    model = langid.train(spark.createDataFrame(DOCS, "doc_id long, text string, lang string"))
    known = [(t, x) for i, t, x in DOCS if x and zlib.crc32(str(i).encode()) % 5 and zlib.crc32(str(i).encode()) % 20 != 1]
    assert model.langs == sorted({x for _, x in known})
    alphabet = 1 + len({w[-1] for t, _ in known for w in windows(t)})
    brute = {x: Brute([t for t, y in known if y == x], alphabet) for x in model.langs}
    texts = [t for _, t, _ in DOCS[:8]] + ["zebra Ж 漢字", "a", "the the the", "x" * 50]
    got, n, _ = model.entropies(langid.Folder(), texts)
    for t, row, size in zip(texts, got, n):
        ws = windows(t)
        assert size == len(ws)
        for x, value in zip(model.langs, row):
            assert math.isclose(value, -sum(math.log(brute[x].p(w)) for w in ws) / len(ws), rel_tol=1e-4), (t, x)


def test_rows(spark):
    rows = [*DOCS, (100, None, "en"), (101, "", "en"), (102, "12 34 !?", "en"), (103, "the cat " * 20_000, "en"), (None, "der und die", None), (103, "the cat " * 20_000, "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = langid.identify(docs, langid.train(docs)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got)
    empty = docs.limit(0)
    assert langid.identify(empty, langid.train(empty)).collect() == []
    assert [r.lang_pred for r in langid.identify(docs.limit(1), langid.train(empty)).collect()] == ["und"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in held) / len(held) < 0.05


def test_many_windows_are_scored_in_parts_with_the_same_result(spark, monkeypatch):
    rows = [*DOCS, *[(200 + i, f"{t} encore {i}", x) for i, (_, t, x) in enumerate(DOCS)], (100, None, "en"), (101, "12", "en"), (None, "der zebra", None), (7, "hapax", "xx"), (7, "hapax", "xx"), (300, "漢字 the Ж", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = langid.train(docs)
    want = langid.identify(docs, whole).collect()
    monkeypatch.setattr(langid, "MAX_GRAMS", 100)
    model = langid.train(docs)
    assert model.model.of > 1 and model.langs == whole.langs and "xx" in model.langs
    texts = [t for _, t, _ in rows] + ["zebra Ж 漢字", "x" * 50]
    for chars in (langid.GROUP_CHARS, 1):
        monkeypatch.setattr(langid, "GROUP_CHARS", chars)
        found = langid._sums_by_parts(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), model.model, by_text=True).collect()
        by = {r.key: r for r in found}
        assert sorted(by) == list(range(len(texts)))
        sums, n = np.array([by[i].sums for i in sorted(by)]), np.array([by[i].n for i in sorted(by)])
        assert np.allclose(langid.mean_entropy(sums, n), whole.entropies(langid.Folder(), texts)[0], rtol=1e-6)
    assert np.allclose(model.limits, whole.limits)
    got = langid.identify(docs, model).collect()
    rounded = lambda found: sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 4), round(r.cross_entropy or 0, 4), r.rejected) for r in found)
    assert rounded(got) == rounded(want)


def test_calibration_is_bounded_by_language_and_the_rest_is_counted(spark, monkeypatch):
    ids = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 20 == 1]
    rows = [(i, f"common words {i}", "aa") for i in ids[:400]] + [(i, "seltene wörter", "bb") for i in ids[400:430]]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "CALIBRATION_DOCS", 25)
    counted, kept = (sorted((r.doc_id, r.lang) for r in x.collect()) for x in langid._split(known))
    assert sorted(counted + kept) == sorted((i, x) for i, _, x in rows)
    assert Counter(x for _, x in kept) == {"aa": 25, "bb": 25}
    assert kept == sorted((r.doc_id, r.lang) for r in langid._split(known.orderBy(F.desc("doc_id")))[1].collect())
    model = langid.train(known)
    assert np.isfinite(model.limits).all()
