import random
import re
from collections import Counter

from lexmill.llm import quality


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(wins)
    repeat = {i + k for i, w in enumerate(wins) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)


def texts():
    rng = random.Random(1)
    out = [None, "", " \n\t", "one", "a b c", "a b c a b c", "x\x0by\x0cz\r\nq", "# * $ % & | < >", "é ü ö x", "same line\nsame line\n\nsame line", "w " * 30_000]
    for _ in range(120):
        words = [rng.choice("ab cd éf g# hh".split()) + rng.choice(["", "1", "2", "3"]) for _ in range(rng.randint(1, 150))]
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words))
    return out


def test_features_equal_brute_force(spark):
    rows = [(i, t, 5) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, n_words int")
    got = quality.score_quality(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        want = brute(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_order_of_the_cascade_does_not_change_the_verdict(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    one = {r.doc_id: r.kept for r in quality.score_quality(docs, list(quality.RULES)).collect()}
    two = {r.doc_id: r.kept for r in quality.score_quality(docs, list(quality.RULES)[::-1]).collect()}
    kept = {r.doc_id for r in quality.filter_quality(docs).collect()}
    assert one == two and kept == {i for i, k in one.items() if k}
    assert sorted(r.name for r in quality.plan_cascade(docs)) == sorted(r.name for r in quality.RULES)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score_quality(empty).collect() == [] and quality.filter_quality(empty).collect() == []


def test_the_order_is_the_same_in_every_run(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts() * 5)], "doc_id long, text string")
    docs.repartition(12).write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    sample = quality._sample(read, 64)
    assert 20 < sample.count() < 200 and len(set(sample.inputFiles())) <= len(set(read.inputFiles()))
    orders = [[r.name for r in quality.plan_cascade(read)] for _ in range(4)]
    assert orders == orders[:1] * 4


def test_cost_counts_work_and_rejections(spark):
    """Equal rejections: the cheaper rule goes first. A rule that rejects nothing goes last, whatever its cost."""
    words = spark.createDataFrame([(i, "x " * 100) for i in range(50)], "doc_id long, text string")
    names = [r.name for r in quality.plan_cascade(words)]
    assert names[:2] == ["word_length", "repeated"] and names[2:] == [r.name for r in quality.RULES if r.name not in names[:2]]
    assert set(quality.WORK) == set(quality.FEATURES) == {n for r in quality.RULES for n in r.needs}
