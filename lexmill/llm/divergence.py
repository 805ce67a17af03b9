"""Source divergence audit: which sources of a language differ most, and by which terms.

Terms are runs of letters (`TERM_RE`), A-Z lower-cased. A language keeps the terms that occur in at least `min_docs` of its
documents, V of them. A group is a (lang, source) of the table. With N the kept terms' occurrences in a group, a term that
occurs c times there weighs p = 1 + floor(SCALE * (c + 1) / (N + V)); the language as a whole is weighed likewise. The
divergence of weights p from q is f = floor((p - q)**2 / q), summed over the kept terms.

Each kept term is one row with an array of its cells (source index, weight, weight of a count of zero), ordered by source
index. Higher-order functions emit what pairs of its cells contribute; sums by pair of sources are combined before they are
shuffled. Cells without occurrences are not emitted: all zero cells of a group weigh the same (z), so with g and o the terms
that occur in either group

    D(g, o) = V f(zg, zo) + sum over g [f(p, zo) - f(zg, zo)] + sum over o [f(zg, q) - f(zg, zo)]
              + sum over both [f(p, q) - f(p, zo) - f(zg, q) + f(zg, zo)]

where the first three come from a histogram of weights by group, and only the last is summed term by term. Rare terms, most
of a vocabulary, so cost the square of the few sources that use them, not of all sources.

All arithmetic is on longs and exact; where a sum or a product does not fit, Spark's ANSI arithmetic ends the query (N + V
may reach 9 * 10**15). Null text, lang and source count as ''. Texts of any length are read whole. Groups without terms are
groups; a language without kept terms has pairs of value 0. Repeated rows are documents of their own. Ties of value go by
UTF-8 order of the item. An empty table gives an empty one. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import bound, drop_path, written, written_at

TERM_RE = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE_STEP, SCALE_STEPS = 1000, 3
MIN_DOCS, TOP_TERMS = 3, 200
#: Groups up to which tables of groups are broadcast, if their names have at most BROADCAST_BYTES.
BROADCAST_GROUPS, BROADCAST_BYTES = 1 << 15, 1 << 23
#: Sums that a task holds while it counts.
HELD = 800_000
#: Parts of a language where its table of groups is too large to be broadcast.
SALTS = 256


# In UTF-8, every byte of a character beyond ASCII is over 0x7F, so terms can be cut from bytes.
_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The matches of TERM_RE, A-Z lower-cased, in UTF-8."""
    return text.encode().translate(_BYTES).split() if text else []


def _over(p: Column, q: Column) -> Column:
    """Integral quotient of longs that are not negative."""
    return F.call_function("div", p, q)


def weight(count: Column, total: Column) -> Column:
    """1 + floor(SCALE_STEP ** SCALE_STEPS * (count + 1) / total), by long division, so that no product leaves a long."""
    first = count.cast("long") + 1

    def step(state: Column) -> Column:
        more = state["rest"] * SCALE_STEP
        return F.struct((state["out"] * SCALE_STEP + _over(more, total)).alias("out"), (more % total).alias("rest"))

    start = F.struct(_over(first, total).alias("out"), (first % total).alias("rest"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(SCALE_STEPS)), start, lambda state, _: step(state), lambda state: state["out"] + 1)


def divergence(p: Column, q: Column) -> Column:
    return _over((p - q) * (p - q), q)


def count_terms(docs: DataFrame, held: int = HELD) -> DataFrame:
    """docs (lang, source, text) to (lang, source, term, n, docs): occurrences, and documents that have the term. A task
    adds up what it reads and hands on its sums whenever it holds more than `held` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, docs_with, size = defaultdict(Counter), defaultdict(Counter), 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in sums.items():
                terms = pa.array(found.keys(), pa.binary()).cast(pa.string())
                with_term = docs_with[lang, source]
                of = lambda x: pa.array([x] * len(found), pa.string())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([of(lang), of(source), terms, pa.array(found.values(), pa.int64()), pa.array([with_term[t] for t in found], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            sums.clear()
            docs_with.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms, here = terms_of(text), sums[lang, source]
                before = len(here)
                here.update(terms)
                docs_with[lang, source].update(set(terms))
                size += len(here) - before
                if size > held:
                    yield from flushed()
                    size = 0
        yield from flushed()

    counted = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _joined(rows: DataFrame, table: DataFrame, keys: list[str], spread: str, small: bool) -> DataFrame:
    """rows with the columns of table, a table of groups or languages. A small one is broadcast; another is repeated
    SALTS times, so that a key with most of the rows is dealt over as many tasks, by the hash of the column `spread`."""
    if small:
        return rows.join(F.broadcast(table), keys)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"]).drop("salt")


def term_vectors(docs: DataFrame, groups: DataFrame, small: bool, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(vectors, langs), both written. vectors: lang, term, q (the language's weight), cells: array of (i, p, z) by source
    index i, for sources in which the term occurs. langs: lang, v, groups: array of (source, i, total, z), of which the
    element at i + 1 has index i."""
    counts = _joined(count_terms(docs), groups, ["lang", "source"], "term", small)
    pivoted = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "n"))).alias("cells"))
    kept, kept_path = written_at(pivoted.filter(F.col("docs") >= min_docs).drop("docs"), "divergence-terms")
    sums = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n"))
    cells = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.i").alias("i")).agg(F.sum("c.n").alias("here"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    whole = groups.join(cells, ["lang", "i"], "left").join(sums, "lang", "left").select("lang", "source", "i", zero(F.col("here")).alias("here"), zero(F.col("v")).alias("v"), zero(F.col("n")).alias("n"))
    # Where no term is kept no weight is used; the divisor is 1 there.
    whole = whole.withColumn("total", F.greatest(F.col("here") + F.col("v"), F.lit(1)))
    group = F.struct("i", "source", "total", weight(F.lit(0), F.col("total")).alias("z"))
    langs = written(whole.groupBy("lang", "v", "n").agg(F.array_sort(F.collect_list(group)).alias("groups")), "divergence-langs")
    known = _joined(kept.withColumnRenamed("n", "count"), langs, ["lang"], "term", small)
    cell = lambda c: bound(F.get("groups", c["i"]), lambda g: F.struct(c["i"].alias("i"), weight(c["n"], g["total"]).alias("p"), g["z"].alias("z")))
    vectors = known.select("lang", "term", weight(F.col("count"), F.col("n") + F.col("v")).alias("q"), F.transform("cells", cell).alias("cells"))
    vectors = written(vectors, "divergence-vectors")
    drop_path(docs.sparkSession, kept_path)
    return vectors, langs


def pair_sums(vectors: DataFrame, langs: DataFrame, small: bool) -> DataFrame:
    """(lang, g, o, value): the divergence of group g from group o, by source index, for all pairs of a language."""
    f = divergence
    one = lambda g, o, value: F.struct(g.alias("g"), o.alias("o"), value.alias("value"))

    def parts(rows: DataFrame, pairs: Column) -> DataFrame:
        return rows.select("lang", F.explode(pairs).alias("x")).select("lang", "x.g", "x.o", "x.value").filter("g != o")

    a = F.col("a")
    zeros = parts(langs.select("lang", "v", "groups", F.explode("groups").alias("a")), F.transform("groups", lambda b: one(a["i"], b["i"], F.col("v") * f(a["z"], b["z"]))))
    bars = vectors.select("lang", F.explode("cells").alias("a")).groupBy("lang", F.col("a.i").alias("i"), F.col("a.p").alias("p"), F.col("a.z").alias("z")).agg(F.count(F.lit(1)).alias("m"))
    bars = _joined(bars, langs.select("lang", "groups"), ["lang"], "p", small)
    i, p, z, m = (F.col(c) for c in ("i", "p", "z", "m"))
    here = F.transform("groups", lambda o: one(i, o["i"], m * (f(p, o["z"]) - f(z, o["z"]))))
    there = F.transform("groups", lambda g: one(g["i"], i, m * (f(g["z"], p) - f(g["z"], z))))
    singles = parts(bars, F.concat(here, there))
    # Pairs of a term's cells, each once; what they contribute is computed outside the lambda, in compiled code.
    met = vectors.filter(F.size("cells") > 1).select("lang", "cells", F.posexplode("cells").alias("at", "a"))
    later = F.slice("cells", F.col("at") + 2, F.greatest(F.size("cells") - F.col("at") - 1, F.lit(0)))
    each = F.transform(later, lambda b: F.struct(a["i"].alias("g"), a["p"].alias("p"), a["z"].alias("y"), b["i"].alias("o"), b["p"].alias("q"), b["z"].alias("z")))
    met = met.select("lang", F.explode(each).alias("x")).select("lang", "x.*")
    p, q, y, z = (F.col(c) for c in ("p", "q", "y", "z"))
    there_and_back = met.select("lang", "g", "o", (f(p, q) - f(p, z) - f(y, q) + f(y, z)).alias("there"), (f(q, p) - f(q, y) - f(z, p) + f(z, y)).alias("back"))
    summed = there_and_back.groupBy("lang", "g", "o").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    shared = parts(summed, F.array(one(F.col("g"), F.col("o"), F.col("there")), one(F.col("o"), F.col("g"), F.col("back"))))
    return zeros.unionByName(singles).unionByName(shared).groupBy("lang", "g", "o").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """docs (text, lang, source) to (lang, source, part, item, value, rank). Part `pair`: the group's divergence from each
    other source of its language. Part `term`: the terms of the group that weigh more in it than in its language, with
    their share of its divergence from that, down to rank top_terms. Ranks count from 1 by value, highest first."""
    clean = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = written(clean.select("lang", "source").distinct().withColumn("i", number), "divergence-groups")
    size = groups.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("source")), F.lit(0)).alias("bytes")).first()
    small = size.n <= broadcast_groups and size.bytes <= BROADCAST_BYTES
    vectors, langs = term_vectors(clean, groups, small, min_docs)
    name = lambda index, name: groups.select("lang", F.col("i").alias(index), F.col("source").alias(name))
    pairs = pair_sums(vectors, langs, small).withColumn("part", F.lit("pair"))
    pairs = _joined(_joined(pairs, name("g", "source"), ["lang", "g"], "o", small), name("o", "item"), ["lang", "o"], "g", small)
    terms = vectors.select("lang", F.col("term").alias("item"), "q", F.explode("cells").alias("c")).filter("c.p > q")
    terms = terms.select("lang", F.col("c.i").alias("g"), F.lit("term").alias("part"), "item", divergence(F.col("c.p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "g").orderBy(F.col("value").desc(), "item"))
    best = terms.withColumn("rank", rank).filter(F.col("rank") <= top_terms)
    best = _joined(best, name("g", "source"), ["lang", "g"], "item", small)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("rank", rank).select(*columns).unionByName(best.select(*columns))
