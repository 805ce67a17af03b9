"""Matching outputs to inputs by name: indexes of words and parts of names, then rounds in which inputs choose in turn."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.storage import fresh_path, written

# What a likeness of names is worth.
EQUAL, BEGINS, CONTAINS, CONTAINED, COMMON, EACH_WORD = 1000, 900, 800, 700, 500, 10


def _words(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name, r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != ""))


def name_score(wanted: Column, name: Column) -> Column:
    """How well an output's name suits an input's, whatever their case; null where they have no word in common."""
    a, b = F.lower(wanted), F.lower(name)
    common = F.size(F.array_intersect(_words(a), _words(b)))
    alike = F.when(a == b, EQUAL).when(b.startswith(a), BEGINS).when(F.contains(b, a), CONTAINS).when(F.contains(a, b), CONTAINED)
    return F.coalesce(alike, F.when(common > 0, COMMON + EACH_WORD * common))


GRAM = 3
#: Inputs of a folder that choose in one round.
AT_ONCE = 10_000
# Stands for the number of words of a list that belongs to a name.
NAMED = 3


def _numbered(rows: DataFrame, folder: str, order: list[Column], place: str) -> DataFrame:
    """rows with their place in the folder, from 1. The rows of a folder are dealt over tasks."""
    dealt = rows.repartitionByRange(folder, *order).sortWithinPartitions(folder, *order)
    dealt = written(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "match-dealt")
    runs = dealt.groupBy(folder, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(folder).orderBy("__part")) - F.col("__n")
    runs = runs.withColumn("__before", before).drop("__n")
    numbered = dealt.join(F.broadcast(runs), [folder, "__part"]).withColumn(place, F.col("__before") + F.col("__at") - F.col("__first") + 1)
    return written(numbered.select(*rows.columns, place), "match-numbered")


def _sets(rows: DataFrame, name: str, sizes: tuple[int, ...], *keep: str) -> DataFrame:
    """(*keep, size, key): all sets of one, two or three words of a name."""
    w, n = F.col("__w"), F.size("__w")
    later = lambda at: F.slice(w, at, n)
    key = lambda *words: F.concat_ws(" ", *words)
    kinds = {
        1: F.transform(w, lambda x: key(x)),
        2: F.flatten(F.transform(w, lambda x, i: F.transform(later(i + 2), lambda y: key(x, y)))),
        3: F.flatten(F.flatten(F.transform(w, lambda x, i: F.transform(later(i + 2), lambda y, j: F.transform(later(i + j + 3), lambda z: key(x, y, z)))))),
    }
    sized = lambda k: F.transform(kinds[k], lambda x: F.struct(F.lit(k).alias("size"), x.alias("key")))
    sets = F.concat(*[sized(k) for k in sizes])
    return rows.withColumn("__w", F.array_sort(_words(F.col(name)))).select(*keep, F.explode(sets).alias("__s")).select(*keep, "__s.size", "__s.key")


def _grams(name: Column) -> Column:
    """The empty text and all parts of 1 to GRAM characters, each once."""
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: F.substring(name, i, n))
    return F.array_distinct(F.concat(F.array(F.lit("")), *[cut(n) for n in range(1, GRAM + 1)]))


def _own_grams(name: Column) -> Column:
    """Parts that every name which contains this one has, of the greatest length that parts have."""
    n = F.least(F.length(name), F.lit(GRAM))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(name, i, n)))


def _containing(inner: DataFrame, outer: DataFrame, folder: str, small: str, large: str) -> DataFrame:
    """(folder, small, large) of all names of `outer` that contain a name of `inner`: an inner name looks up its rarest part."""
    parts = written(outer.select(folder, large, F.explode(_grams(F.col(large))).alias("gram")), "match-parts")
    known = parts.groupBy(folder, "gram").agg(F.count(F.lit(1)).alias("n"))
    asked = inner.select(folder, small, F.explode(_own_grams(F.col(small))).alias("gram")).join(known, [folder, "gram"], "left")
    n = F.coalesce("n", F.lit(0))
    rarest = asked.groupBy(folder, small).agg(F.min_by("gram", F.struct(n, "gram")).alias("gram"), F.min(n).alias("n")).filter("n > 0")
    return rarest.select(folder, small, "gram").join(parts, [folder, "gram"]).filter(F.contains(F.col(large), F.col(small))).select(folder, small, large)


def scored_names(ins: DataFrame, outs: DataFrame, folder: str) -> DataFrame:
    """(folder, wanted, name, score) of all pairs of lower-case names of which one contains the other or that share three
    words. Pairs come from an index of sets of words and one of parts of names, so names that have less in common never meet."""
    alike = _sets(ins, "wanted", (3,), folder, "wanted").join(_sets(outs, "name", (3,), folder, "name"), [folder, "size", "key"]).select(folder, "wanted", "name")
    inside = _containing(ins, outs, folder, "wanted", "name").unionByName(_containing(outs, ins, folder, "name", "wanted"))
    return alike.unionByName(inside).distinct().withColumn("score", name_score(F.col("wanted"), F.col("name")))


def match_outputs(files: DataFrame, folder: str = "folder", at_once: int = AT_ONCE) -> DataFrame:
    """(folder, kind 'in' or 'out', path, stem, bytes) to (folder, input, output, score). Inputs with the best score choose
    first, then by path; an output is taken once; among equal scores the larger file wins, then the path. Null stems suit
    nothing; rows without a folder are left out; a path that repeats is one file, the larger.

    Inputs choose in rounds, in all folders side by side: of each folder the next `at_once` whose turn it is. What they
    choose from are lists of the outputs that are left, in the order in which they are preferred: for each name those
    whose names contain it, are contained in it or share three words, and for each word and each two words those with
    them. An input takes the first of its name's list, else of those of its two words, else of its words. The one whose
    turn is n-th among them needs no more than the n first of a list, as each before it takes one, so that a task holds
    at most at_once outputs a list, whatever the folder holds, and what is chosen is final."""
    spark = files.sparkSession
    file = files.filter(F.col(folder).isNotNull() & F.col("path").isNotNull()).groupBy(folder, "kind", "path").agg(F.max(F.struct("bytes", F.lower("stem").alias("stem"))).alias("f"))
    file = written(file.select(folder, "kind", "path", F.coalesce("f.bytes", F.lit(-1)).alias("bytes"), "f.stem").filter("stem is not null"), "match-files")
    ins = file.filter("kind = 'in'").select(folder, F.col("path").alias("input"), F.col("stem").alias("wanted"))
    outs = file.filter("kind = 'out'").select(folder, F.col("path").alias("output"), F.col("stem").alias("name"), "bytes")
    # `o` orders the outputs of a folder, larger files first.
    outs = _numbered(outs, folder, [F.col("bytes").desc(), F.col("output")], "o")
    wanted, names = ins.select(folder, "wanted").distinct(), outs.select(folder, "name").distinct()
    scored = written(scored_names(wanted, names, folder), "match-names")
    lists = written(_sets(outs, "name", (1, 2), folder, "o"), "match-lists")
    asks = written(_sets(wanted, "wanted", (1, 2), folder, "wanted").join(lists.select(folder, "key").distinct(), [folder, "key"], "left_semi"), "match-asks")
    worth = (F.lit(COMMON) + EACH_WORD * F.col("size")).alias("score")
    best = scored.select(folder, "wanted", "score").unionByName(asks.select(folder, "wanted", worth)).groupBy(folder, "wanted").agg(F.max("score").alias("best"))
    # `place` orders the inputs of a folder: whose is smaller chooses first.
    ins = _numbered(ins.join(best, [folder, "wanted"]), folder, [F.col("best").desc(), F.col("input")], "place")
    kind = files.schema[folder]
    got = T.StructType([kind, T.StructField("o", T.LongType()), T.StructField("place", T.LongType()), T.StructField("score", T.IntegerType())])
    chosen_at = fresh_path(spark, "matched")
    chosen = spark.createDataFrame([], got)

    def choose(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("score", "descending"), ("o", "ascending")])
        lists, asked = {}, {}
        for place, size, key, o, score in zip(*(rows[c].to_pylist() for c in ("place", "size", "key", "o", "score")), strict=True):
            if place is None:
                lists.setdefault((size, key), []).append((o, score))
            else:
                asked.setdefault(place, []).append((size, key))
        at, taken, out = dict.fromkeys(lists, 0), set(), []
        for place in sorted(asked):
            for size in (NAMED, 2, 1):
                heads = []
                for one in asked[place]:
                    if one[0] == size and one in lists:
                        while at[one] < len(lists[one]) and lists[one][at[one]][0] in taken:
                            at[one] += 1
                        heads += lists[one][at[one] : at[one] + 1]
                if heads:
                    o, score = min(heads)
                    taken.add(o)
                    out.append((o, place, score))
                    break
        o, places, scores = zip(*out, strict=True) if out else ((), (), ())
        folders = rows[folder].take(pa.array([0] * len(out), pa.int64()))
        return pa.table({folder: folders, "o": pa.array(o, pa.int64()), "place": pa.array(places, pa.int64()), "score": pa.array(scores, pa.int32())})

    last = ins.agg(F.max("place")).first()[0] or 0
    for done in range(0, last, at_once):
        batch = ins.filter(F.col("place").between(done + 1, done + at_once)).select(folder, "wanted", "place")
        depths = batch.groupBy(folder, "wanted").agg((F.max("place") - done).alias("most"))
        taken = chosen.select(folder, "o")
        nth = lambda order: F.row_number().over(Window.partitionBy(folder, "size", "key").orderBy(*order))
        named = depths.join(scored, [folder, "wanted"]).join(outs.select(folder, "name", "o"), [folder, "name"]).join(taken, [folder, "o"], "left_anti")
        named = named.select(folder, F.lit(NAMED).alias("size"), F.col("wanted").alias("key"), "o", "score", "most").withColumn("nth", nth([F.col("score").desc(), "o"])).filter("nth <= most")
        most = asks.join(depths, [folder, "wanted"]).groupBy(folder, "size", "key").agg(F.max("most").alias("most"))
        shared = lists.join(most, [folder, "size", "key"]).join(taken, [folder, "o"], "left_anti").withColumn("score", worth).withColumn("nth", nth(["o"])).filter("nth <= most")
        asked = batch.join(asks, [folder, "wanted"]).select(folder, "place", "size", "key").unionByName(batch.select(folder, "place", F.lit(NAMED).alias("size"), F.col("wanted").alias("key")))
        rows = named.unionByName(shared).drop("most", "nth").unionByName(asked, allowMissingColumns=True)
        rows.groupBy(folder).applyInArrow(choose, got).write.mode("append").parquet(chosen_at)
        chosen = spark.read.schema(got).parquet(chosen_at)
    return chosen.join(ins, [folder, "place"]).join(outs, [folder, "o"]).select(folder, "input", "output", "score")
