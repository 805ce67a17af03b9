"""Vector retrieval: score, top k, rerank, fallbacks, and leader clustering."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.rows import bound
from lexmill.functions.vectors import cosine
from lexmill.operators.chunking import chunk_array
from lexmill.operators.metrics import positions
from lexmill.storage import drop_path, fresh_path, written, written_at

TOP_K, CANDIDATES = 6, 20


def top_chunks(chunks: DataFrame, score: Column, doc: str, k: int = TOP_K) -> DataFrame:
    """The k best rows of each document with rank; ties go to the earlier chunk. Spark limits groups before it
    shuffles, so a task sends k rows of a document at most."""
    scored = chunks.withColumn("score", score)
    w = Window.partitionBy(doc).orderBy(F.col("score").desc(), F.col("chunk_idx").asc())
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_of(chunks: Column, score: Callable[[Column], Column], k: int = TOP_K) -> Column:
    """The k best of an array of texts as (idx, score), best first, ties to the earlier: all of a document's chunks are in
    its row, so nothing is exploded, shuffled or sorted but these pairs."""
    scored = F.transform(chunks, lambda c, i: bound(score(c), lambda s: F.struct((F.lit(0) - s).alias("cost"), i.alias("idx"), s.alias("score"))))
    return F.transform(F.slice(F.array_sort(scored), 1, k), lambda x: F.struct(x["idx"].alias("idx"), x["score"].alias("score")))


def search_context(docs: DataFrame, query: list[float], embed: Callable[[Column], Column], doc: str, text: str = "text", k: int = TOP_K) -> DataFrame:
    """The context of each document with a text: its k best chunks by cosine in order of rank, joined by a blank line."""
    score = lambda c: F.round(cosine(embed(c), F.array(*[F.lit(float(x)) for x in query])), 9)
    ranked = bound(chunk_array(F.col(text)), lambda chunks: F.transform(best_of(chunks, score, k), lambda b: F.struct(b["idx"].alias("idx"), F.get(chunks, b["idx"]).alias("chunk"))))
    rows = docs.filter(F.length(text) > 0).select(doc, ranked.alias("best"))
    return rows.select(doc, F.array_join(F.transform("best", lambda b: b["idx"].cast("string")), ",").alias("chunk_ids"), F.array_join("best.chunk", "\n\n").alias("context"))


def two_stage(docs: DataFrame, first: Callable[[Column], Column], second: Callable[[Column], Column], doc: str, text: str = "text", candidates: int = CANDIDATES, k: int = TOP_K) -> DataFrame:
    """(doc, rank, chunk_idx, score): candidates by the first score, then the best of them by the second, ties to the
    earlier chunk."""

    def chosen(chunks: Column) -> Column:
        places = F.array_sort(F.transform(best_of(chunks, first, candidates), lambda b: b["idx"]))
        pool = lambda at: bound(F.transform(at, lambda i: F.get(chunks, i)), lambda some: F.transform(best_of(some, second, k), lambda b: F.struct(F.get(at, b["idx"]).alias("chunk_idx"), b["score"].alias("score"))))
        return bound(places, pool)

    rows = docs.filter(F.length(text) > 0).select(doc, F.posexplode(bound(chunk_array(F.col(text)), chosen)).alias("at", "b"))
    return rows.select(doc, (F.col("at") + 1).alias("rank"), "b.chunk_idx", "b.score")


def overlap_score(text: Column, terms: list[str]) -> Column:
    """Number of different terms in a text: the built-in reranker, a stand-in for a model."""
    return bound(F.lower(text), lambda low: sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0)))


_QUERY_BLOCK, _ROW_BLOCK = 512, 4096


def _units(vectors: list, size: int) -> np.ndarray:
    """Unit rows; vectors that are null, of another length, zero or not finite become zero rows."""
    x = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == size:
            x[i] = [np.nan if c is None else c for c in v]
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=np.isfinite(norms) & (norms > 0))


def nearest_by_group(rows: DataFrame, queries: DataFrame, key: str, group: str, embedding: str, k: int = TOP_K) -> DataFrame:
    """(query, group, key, score, rank): for every query vector the k rows of each group with the highest cosine, ties
    to the smaller key. Vectors that are null, empty, zero or not finite, or of another length than the query's, score 0.
    Queries and rows are dealt into blocks by hash and meet pair by pair of blocks in a cogroup; each is one matrix
    product for each length, of which k rows a query and group are kept, so no pair of vectors is ever a row."""
    n_asked, n_rows = (max(1, -(-frame.count() // size)) for frame, size in ((queries, _QUERY_BLOCK), (rows, _ROW_BLOCK)))
    dealt = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = rows.select(dealt(n_rows).alias("i"), every(n_asked).alias("j"), F.col(key).alias("k"), F.col(group).alias("g"), F.col(embedding).alias("e"))
    asked = queries.select(every(n_rows).alias("i"), dealt(n_asked).alias("j"), F.col(key).alias("k"), F.col(embedding).alias("e"))

    def best(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("k", kind="stable").reset_index(drop=True)
        near = _near(list(asked.e), list(own.e), 0.0) if len(own) and len(asked) else np.zeros((len(asked), len(own)))
        parts = []
        # Codes and not the values themselves: a null group is a group.
        codes = pd.factorize(own.g, use_na_sentinel=False)[0]
        for code in range(codes.max(initial=-1) + 1):
            at = np.flatnonzero(codes == code)
            score = near[:, at]
            # k columns, and all that tie with the last of them; a stable sort of these keeps the order of keys.
            last = -np.partition(-score, min(k, len(at)) - 1, axis=1)[:, min(k, len(at)) - 1] if len(asked) else np.zeros(0)
            row, column = np.nonzero(score >= last[:, None])
            by = np.lexsort((column, -score[row, column], row))
            row, column = row[by], column[by]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, column = row[kept], column[kept]
            parts.append(pd.DataFrame({"query": asked.k.to_numpy()[row], "g": own.g.iloc[at[column]].to_numpy(), "k": own.k.to_numpy()[at[column]], "score": score[row, column]}))
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("query", "g", "k", "score")})

    key_type = rows.schema[key].dataType
    fields = [T.StructField("query", key_type), T.StructField("g", rows.schema[group].dataType), T.StructField("k", key_type), T.StructField("score", T.DoubleType())]
    some = own.groupBy("i", "j").cogroup(asked.groupBy("i", "j")).applyInPandas(best, T.StructType(fields)).toDF("query", group, key, "score")
    w = Window.partitionBy("query", group).orderBy(F.col("score").desc(), key)
    return some.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Survivors that one task settles in order, rows of a block product on either side, and the first round's candidates.
SETTLED, CANDIDATE_BLOCK, LEADER_BLOCK = 4096, 4096, 4096
#: Groups up to which their progress is broadcast, and leaders up to which their keys are.
BROADCAST_GROUPS, BROADCAST_LEADERS = 1 << 15, 1 << 17


def _near(x: list, y: list, otherwise: float = -1.0) -> np.ndarray:
    """Cosines of all pairs, rounded to nine places, zero vectors and components that are no numbers giving 0; `otherwise`
    where a vector is null or empty, or lengths differ."""
    out = np.full((len(x), len(y)), otherwise)
    at = lambda v: {n: [i for i, e in enumerate(v) if e is not None and len(e) == n] for n in {len(e) for e in v if e is not None and len(e)}}
    left, right = at(x), at(y)
    for n in left.keys() & right.keys():
        rows, columns = left[n], right[n]
        out[np.ix_(rows, columns)] = np.round(_units([x[i] for i in rows], n) @ _units([y[j] for j in columns], n).T, 9)
    return out


def _settle(vectors: list, threshold: float) -> np.ndarray:
    """The number of the vector that each joins, itself for leaders, in order, of vectors that no leader of before is near
    to."""
    own, found = np.arange(len(vectors)), []
    for i, v in enumerate(vectors):
        # Products go by blocks of the vectors behind the leaders, not one by one.
        if i % 256 == 0:
            near = _near(vectors[i : i + 256], vectors[: i + 256])
        mine = near[i % 256, found] if found else np.zeros(0)
        if len(mine) and mine.max() >= threshold:
            own[i] = found[int(mine.argmax())]
        else:
            found.append(i)
    return own


def _best_leaders(rows: DataFrame, known: DataFrame, most: int, groups: DataFrame) -> DataFrame:
    """rows (g, pos, e, ...) with b, the struct (score, -pos) of the most similar of the leaders known (g, pos, e) that
    come before them (the earliest of equals), null where there is none. Rows and leaders of a group meet by blocks of
    bounded size; most is a bound of a group's leaders, and groups (g, width) has one of its rows."""
    blocks = -(-most // LEADER_BLOCK)
    parts = F.greatest(F.lit(1), F.ceil(F.col("width") / CANDIDATE_BLOCK)).cast("int")
    of = lambda n: F.pmod(F.xxhash64("pos"), n).cast("int")
    left = rows.join(groups, "g").select("g", of(parts).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"), "pos", "e")
    right = known.join(groups, "g").select("g", F.explode(F.sequence(F.lit(0), parts - 1)).alias("i"), of(F.lit(blocks)).alias("j"), "pos", "e")

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if one.empty or two.empty:
            return pd.DataFrame({"pos": [], "score": [], "leader_pos": []}).astype({"pos": "int64", "score": float, "leader_pos": "int64"})
        two = two.sort_values("pos")
        near = np.where(two.pos.to_numpy()[None, :] < one.pos.to_numpy()[:, None], _near(list(one.e), list(two.e)), -2.0)
        at = near.argmax(axis=1)
        best = pd.DataFrame({"pos": one.pos.to_numpy(), "score": near[np.arange(len(one)), at], "leader_pos": two.pos.to_numpy()[at]})
        return best[best.score > -2]

    found = left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInPandas(compare, "pos long, score double, leader_pos long")
    best = found.groupBy("pos").agg(F.max(F.struct("score", (-F.col("leader_pos")).alias("back"))).alias("b"))
    return rows.join(best, "pos", "left")


def _first_of_groups(rows: DataFrame, n: int) -> DataFrame:
    """(g, pos, n): the n first rows of each group by pos, numbered. Parts of a group are cut to n rows before they meet."""
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    some = rows.select("g", "pos", F.pmod("pos", F.lit(64)).alias("part"))
    some = some.withColumn("n", number("g", "part")).filter(F.col("n") <= n).select("g", "pos")
    return some.withColumn("n", number("g")).filter(F.col("n") <= n)


def leaders(vectors: DataFrame, group: str, key: str, embedding: str, threshold: float, settled: int = SETTLED) -> DataFrame:
    """In order of key within a group, each vector joins the most similar earlier leader at or over the threshold (the
    earliest of equals), or becomes a leader: (group, key, leader, hit). Null and empty vectors, and vectors of another
    length than a leader's, have similarity -1 with it; zero vectors 0. Rows with equal keys go in any order.

    Groups go on side by side in rounds. A round takes the next candidates of each group, finds their most similar leader
    by block products, and lets the first `settled` of those without one settle among themselves, in order, in one task;
    the candidates up to there are then compared with the leaders that are new. A group's next round takes twice as many
    candidates if few were left without a leader, and `settled` if too many were. So the rounds are few where leaders
    become rare, and where all are leaders no task holds more than a bounded number of vectors. Vectors are range-sorted
    once, and leaders are a table; every round is written."""
    spark = vectors.sparkSession
    placed, _ = positions(vectors.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(embedding).alias("e")), ["g", "k"], "pos")
    # Joins go by a struct, so that a null group is one like any other.
    placed = written(placed.withColumn("g", F.struct("g")), "leader-vectors")
    state, state_path = written_at(placed.groupBy("g").agg(F.min("pos").alias("done"), (F.max("pos") + 1).alias("end")).withColumn("width", F.lit(settled).cast("long")), "leader-progress")
    few = state.count() <= BROADCAST_GROUPS
    near_by = lambda table: F.broadcast(table) if few else table
    stored_at, joined_at, most = fresh_path(spark, "leaders"), fresh_path(spark, "leader-joins"), 0
    stored = lambda: spark.read.schema(T.StructType([placed.schema[c] for c in ("g", "pos", "k", "e")])).parquet(stored_at)
    while True:
        open_groups = state.filter("done < end")
        span = open_groups.agg(F.min("done").alias("lo"), F.max(F.col("done") + F.col("width")).alias("hi")).first()
        if span.lo is None:
            break
        widths = near_by(open_groups.select("g", "width"))
        rows = placed.filter((F.col("pos") >= span.lo) & (F.col("pos") < span.hi)).join(near_by(open_groups), "g")
        rows = rows.filter((F.col("pos") >= F.col("done")) & (F.col("pos") < F.col("done") + F.col("width"))).select("g", "pos", "e")
        none = F.lit(None).cast("struct<score:double,back:long>")
        rows, rows_path = written_at(_best_leaders(rows, stored(), most, widths) if most else rows.withColumn("b", none), "leader-candidates")
        alone = rows.filter(F.col("b").isNull() | (F.col("b.score") < threshold))
        first, first_path = written_at(_first_of_groups(alone, settled + 1), "leader-alone")

        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pos")
            return pd.DataFrame({"pos": pdf.pos.to_numpy(), "leader_pos": pdf.pos.to_numpy()[_settle(list(pdf.e), threshold)]})

        survivors = alone.select("pos", "e").join(first.filter(F.col("n") <= settled), "pos").select("g", "pos", "e")
        decided, decided_path = written_at(survivors.groupBy("g").applyInPandas(settle, "pos long, leader_pos long"), "leader-settled")
        # The next survivor behind those that were settled ends the round for its group.
        cuts = first.groupBy("g").agg(F.max("n").alias("n"), F.max("pos").alias("last"))
        until = F.when(F.col("n") > settled, F.col("last")).otherwise(F.least(F.col("done") + F.col("width"), F.col("end")))
        wider = F.when(F.col("n") > settled, F.lit(settled)).when(F.col("n") > settled // 2, F.col("width")).otherwise(2 * F.col("width"))
        n = F.coalesce("n", F.lit(0))
        state, new_path = written_at(open_groups.join(cuts, "g", "left").withColumn("n", n).select("g", until.alias("done"), "end", wider.cast("long").alias("width")), "leader-progress")
        fresh, fresh_at = written_at(rows.select("g", "pos", "e").join(decided.filter("pos = leader_pos").select("pos"), "pos"), "leader-new")
        near = rows.filter(F.col("b.score") >= threshold).join(near_by(state.select("g", F.col("done").alias("until"))), "g").filter("pos < until")
        again = _best_leaders(near.select("g", "pos", "e", F.col("b").alias("had")), fresh, settled, widths)
        best = F.greatest(F.col("had"), F.coalesce(F.col("b"), F.col("had")))
        again.select("pos", (-best["back"]).alias("leader_pos")).unionByName(decided).write.mode("append").parquet(joined_at)
        fresh.join(placed.filter((F.col("pos") >= span.lo) & (F.col("pos") < span.hi)).select("pos", "k"), "pos").select("g", "pos", "k", "e").write.mode("append").parquet(stored_at)
        most = stored().groupBy("g").count().agg(F.max("count")).first()[0]
        for path in (rows_path, first_path, decided_path, fresh_at, state_path):
            drop_path(spark, path)
        state_path = new_path
    if not most:
        return placed.select("g.g", "k", F.col("k").alias("leader"), F.lit(False).alias("hit")).toDF(group, key, "leader", "hit")
    joined = spark.read.schema("pos long, leader_pos long").parquet(joined_at)
    names = stored().select(F.col("pos").alias("leader_pos"), F.col("k").alias("leader"))
    out = placed.select("g", "k", "pos").join(joined, "pos").join(F.broadcast(names) if names.count() <= BROADCAST_LEADERS else names, "leader_pos")
    return out.select("g.g", "k", "leader", F.col("pos") != F.col("leader_pos")).toDF(group, key, "leader", "hit")
