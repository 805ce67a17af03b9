"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

1. Sizes (words) are summed by source. Targets share out all sizes by weight; no source's target exceeds
   `max_repeat` times its size, and what it cannot use is shared among the others by weight (water filling).
2. A hash orders each source's documents. Their cumulative sizes cut the source's target into whole epochs and a
   rest; the document at the end of the rest is taken in part, so that a source's taken words are its target.
3. Each source has a weight schedule over training time from 0 to 1, piecewise linear on equal steps. Its integral,
   scaled to the target, is the source's cumulative demand; inverting it at a document's cumulative tokens gives the
   document's position. Documents are range-sorted by position.

Cumulative sizes within a source take two levels: the hash deals a source of n documents to about sqrt(n) buckets,
buckets are summed first, and a window adds up within one bucket only. So a source with a third of all rows is
spread over many tasks.

The table of sources, one row each, is levelled by windows over all of it in one task. That holds for some tens of
millions of sources (a source for each web domain, say); documents never go that way.

Null texts have size 0; the null source is a source of its own, the last in order. Documents of size 0 take nothing.
Equal rows are taken one by one. An empty table gives an empty result. The mixed corpus has the columns of
its input, whatever their names. The order is a function of the rows alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import word_count, written

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: By place in WEIGHTS: relative weight at equally spaced times. The heavy sources lead, the light ones close.
SCHEDULES = ((1.5, 1.2, 0.9, 0.4), (1.0, 1.0, 1.0, 1.0), (0.4, 0.7, 1.2, 1.7))
#: Rows of the table of sources up to which it is broadcast; a longer one is joined by shuffle.
BROADCAST_SOURCES = 20_000


def _source_key(source: Column) -> Column:
    """Equal for equal sources, null included, in the order of code points with null last."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sizes (skey, size) to one row for each source: skey, n, source_size, turn (place in weights), target (double).

    With sources by ascending cap/weight, the level that fills the total is the largest of those levels that no
    later source's cap undercuts; a target is the lesser of cap and weight times level."""
    by_source = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    turn = ((F.row_number().over(Window.orderBy("skey")) - 1) % len(weights)).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1)
    cap = F.col("source_size") * float(max_repeat)
    rated = by_source.withColumn("turn", turn).withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", cap / F.col("weight"))
    upward = Window.orderBy("ratio", "skey")
    everywhere = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("cap").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(upward.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everywhere) - before) / rest
    levelled = rated.withColumn("level", level)
    chosen = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everywhere)
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(chosen, F.lit(0.0)))
    return levelled.withColumn("target", target).select("skey", "n", "source_size", "turn", "target")


def _inverse_demand(q: Column, knots) -> Column:
    """The time at which the share q of a source's demand has been met under the schedule `knots`."""
    step = 1.0 / (len(knots) - 1)
    areas = [step * (a + b) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    y = q * sum(areas)
    out, begun = None, 0.0
    for k, (a, b) in enumerate(zip(knots, knots[1:], strict=False)):
        part = F.greatest(y - begun, F.lit(0.0))
        root = F.sqrt(F.greatest(a * a + 2 * ((b - a) / step) * part, F.lit(0.0)))
        at = F.least(k * step + F.coalesce(F.try_divide(2 * part, a + root), F.lit(0.0)), F.lit((k + 1) * step))
        begun += areas[k]
        last = k == len(areas) - 1
        out = at if out is None and last else F.when(y <= begun, at) if out is None else out.otherwise(at) if last else out.when(y <= begun, at)
    return out


def position_of(q: Column, turn: Column, schedules=SCHEDULES) -> Column:
    out = None
    for i, knots in enumerate(schedules):
        at = _inverse_demand(q, knots)
        out = F.when(turn == i, at) if out is None else out.when(turn == i, at)
    return out


def assign(docs: DataFrame, whole_rows: bool = False, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, schedules=SCHEDULES) -> DataFrame:
    """docs (doc_id, text, source, ...) to doc_id, source, size, source_size, target, taken (words, repeats counted),
    epochs (whole passes), extra (words of one more, partial pass), position (of the first taken copy; null if
    none), order_key (position, or a value over 1 to sort the rest behind), and what `mix` needs. Texts are read once
    and left behind; with whole_rows each row's input columns come along as the struct __doc."""
    kept = ["doc_id", "source"] + [F.struct(*docs.columns).alias("__doc")] * whole_rows
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(2**53))
    keyed = docs.select(*kept, _source_key(F.col("source").cast("string")).alias("skey"), word_count(F.col("text")).alias("size"), u.alias("u"))
    sizes = written(keyed.select("skey", "size", "u") if whole_rows else keyed, "mixing-sizes")
    stats = written(source_targets(sizes, weights, max_repeat), "mixing-targets")
    if stats.count() <= BROADCAST_SOURCES:
        stats = F.broadcast(stats)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(stats, "skey").withColumn("bucket", F.floor(F.col("u") * F.ceil(F.sqrt("n"))))

    sums = dealt(sizes).groupBy("skey", "bucket").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("skey", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("skey", "bucket").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt(keyed if whole_rows else sizes).join(bases, ["skey", "bucket"])
    placed = placed.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    total = F.round("target").cast("long")
    epochs = F.coalesce(F.floor(F.try_divide(total, F.col("source_size"))), F.lit(0)).cast("long")
    rest = total - F.col("epochs") * F.col("source_size")
    placed = placed.withColumn("epochs", epochs)
    placed = placed.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))).cast("long"))
    placed = placed.withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))
    placed = placed.withColumn("position", F.when(F.col("taken") > 0, position_of(_share(F.lit(0)), F.col("turn"), schedules)))
    return placed.withColumn("order_key", F.coalesce("position", 1 + F.col("u")))


def _share(epoch: Column) -> Column:
    """The share of its source's demand that the middle of a document's copy lies at."""
    at = epoch * F.col("source_size") + F.col("before") + F.col("size") / 2
    return F.least(F.coalesce(F.try_divide(at, F.col("target")), F.lit(0.0)), F.lit(1.0))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: rows of docs, whole, each as often as it is taken (a partial pass counts if it covers half of
    the document or more), range-sorted by training position, with the columns of docs."""
    rows = assign(docs, whole_rows=True, **options)
    copies = F.col("epochs") + (2 * F.col("extra") >= F.col("size")).cast("long")
    copies = F.when(F.col("taken") > 0, copies).otherwise(F.lit(0))
    spread = rows.filter(copies > 0).withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    spread = spread.withColumn("__position", position_of(_share(F.col("__epoch")), F.col("turn")))
    return spread.orderBy("__position", "u", "__epoch").select("__doc.*")
