"""Run metrics: phase totals, progress, stalls, log tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.storage import written


def phase_totals(log: DataFrame, phase: str, value: str) -> DataFrame:
    return log.groupBy(phase).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))


def stalls(log: DataFrame, run: str, ts: str, silence_s: float) -> DataFrame:
    """Events of a run that came after a silence of more than silence_s seconds."""
    w = Window.partitionBy(run).orderBy(ts, "event_id")
    gap = F.col(ts).cast("double") - F.lag(F.col(ts).cast("double")).over(w)
    return log.withColumn("gap_s", gap).filter(F.col("gap_s") > silence_s)


def eta(log: DataFrame, run: str, ts: str) -> DataFrame:
    """Per event: done so far, seconds since the run's first event, and the estimate for the rest of the run."""
    w = Window.partitionBy(run).orderBy(ts, "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(run)
    out = log.withColumn("done", F.count(F.lit(1)).over(w)).withColumn("total", F.count(F.lit(1)).over(whole))
    out = out.withColumn("elapsed_s", F.col(ts).cast("double") - F.min(F.col(ts).cast("double")).over(w))
    return out.withColumn("eta_s", F.col("elapsed_s") / F.col("done") * F.greatest(F.col("total") - F.col("done"), F.lit(0)))


def tail(log: DataFrame, ts: str, n: int) -> DataFrame:
    """The last n lines; Spark keeps n rows a task and merges them."""
    return log.orderBy(F.col(ts).desc(), F.col("event_id").desc()).limit(n)


# The phases of a run whose times a rollup adds up.
PHASES = ("scan", "ocr", "text", "inference")


def rollup(log: DataFrame, phase: str, ms: str, docs: str, pages: str, wall_ms: Column | None = None) -> DataFrame:
    """One row over a run's log: milliseconds by phase, documents (the most that any row tells of), pages, and the
    averages; documents a minute by the wall clock where it is known, else by the phases' sum; 0 where nothing divides."""
    sums = [F.coalesce(F.sum(F.when(F.col(phase) == p, F.col(ms))), F.lit(0.0)).alias(f"{p}_ms") for p in PHASES]
    wall = F.lit(0.0) if wall_ms is None else wall_ms
    row = log.agg(*sums, F.coalesce(F.max(docs), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(pages), F.lit(0)).alias("n_pages")).withColumn("wall_ms", wall)
    worked = F.col("ocr_ms") + F.col("text_ms") + F.col("inference_ms")
    spent = F.when(F.col("wall_ms") > 0, F.col("wall_ms")).otherwise(F.col("scan_ms") + worked)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return row.withColumns({"avg_page_ms": ratio(worked, F.col("n_pages")), "avg_doc_ms": ratio(F.col("scan_ms") + worked, F.col("n_docs")), "docs_per_minute": ratio(F.col("n_docs") * 60000.0, spent)})


def run_counters(docs: DataFrame, status: str, cached: str, ocr: str) -> DataFrame:
    """(found, cached, read_by_ocr, completed) over the documents of a run."""
    return docs.agg(F.count(F.lit(1)).alias("found"), F.count_if(cached).alias("cached"), F.count_if(ocr).alias("read_by_ocr"), F.count_if(F.col(status) == "OK").alias("completed"))


def estimate(baseline: DataFrame, n_docs: int) -> DataFrame:
    """What a run over n_docs documents may take by the last rollup that had a positive average, in milliseconds."""
    last = baseline.filter("avg_doc_ms > 0").agg(F.max_by("avg_doc_ms", "ended_at").alias("avg_doc_ms"))
    return last.select("avg_doc_ms", (F.col("avg_doc_ms") * n_docs).alias("estimate_ms"))


def throttled(log: DataFrame, run: str, ts: str, least_s: float, every: int = 0) -> DataFrame:
    """The events of a run that are shown: the first, those that come `least_s` seconds or more after the event before,
    and each `every`-th."""
    w = Window.partitionBy(run).orderBy(ts, "event_id")
    gap = F.col(ts).cast("double") - F.lag(F.col(ts).cast("double")).over(w)
    place = F.row_number().over(w)
    shown = gap.isNull() | (gap >= least_s)
    shown = shown | (place % every == 0) if every else shown
    return log.withColumn("__shown", shown).filter("__shown").drop("__shown")


def positions(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """(rows with their place from 0 in the order of the named columns, how many there are). Rows are range-sorted and
    written with their number in their partition, to which the partitions before add one count each. Rows that are equal
    in the order have an arbitrary place among themselves, which stays as it was written."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = written(dealt, "positions")
    # Fixed by the function: the partition in the upper 31 bits, the row's number in it in the lower 33.
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = sorted(dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, sums = 0, []
    for number, n in counts:
        sums.append((number, before))
        before += n
    earlier = rows.sparkSession.createDataFrame(sums, "__part long, __before long")
    placed = dealt.withColumn("__part", part).join(F.broadcast(earlier), "__part").withColumn(name, F.col("__before") + inside)
    return placed.drop("__part", "__at", "__before"), before


def ranked(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """rows with their place (from 1) in a global order. Rows are range-sorted into partitions and written; a place is the
    number of rows in the partitions before, of which there is one count each, and the place in its own."""
    key, part, before = "__order", "__part", "__before"
    dealt = rows.withColumn(key, order)
    dealt = written(dealt.repartitionByRange(key).withColumn(part, F.spark_partition_id()), "ranked")
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.join(F.broadcast(counts.select(part, earlier.alias(before))), part)
    place = F.col(before) + F.row_number().over(Window.partitionBy(part).orderBy(key))
    return placed.withColumn(name, place).select(*[c for c in rows.columns if c != name], name)
