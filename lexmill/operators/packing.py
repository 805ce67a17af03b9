"""Batches under a character budget, and what map and reduce get to read.

Packing is sequential by its semantics: whether a document opens a batch depends on all before it in its run (an input
folder). It is computed across tasks all the same, whatever one run holds:

1. Documents get their places in the order of (run, key), from a range sort; blocks are so many consecutive places.
2. A block, with the first documents of the next, knows for each of its documents where the next batch would begin if one
   began there. Following these pointers through the block by doubling tells, for each document at which a batch might
   enter the block (a batch has at most budget / OVERHEAD documents, so these are few), at which it enters the next one.
3. These small tables are composed by doubling over blocks, which marks the document at which each block is really entered.
4. Sums over blocks, a row each, give the batches before a block; a second pass over the blocks numbers documents.

Nothing but a count for each partition of the sort reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators.metrics import positions
from lexmill.storage import drop_path, written, written_at

OVERHEAD = 80
CHARS_PER_TOKEN = 3.0
CONTEXT, CONTEXT_FLOOR, BUDGET_SHARE = 32_768, 1024, 0.70
SYSTEM_CHARS = 134


def token_budget(context: int = CONTEXT) -> int:
    return int(max(context, CONTEXT_FLOOR) * BUDGET_SHARE)


def tokens(text: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    return F.ceil(F.length(text) / chars_per_token)


def batch_budget(prompt_chars: int, context: int = CONTEXT, system_chars: int = SYSTEM_CHARS) -> int:
    return max(1500, int(token_budget(context) * CHARS_PER_TOKEN) - 2 * (prompt_chars + system_chars + 300))


#: Documents of a block, and blocks up to which their entries are broadcast.
BLOCK_ROWS, BROADCAST_BLOCKS = 1 << 16, 1 << 16


def _pointers(sizes: np.ndarray, opens: np.ndarray, budget: int) -> np.ndarray:
    """For each document the one that opens the next batch if it opens one itself; opens marks the first of each run."""
    n = len(sizes)
    ends = np.cumsum(sizes)
    after = np.maximum(np.searchsorted(ends, ends - sizes + budget, "right"), np.arange(1, n + 1))
    places = np.where(opens, np.arange(n), n)
    next_run = np.append(np.minimum.accumulate(places[::-1])[::-1][1:], n)
    return np.minimum(after, next_run)


def _first_of_runs(runs: list, fresh: bool) -> np.ndarray:
    return np.array([fresh, *[a != b for a, b in zip(runs, runs[1:], strict=False)]], bool)


def _through(block: pa.Table, width: int, entries: int, budget: int) -> dict:
    """What a block of documents does to batches that enter it at each of its first documents: exits, where the next
    block is entered; heads, batches that open in the block; last, the place of the last one; opened, batches that open
    before the block's last run begins (null where none begins)."""
    number, places = block.column("block")[0].as_py(), block.column("pos").to_numpy()
    first = number * width
    runs, sizes = block.column("run").to_pylist(), block.column("size").to_numpy()
    before = int(places[0] < first)
    opens = _first_of_runs(runs, True)[before:]
    n = int(np.searchsorted(places, first + width)) - before
    to = _pointers(sizes[before:], opens, budget)[:n]
    heads, last = np.ones(n, np.int64), np.arange(n)
    while (inside := np.flatnonzero(to < n)).size:
        then = to[inside]
        heads[inside], last[inside], to[inside] = heads[inside] + heads[then], last[then], to[then]
    k, begun = min(n, entries), np.flatnonzero(opens[:n])
    opened = (heads[:k] - heads[begun[-1]]).tolist() if begun.size else None
    return {"block": number, "fresh": bool(opens[0]), "exits": (to[:k] - n).tolist(), "heads": heads[:k].tolist(), "last": (first + last[:k]).tolist(), "opened": opened}


_LINKS = "block long, fresh boolean, exits array<int>, heads array<long>, last array<long>, opened array<long>"
_LINKS_ARROW = pa.schema([("block", pa.int64()), ("fresh", pa.bool_()), ("exits", pa.list_(pa.int32())), ("heads", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("opened", pa.list_(pa.int64()))])


def _entered(links: DataFrame, blocks: int) -> DataFrame:
    """(block, entry): the document of each block at which the first batch that opens in it does. Tables of jumps over 1,
    2, 4, ... blocks are composed, and each doubles the number of blocks whose entry is known."""
    spark = links.sparkSession
    known = spark.createDataFrame([(0, 0)], "block long, entry int")
    jumps, step, old = links.select("block", "exits"), 1, []
    while step < blocks:
        more = known.join(jumps, "block").select((F.col("block") + step).alias("block"), F.get("exits", F.col("entry")).alias("entry")).filter(F.col("block") < blocks)
        known, path = written_at(known.unionByName(more), "pack-known")
        paths = [path]
        if 2 * step < blocks:
            beyond = jumps.select((F.col("block") - step).alias("block"), F.col("exits").alias("then"))
            both = jumps.join(beyond, "block").select("block", F.transform("exits", lambda x: F.get("then", x)).alias("exits"))
            jumps, path = written_at(both, "pack-jumps")
            paths.append(path)
        for path in old:
            drop_path(spark, path)
        step, old = 2 * step, paths
    return known


def _block_starts(links: DataFrame, blocks: int) -> DataFrame:
    """A row for each block: entry, fresh, base (batches that open before it), head (place of the last of these), run_base
    (batches before its first document's run). Sums go over one row for each block."""
    at = lambda name: F.get(name, F.col("entry")).alias(name)
    rows = links.join(_entered(links, blocks), "block").select("block", "entry", "fresh", at("heads"), at("last"), at("opened"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("base", F.coalesce(F.sum("heads").over(earlier), F.lit(0)))
    run_base = F.coalesce(F.last(F.col("base") + F.col("opened"), ignorenulls=True).over(earlier), F.lit(0))
    return rows.select("block", "entry", "fresh", "base", F.lag("last").over(Window.orderBy("block")).alias("head"), run_base.alias("run_base"))


def _numbered(block: pa.Table, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(batch, place) of a block's documents."""
    entry, fresh, base, head, run_base = (block.column(c)[0].as_py() for c in ("entry", "fresh", "base", "head", "run_base"))
    places, sizes = block.column("pos").to_numpy(), block.column("size").to_numpy()
    opens = _first_of_runs(block.column("run").to_pylist(), fresh)
    to, n = _pointers(sizes, opens, budget), len(places)
    flags = np.zeros(n, bool)
    while entry < n:
        flags[entry] = True
        entry = int(to[entry])
    ordinal = base + np.cumsum(flags)
    heads = np.maximum.accumulate(np.where(flags, places, -1 if head is None else head))
    bases = np.maximum.accumulate(np.where(opens, ordinal - 1, run_base))
    return ordinal - bases, places - heads + 1


def pack(docs: DataFrame, run: str, key: str, size: Column, budget: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(run, key, batch, place): a batch is closed when the next document would pass the budget; batches count from 1, and
    so do places in them. Documents of a run go in order of key (nulls first); rows with equal keys in any order. A null
    size counts as 0. Only (run, key, size) moves."""
    spark = docs.sparkSession
    length = F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)) + OVERHEAD
    entries = max(1, budget // OVERHEAD)
    width = max(block_rows, entries)
    placed, total = positions(docs.select(F.col(run).alias("run"), F.col(key).alias("key"), length.cast("long").alias("size")), ["run", "key"], "pos")
    blocks, own = -(-total // width), (F.col("pos") / width).cast("long")
    if blocks > 1:
        inside = F.col("pos") % width
        # A block also sees the first documents of the next one, and the run of the last one before it.
        around = F.array(own, F.when(inside < entries, own - 1), F.when(inside == width - 1, own + 1))
        spread = placed.select("pos", "run", "size", F.explode(around).alias("block")).filter((F.col("block") >= 0) & (F.col("block") < blocks))
        told = lambda rows: pa.Table.from_pylist([_through(rows.sort_by("pos"), width, entries, budget)], _LINKS_ARROW)
        links = written(spread.groupBy("block").applyInArrow(told, _LINKS), "pack-links")
        starts = written(_block_starts(links, blocks), "pack-starts")
    else:
        starts = spark.createDataFrame([(0, 0, True, 0, None, 0)], "block long, entry int, fresh boolean, base long, head long, run_base long")
    joined = placed.withColumn("block", own).join(F.broadcast(starts) if blocks <= BROADCAST_BLOCKS else starts, "block")

    def number(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        batch, place = _numbered(rows, budget)
        return pa.Table.from_arrays([rows.column("run"), rows.column("key"), pa.array(batch.astype(np.int32)), pa.array(place.astype(np.int32))], names=[run, key, "batch", "place"])

    out = T.StructType([docs.schema[run], docs.schema[key], T.StructField("batch", T.IntegerType()), T.StructField("place", T.IntegerType())])
    return joined.groupBy("block").applyInArrow(number, out)


def labelled(place: Column, name: Column, text: Column) -> Column:
    return F.concat(F.lit("=== Dokument #"), place.cast("string"), F.lit(": "), name, F.lit(" ===\n"), text)


def payloads(docs: DataFrame, batches: DataFrame, run: str, key: str, name: Column, text: Column) -> DataFrame:
    """(run, batch, n_docs, payload): the labelled documents of each batch, numbered from 1, joined by a blank line."""
    rows = docs.join(batches, [run, key]).select(run, "batch", "place", labelled(F.col("place"), name, text).alias("part"))
    ordered = F.sort_array(F.collect_list(F.struct("place", "part")))
    return rows.groupBy(run, "batch").agg(F.count(F.lit(1)).alias("n_docs"), F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("payload"))


def labelled_outputs(partials: DataFrame, run: str, label: str) -> DataFrame:
    """(run, n_batches, payload) from (run, batch, output): the outputs in order, each below its label and number."""
    ordered = F.sort_array(F.collect_list(F.struct("batch", "output")))
    grouped = partials.groupBy(run).agg(F.count(F.lit(1)).alias("n_batches"), ordered.alias("parts"))
    part = lambda x: F.concat(F.lit(label), x["batch"].cast("string"), F.lit("/"), F.col("n_batches").cast("string"), F.lit(" ===\n"), x["output"])
    return grouped.select(run, "n_batches", F.array_join(F.transform("parts", part), "\n\n").alias("payload"))


def reduce_payload(partials: DataFrame, run: str) -> DataFrame:
    """What the reduce call gets to read of a run's partial outputs."""
    return labelled_outputs(partials, run, "=== Výstup dávky #")
