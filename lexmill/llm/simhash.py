"""SimHash near-duplicates by anchor-point covering.

Fingerprints: 64 bits over 3-word shingles, bit by bit the majority of the shingles' XXH64.

Links: fingerprints at most two bits apart. The anchors are the codewords of a product of two binary Golay codes
[23, 12] over bits 0-45 (2**24 anchors). The Golay code is perfect with covering radius 3, so every fingerprint has
one nearest anchor, its home, at most 3 bits away in each half. A fingerprint two bits away from it reaches that
anchor within 3 + t1 and 3 + t2 bits, t1 + t2 <= 2; each fingerprint is replicated to all anchors that near (66 on
average), and per anchor the homes are compared with all replicas. Leaving bits 46-63 out of the anchors loses
nothing: dropping bits only lessens distances, and the comparison itself uses all 64. Tables of over `TWO_CODES`
distinct fingerprints would crowd 2**24 anchors; there a third factor, the Hamming code [15, 11] of radius 1 over bits
46-60, makes 2**35 of them (152 replicas on average). The links are the same either way.

Fingerprints are made distinct first, so exact copies cost one row. An anchor that gathers more than `hot_members`
replicas, as a large group of near copies makes, is not compared pair by pair. Its members go to all midpoints at
most one bit away; two fingerprints are within two bits exactly if they share a midpoint, a midpoint has 65
neighbours at most, and all members of one midpoint are linked to its smallest. That path is exact too, and its
groups are bounded whatever the data are.

Null, empty and blank texts have fingerprint 0 and link like any other. Rows with equal fingerprints are copies.
Null doc_ids get rows like any other and never name a group while a doc_id is there. Equal rows stay as they are. Texts
of any length are read whole, `_SHINGLES_AT_ONCE` shingles at a time. An empty table gives an empty one. Columns other than
doc_id and text are not read by group_near_copies and pass through keep_one_of_each, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import free_name, written
from lexmill.llm.components import components

SEED = 42
BLOCK = 23
RADIUS = 3
THRESHOLD = 2
#: Generator polynomial of the binary Golay code.
GENERATOR = 0b110001110101
#: The Hamming code's: radius 1, and every word is its or next to one of its codewords.
SMALL_BLOCK, SMALL_RADIUS, SMALL_GENERATOR, SMALL_CHECK = 15, 1, 0b10011, 4
#: Distinct fingerprints up to which two codes are enough: some 260 replicas at an anchor.
TWO_CODES = 1 << 26
HOT_MEMBERS = 1024
_SHINGLES_AT_ONCE = 1 << 18


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit fingerprint of one UTF-8 text."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        words = [b" ".join(words), b"", b""]
        shingles = iter(words[:1])
        n = 1
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
        n = len(words) - 2
    digest, counts, left = xxhash.xxh64_intdigest, np.zeros(64, np.int64), n
    while left:
        size = min(left, _SHINGLES_AT_ONCE)
        h = np.fromiter((digest(s, SEED) for _, s in zip(range(size), shingles, strict=False)), np.uint64, size)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= size
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with the column fp (long), in place of text; columns other than doc_id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(x.as_py()) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, fp long")


class Code:
    """A perfect cyclic code's tables: by syndrome, the error patterns that lead to an anchor, grouped by excess over the
    radius."""

    def __init__(self, length: int, check: int, generator: int, radius: int) -> None:
        self.length, self.check = length, check
        remainder = np.zeros(1 << length, np.int16)
        for bit in range(length):
            r = 1 << bit
            for k in range(bit, check - 1, -1):
                if r >> k & 1:
                    r ^= generator << (k - check)
            remainder[1 << bit : 2 << bit] = remainder[: 1 << bit] ^ r
        self.remainder = remainder
        patterns = np.array([sum(1 << b for b in c) for w in range(radius + THRESHOLD + 1) for c in combinations(range(length), w)], np.int32)
        excess, syndrome = np.maximum(0, np.bitwise_count(patterns).astype(int) - radius), remainder[patterns].astype(int)
        order = np.lexsort((patterns, syndrome, excess))
        self.patterns = patterns[order]
        self.start = np.searchsorted((excess * (1 << check) + syndrome)[order], np.arange(((THRESHOLD + 1) << check) + 1))

    def near(self, block: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, number) of the patterns of that excess for each block."""
        cell = self.remainder[block].astype(np.int64) + (excess << self.check)
        return self.start[cell], self.start[cell + 1] - self.start[cell]

    def name(self, block: np.ndarray, pattern: np.ndarray) -> np.ndarray:
        """A systematic code: the upper bits of block and pattern together name the codeword."""
        return (self.patterns[pattern] ^ block) >> self.check


class Covering:
    """A product of codes over the lowest bits of a fingerprint."""

    def __init__(self, three: bool = False) -> None:
        golay = Code(BLOCK, 11, GENERATOR, RADIUS)
        self.codes = [golay, golay] + ([Code(SMALL_BLOCK, SMALL_CHECK, SMALL_GENERATOR, SMALL_RADIUS)] if three else [])

    def replicas(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, home) for every anchor within reach of every fingerprint."""
        left, blocks = fp.view(np.uint64), []
        for code in self.codes:
            blocks.append((left & np.uint64((1 << code.length) - 1)).astype(np.int64))
            left = left >> np.uint64(code.length)
        out = []
        for excess in product(range(THRESHOLD + 1), repeat=len(self.codes)):
            if sum(excess) > THRESHOLD:
                continue
            row, anchor = np.arange(len(fp)), np.zeros(len(fp), np.int64)
            for code, block, over in zip(self.codes, blocks, excess, strict=True):
                first, n = (x[row] for x in code.near(block, over))
                at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                row, anchor = np.repeat(row, n), np.repeat(anchor, n)
                anchor = anchor << (code.length - code.check) | code.name(block[row], at)
            out.append((row, anchor, np.full(len(row), not any(excess))))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def replicate(distinct: DataFrame, three: bool = False) -> DataFrame:
    """distinct (fp) to (anchor, fp, home)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covering = Covering(three)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 4096):
                fp = np.ascontiguousarray(fps[i : i + 4096])
                row, anchor, home = covering.replicas(fp)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row]), pa.array(home)], names=["anchor", "fp", "home"])

    return distinct.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def near_links(distinct: DataFrame, hot_members: int = HOT_MEMBERS, two_codes: int = TWO_CODES) -> DataFrame:
    """Links (a, b) between distinct fingerprints, such that fingerprints at most two bits apart are connected. Each
    pair meets at the homes of both; it counts at the home of the smaller."""
    spots = written(replicate(distinct, distinct.count() > two_codes), "simhash-replicas")
    hot = written(spots.groupBy("anchor").count().filter(F.col("count") > hot_members).select("anchor"), "simhash-hot")
    crowded = not hot.isEmpty()
    cold = spots.join(hot, "anchor", "left_anti") if crowded else spots
    homes = cold.filter("home").select("anchor", F.col("fp").alias("a"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD)
    links = homes.join(cold.select("anchor", F.col("fp").alias("b")), "anchor").filter(near).select("a", "b")
    if crowded:
        members = spots.join(hot, "anchor", "left_semi").select("fp").distinct()
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
        midpoints = members.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), "fp")
        groups = midpoints.groupBy("mid").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
        stars = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a != b")
        links = links.unionByName(stars.distinct())
    return links


def group_near_copies(docs: DataFrame, hot_members: int = HOT_MEMBERS, two_codes: int = TWO_CODES) -> DataFrame:
    """docs (doc_id, text) to doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that can be reached)."""
    prints = written(fingerprints(docs), "simhash-fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    labels = components(near_links(classes, hot_members, two_codes))
    joined = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    joined = written(joined.select("fp", "first", F.coalesce("label", "fp").alias("label")), "simhash-labelled")
    named = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = joined.join(named, "label").select("fp", "component_id")
    fp_hex = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(by_fp, "fp").select("doc_id", fp_hex.alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; columns as in docs. Rows that
    share a doc_id count as one document: of them the one with the smallest text stays. Rows without a doc_id have
    no place in that order and all stay."""
    groups = group_near_copies(docs.select("doc_id", "text"), **options)
    firsts = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.join(firsts, "doc_id", "left_semi")
    placed = free_name("place", docs.columns)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    named = named.withColumn(placed, place).filter(F.col(placed) == 1).select(*docs.columns)
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))
