"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them, one representative a group.

1. Centres are fitted by spherical k-means on a sample of vectors, chosen by hash: four for each cell, `SAMPLE` at least;
   every vector is indexed. There are about sqrt(n) / 2 cells, at most `MAX_CELLS`, so a cell holds about 2 sqrt(n)
   vectors; beyond 10^9 vectors cells grow with the table, and so do the tasks' number and work, not their size.
2. A vector is at home in the cell of its nearest centre. It also visits every cell whose centre is less than
   `margin` further off, by cosine, than the nearest. Vectors with cosine >= t that have different homes are nearly as
   close to one centre as to the other; a pair is lost only if neither visits the other's home, which the tests and
   the README measure (recall over 0.99 on the fixtures).
3. Equal vectors are one class and cost one row, however many there are; they are told apart by two 64-bit hashes.
   Vectors travel as their bytes, in the precision they came in. Which cells are large is counted first, and then the
   vectors at home in a cell are cut into blocks of at most `BLOCK`, all that visit it into blocks of `VISITORS`, dealt by
   hash; each pair of blocks is a task's group of bounded size, whatever a cell holds. Inside a group one matrix product
   gives all cosines; what leaves it is one row per vector with its number of links, and its links as a spanning forest of
   the group, never all pairs.
4. Components come from the forests' edges. Rows then get their class's results by its hashes.

A pair that meets in both homes counts in one of them. Null, empty and zero vectors and those with null or non-finite
components link with nothing. Vectors of different lengths do not link; each length has cells of its own. Rows with
the same vec_id are vectors of their own that share an id. Null vec_ids name a group only where there is no other. An
empty table gives an empty one; columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import drop_path, written, written_at
from lexmill.llm.components import components

THRESHOLD = 0.95
SAMPLE = 20_000
MAX_CELLS = 1 << 14
BLOCK = 1024
VISITORS = 4096
MARGIN = 0.12
ROUNDS = 8
_ROWS_AT_ONCE = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centres(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centres for the unit rows of sample; starts from rows spread over the sample, keeps empty cells."""
    k = max(1, min(k, len(sample)))
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([np.argmax(sample[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def cells_of(x: np.ndarray, centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all cells that unit rows x visit, the home of each row first among its cells."""
    rows, cells = [], []
    for i in range(0, len(x), _ROWS_AT_ONCE):
        near = x[i : i + _ROWS_AT_ONCE] @ centres.T
        home = np.argmax(near, axis=1)
        row, cell = np.nonzero(near >= near.max(axis=1, keepdims=True) - margin)
        by = np.lexsort((cell != home[row], row))
        rows.append(row[by] + i)
        cells.append(cell[by])
    return np.concatenate(rows), np.concatenate(cells)


def _classes(vectors: DataFrame) -> DataFrame:
    """One row for each distinct usable vector: key, the hashes a and b, n (vectors), first (smallest vec_id), e. The key
    is made as the table is written, so it is the same for all who read it."""
    usable = vectors.filter("ok").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.first("e").alias("e"))
    return usable.withColumn("key", F.monotonically_increasing_id())


def _rows_of(vectors: pa.ListArray) -> np.ndarray:
    """Unit rows in double precision of lists of one length."""
    raw = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    return _unit(raw / np.abs(raw).max(axis=1, keepdims=True))


def _block_links(x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    return x @ y.T >= t


def _forest(linked: np.ndarray, row_keys: np.ndarray, col_keys: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, as stars, of the bipartite links of one group; quadratic in the block only."""
    rows = np.flatnonzero(linked.any(axis=1))
    if not len(rows):
        return []
    cols = np.flatnonzero(linked.any(axis=0))
    sub = linked[np.ix_(rows, cols)]
    mark = np.arange(len(rows))
    far = len(rows)
    while True:
        col_mark = np.where(sub, mark[:, None], far).min(axis=0)
        new = np.where(sub, col_mark[None, :], far).min(axis=1)
        if (new == mark).all():
            break
        mark = new
    hub = row_keys[rows]
    edges = [(int(hub[m]), int(k)) for m, k in zip(mark, row_keys[rows], strict=True)]
    return edges + [(int(hub[m]), int(k)) for m, k in zip(col_mark, col_keys[cols], strict=True)]


_GROUP_OUT = "key long, other long, links long"


def _vectors(raw: pd.Series, dtype: np.dtype) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype).astype(float).reshape(len(raw), -1)
    return _unit(x / np.abs(x).max(axis=1, keepdims=True))


def _compare(pdf: pd.DataFrame, t: float, dtype: np.dtype) -> pd.DataFrame:
    """One pair of blocks of one cell: side 0 are vectors at home in it, side 1 all vectors that visit it."""
    one, two = pdf[pdf.side == 0], pdf[pdf.side == 1]
    empty = pd.DataFrame({"key": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})
    if one.empty or two.empty:
        return empty
    a, b = one.key.to_numpy(), two.key.to_numpy()
    linked = _block_links(_vectors(one.raw, dtype), _vectors(two.raw, dtype), t) & (a[:, None] != b[None, :])
    if not linked.any():
        return empty
    cell, home_b = int(one.cell.iloc[0]), two.home.to_numpy()
    # A pair of homes in this cell is met from both sides. Another pair may also meet in the other's home: there, if
    # the home vector here visits that cell; it then counts in the smaller cell.
    same = home_b == cell
    smaller = np.unique(home_b[home_b < cell])
    visited = np.zeros((len(a), len(smaller)), bool)
    visits = [np.frombuffer(v, np.int32) for v in one.visits]
    row, at = np.repeat(np.arange(len(a)), [len(v) for v in visits]), np.concatenate(visits)
    place = np.searchsorted(smaller, at)
    known = (place < len(smaller)) & (smaller[np.minimum(place, len(smaller) - 1)] == at) if len(smaller) else np.zeros(len(at), bool)
    visited[row[known], place[known]] = True
    counted = linked.copy()
    there = np.flatnonzero(home_b < cell)
    counted[:, there] &= ~visited[:, np.searchsorted(smaller, home_b[there])]
    n_a, n_b = one.n.to_numpy(), two.n.to_numpy()
    away = counted & ~same[None, :]
    sums = np.concatenate([counted @ n_b, n_a @ away])
    edges = [(p, q) for p, q in _forest(linked, a, b) if p != q]
    keys, others = np.concatenate([a, b])[sums > 0], np.array(edges, np.int64).reshape(-1, 2)
    out = pd.DataFrame({"key": np.concatenate([keys, others[:, 0]]), "other": np.concatenate([np.zeros_like(keys), others[:, 1]]), "links": np.concatenate([sums[sums > 0], np.zeros(len(others), np.int64)])})
    out["other"] = out.other.astype("Int64").mask(np.arange(len(out)) < len(keys))
    return out


def _centres(classes: DataFrame, dim: int, n: int) -> np.ndarray:
    cells = min(MAX_CELLS, max(1, round(math.sqrt(n) / 2)))
    share = min(1.0, max(SAMPLE, 4 * cells) / max(1, n))
    picked = classes.filter((F.size("e") == dim) & (F.pmod(F.xxhash64("a", F.lit(17)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)))
    rows = picked.select("a", "b", "e").toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
    sample = _rows_of(rows.column("e").combine_chunks()) if len(rows) else np.ones((1, dim))
    return fit_centres(sample, cells)


def _bytes_of(e: pa.ListArray) -> list[bytes]:
    starts, raw = e.offsets.to_numpy(), e.flatten().to_numpy(zero_copy_only=False)
    at = ((starts - starts[0]) * raw.itemsize).tolist()
    whole = raw.tobytes()
    return [whole[i:j] for i, j in zip(at, at[1:], strict=False)]


_VISIT = "dim int, cell int, home int, key long, n long, raw binary, visits binary"


def assign_cells(classes: DataFrame, centres, margin: float = MARGIN, vectors: bool = True) -> DataFrame:  # noqa: ANN001
    """classes with one row for each visit: dim, cell, home, key, n, raw (the vector's bytes), and at home visits (its
    cells). centres are broadcast, by length. Without vectors the last two are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.diff(whole.column(2).offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                batch = whole.filter(pa.array(sizes == dim))
                # Lengths that are rarer than the 64 commonest share one cell each.
                own = centres.value.get(dim)
                x = _rows_of(batch.column(2))
                row, cell = cells_of(x, own, margin) if own is not None else (np.arange(len(x)), np.zeros(len(x), int))
                first = np.searchsorted(row, np.arange(len(x) + 1))
                home, cell = cell[first[row]].astype(np.int32), cell.astype(np.int32)
                columns = [pa.array(np.full(len(row), dim, np.int32)), pa.array(cell), pa.array(home), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))]
                if vectors:
                    raw = pa.array(_bytes_of(batch.column(2)), pa.binary())
                    visits = pa.array([cell[i:j].tobytes() for i, j in zip(first, first[1:], strict=False)], pa.binary())
                    columns += [raw.take(pa.array(row)), visits.take(pa.array(np.where(cell == home, row, -1), mask=cell != home))]
                else:
                    columns += [pa.nulls(len(row), pa.binary())] * 2
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _VISIT.split(", ")])

    return classes.select("key", "n", "e").mapInArrow(run, _VISIT)


def link_near(classes: DataFrame, t: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """classes to rows (key, other, links): links to add to key's number, or an edge key - other of the forests."""
    sizes = {r.dim: r.n for r in classes.groupBy(F.size("e").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(64).collect()}
    centres = classes.sparkSession.sparkContext.broadcast({dim: _centres(classes, dim, n) for dim, n in sizes.items()})
    members = assign_cells(classes, centres, margin, vectors=False).groupBy("dim", "cell").agg(F.count_if(F.col("cell") == F.col("home")).alias("homes"), F.count(F.lit(1)).alias("all"))
    blocks = members.select("dim", "cell", F.ceil(F.col("homes") / BLOCK).cast("int").alias("ones"), F.ceil(F.col("all") / VISITORS).cast("int").alias("twos")).filter("ones > 0")
    blocks = written(blocks, "embedding-blocks")
    placed = assign_cells(classes, centres, margin).join(F.broadcast(blocks) if blocks.count() <= 64 * MAX_CELLS else blocks, ["dim", "cell"])
    of = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    one, two = F.array(of(F.col("ones"), 3)), F.array(of(F.col("twos"), 5))
    side = lambda number, i, j: F.transform(i, lambda x: F.transform(j, lambda y: F.struct(F.lit(number).alias("side"), x.alias("i"), y.alias("j"))))
    at_home = F.when(F.col("cell") == F.col("home"), F.flatten(side(0, one, every(F.col("twos")))))
    parts = F.concat(F.flatten(side(1, every(F.col("ones")), two)), F.coalesce(at_home, F.array().cast("array<struct<side:int,i:int,j:int>>")))
    dealt = placed.select("dim", "cell", "key", "n", "raw", "home", "visits", F.explode(parts).alias("g"))
    groups = dealt.select("dim", "cell", "g.i", "g.j", "g.side", "key", "n", "raw", "home", F.when(F.col("g.side") == 0, F.col("visits")).alias("visits"))
    dtype = np.dtype("float32" if "float" in classes.schema["e"].dataType.simpleString() else "float64")
    return groups.groupBy("dim", "cell", "i", "j").applyInPandas(lambda pdf: _compare(pdf, t, dtype), _GROUP_OUT)


def _component(kind: str) -> str:
    return "float" if kind == "array<float>" else "double"


def group_near(vectors: DataFrame, t: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """vectors (vec_id, embedding) to vec_id, n_links, component_id, kept."""
    spark, kind = vectors.sparkSession, vectors.schema["embedding"].dataType.simpleString()
    e = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.coalesce(F.col("e").isNotNull() & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value.
    rows = vectors.select("vec_id", e.alias("e")).withColumn("ok", ok).withColumn("e", F.when(F.col("ok"), F.transform("e", lambda x: x + F.lit(0).cast(_component(kind)))))
    rows = rows.withColumns({"a": F.xxhash64("e"), "b": F.xxhash64(F.lit(1), "e")})
    classes, classes_path = written_at(_classes(rows), "embedding-classes")
    found, found_path = written_at(link_near(classes, t, margin), "embedding-links")
    edges = found.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))
    labels = components(edges).withColumnRenamed("node", "key")
    links = found.filter("links > 0").groupBy("key").agg(F.sum("links").alias("links"))
    known = classes.select("key", "a", "b", "n", "first").join(labels, "key", "left").join(links, "key", "left")
    known = known.select("a", "b", "first", F.coalesce("label", "key").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    known = written(known, "embedding-known")
    drop_path(spark, classes_path)
    drop_path(spark, found_path)
    named = known.groupBy("label").agg(F.min("first").alias("component_id"))
    by_vector = known.join(named, "label").select("a", "b", "n_links", "component_id")
    linked = rows.filter("ok").select("vec_id", "a", "b").join(by_vector, ["a", "b"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def keep_representatives(vectors: DataFrame, **options) -> DataFrame:
    """The rows of vectors that represent their group, with the columns of vectors."""
    kept = group_near(vectors.select("vec_id", "embedding"), **options).filter("kept").select("vec_id").distinct()
    return vectors.join(kept, "vec_id", "left_semi")
