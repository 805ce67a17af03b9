"""Language identification by interpolated Kneser-Ney character models, one for each language.

Texts are folded to lower-case letters and single spaces. All training texts are counted: every partition sums the
four-character windows of its texts by language before anything is shuffled. No window is left out. From the
four-character counts come the continuation counts of the lower orders, and from these the interpolated probabilities.
They are stored as sorted arrays of window keys (four characters of 16 bits are one 64-bit key), with one column of
logarithms for each language, so one binary search serves all languages; windows that no language has seen go down the
orders. Where there are more than `MAX_GRAMS` counts, the windows are dealt by their two middle characters into parts of
about that size: a part has all that its windows need of orders four and three; discounts, alphabet and the orders two
and one, which the alphabet bounds, are those of the full table. The counts then stay a table. Texts are read once, whatever
the number of parts: each gives its windows, counted, to their parts, where they meet the part's sorted arrays in one
exchange (GROUP_CHARS of text to a group; a part's arrays are sent to each of its groups), and the sums of the parts are
added up by text, with the same result.

The prediction is the language with the lowest cross-entropy per character. `score` is its posterior probability with
even priors, the evidence of a text being capped at `EVIDENCE` characters. Rejection is calibrated on training
documents kept from the counts, at most `CALIBRATION_DOCS` a language, of at most `CALIBRATION_CHARS` characters:
`rejected` marks texts whose cross-entropy lies above what `1 - REJECT` of the language's own texts of like length show.
Null texts and texts without letters are `und` with score 0; without any training text all are. Ties go to the language
that sorts first. Equal rows count and are scored each, an empty table gives an empty one, and columns other than doc_id,
text and lang are not read.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import written

ORDER = 4
#: (language, window) counts that are held at once; it decides on the number of parts only.
MAX_GRAMS = 2_000_000
#: Characters of text whose windows of one part are one task's group.
GROUP_CHARS = 5_000_000
EVIDENCE = 30
REJECT = 0.005
#: Documents of each language, the first by hash among those of at most so many characters, that are kept from the counts.
CALIBRATION_DOCS, CALIBRATION_CHARS = 1000, 100_000
_CHUNK = 1 << 21
_SPACE = 32
UNDEFINED = "und"


def _fold_table() -> np.ndarray:
    """For each code point of the basic plane: itself for letters and marks, else a space."""
    kept = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x10000)), bool, 0x10000)
    return np.where(kept, np.arange(0x10000), _SPACE).astype(np.uint64)


class Folder:
    """Texts to windows: (keys, start of each text's windows, letters of each text)."""

    def __init__(self) -> None:
        self.table = _fold_table()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths, parts = [], []
        for t in texts:
            low = "\n" + (t or "").lower() + "\n"
            parts.append(low)
            lengths.append(len(low))
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        # Letters beyond the basic plane share the private codes, which is enough to tell scripts apart.
        codes = np.where(codes < 0x10000, self.table[codes & 0xFFFF], 0xE000 + (codes >> 8) % 0x1000).astype(np.uint64)
        owner = np.repeat(np.arange(len(texts)), lengths)
        blank = codes == _SPACE
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        keep = ~(blank & np.concatenate([[False], blank[:-1]])) | first
        codes, owner, blank = codes[keep], owner[keep], blank[keep]
        letters = np.bincount(owner[~blank], minlength=len(texts))
        # Each window ends at a character behind the text's first blank; shorter histories are filled with blanks.
        keys, past = codes.copy(), codes
        new = np.concatenate([[True], owner[1:] != owner[:-1]])
        inside = np.arange(len(codes)) - np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))
        for back in range(1, ORDER):
            past = np.concatenate([np.full(back, _SPACE, np.uint64), codes[:-back]]) if back < len(codes) else np.full(len(codes), _SPACE, np.uint64)
            keys |= np.where(inside >= back, past, np.uint64(_SPACE)) << np.uint64(16 * back)
        keys, owner = keys[~new], owner[~new]
        return keys, np.searchsorted(owner, np.arange(len(texts) + 1)), letters


def _chunks(texts: list) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size > _CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def _sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count_windows(docs: DataFrame) -> DataFrame:
    """docs (lang, text) to (lang, gram, n), summed over all rows; gram is the signed 64-bit window key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, sums = Folder(), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            by_lang: dict[str, list[int]] = {}
            for i, lang in enumerate(langs):
                by_lang.setdefault(lang, []).append(i)
            for lang, rows in by_lang.items():
                own = [texts[i].as_py() for i in rows]
                for a, b in _chunks(own):
                    keys, _, letters = fold(own[a:b])
                    if letters.any():
                        got = np.unique(keys, return_counts=True)
                        old = sums.get(lang)
                        sums[lang] = _sum_by_key(*(np.concatenate(x) for x in zip(old, got, strict=True))) if old else got
                    # What a task holds is bounded; sums that leave it early are added up after the shuffle.
                    if sum(len(keys) for keys, _ in sums.values()) > MAX_GRAMS:
                        yield from flushed(sums)
        yield from flushed(sums)

    def flushed(sums: dict) -> Iterator[pa.RecordBatch]:
        for lang, (keys, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
        sums.clear()

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of keys in a sorted table."""
    if not len(table):
        return np.zeros(len(keys), int), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _part_of(keys: np.ndarray, of: int) -> np.ndarray:
    """The part of each window, by its two middle characters; _part_column is the same in Spark."""
    return (keys >> np.uint64(16) & np.uint64(0xFFFFFFFF)) * np.uint64(40503) % np.uint64(1000003) % np.uint64(of)


def _part_column(gram: Column, of: int) -> Column:
    return F.shiftright(gram, 16).bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(40503) % F.lit(1000003) % F.lit(of)


def _discount(ones: int, twos: int) -> float:
    return min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.05), 0.95)


_NO_COUNTS = np.zeros(0, np.uint64), np.zeros(0, np.int64)


class KneserNey:
    """Interpolated Kneser-Ney over windows of ORDER characters, from the counts of one language, or of one part of
    them with the counts of the lower orders and the discounts by order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int, lower: dict | None = None, discounts: dict | None = None) -> None:
        self.floor = 1.0 / max(1, alphabet)
        self.levels = {}
        for n in range(ORDER, 0, -1):
            context, total = _sum_by_key(keys >> np.uint64(16), counts)
            _, kinds = _sum_by_key(keys >> np.uint64(16), np.ones(len(keys), np.int64))
            discount = discounts[n] if discounts else _discount((counts == 1).sum(), (counts == 2).sum())
            self.levels[n] = (keys, counts, context, total, kinds, discount)
            if n > 1 and lower:
                keys, counts = lower[n - 1]
            else:
                keys, counts = _sum_by_key(keys & np.uint64((1 << 16 * (n - 1)) - 1), np.ones(len(keys), np.int64))

    def probability(self, windows: np.ndarray, n: int = ORDER) -> np.ndarray:
        if n == 0:
            return np.full(len(windows), self.floor)
        lower = self.probability(windows & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)
        keys, counts, context, total, kinds, discount = self.levels[n]
        at, seen = _find(context, windows >> np.uint64(16))
        place, found = _find(keys, windows)
        count = np.where(found, counts[place] if len(counts) else 0, 0)
        known = total[at] if len(total) else 1
        rest = kinds[at] if len(kinds) else 0
        return np.where(seen, (np.maximum(count - discount, 0) + discount * rest * lower) / np.maximum(known, 1), lower)


class Part:
    """The models of all languages behind one sorted table, for all windows or those of one part."""

    def __init__(self, models: list[KneserNey], keys: list[np.ndarray]) -> None:
        self.models = models
        self.keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        self.logs = self._logs(self.keys)

    def _logs(self, windows: np.ndarray) -> np.ndarray:
        return np.log(np.stack([m.probability(windows) for m in self.models], axis=1)).astype(np.float32) if self.models else np.zeros((len(windows), 0), np.float32)

    def sums(self, fold: Folder, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum of logarithms over all windows by text and language, windows, letters)."""
        total, n, letters = np.zeros((len(texts), len(self.models))), np.zeros(len(texts), int), np.zeros(len(texts), int)
        for a, b in _chunks(texts):
            keys, start, letters[a:b] = fold(texts[a:b])
            n[a:b] = np.diff(start)
            at, found = _find(self.keys, keys)
            logs = self.logs[at] if len(self.keys) else np.zeros((len(keys), len(self.models)), np.float32)
            missing = np.flatnonzero(~found)
            if len(missing):
                new, back = np.unique(keys[missing], return_inverse=True)
                logs[missing] = self._logs(new)[back]
            run = np.concatenate([np.zeros((1, len(self.models))), np.cumsum(logs, axis=0, dtype=np.float64)])
            total[a:b] = run[start[1:]] - run[start[:-1]]
        return total, n, letters

    def of_windows(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logarithms of the different windows by language, which of these each window is)."""
        new, back = np.unique(windows, return_inverse=True)
        at, found = _find(self.keys, new)
        logs = self.logs[at] if len(self.keys) else np.zeros((len(new), len(self.models)), np.float32)
        missing = np.flatnonzero(~found)
        if len(missing):
            logs[missing] = self._logs(new[missing])
        return logs, back


def mean_entropy(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    return -sums / np.maximum(n, 1)[:, None]


@dataclass
class Parts:
    """Counts that stay a table: (lang, gram, n) of orders ORDER and ORDER - 1, and what all parts share."""

    of: int
    top: DataFrame
    next: DataFrame
    names: list[str]
    low: dict[int, dict]
    discounts: dict[str, dict[int, float]]
    alphabet: int

    def part(self, counts: pa.Table) -> Part:
        """The models of the part with these counts (order, lang, gram, n)."""
        def of(order: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
            return _by_lang_of(counts.filter(pc.equal(counts.column("order"), order)))

        top, following = of(ORDER), of(ORDER - 1)
        lower = lambda x: {3: following.get(x, _NO_COUNTS), 2: self.low[2][x], 1: self.low[1][x]}
        models = [KneserNey(*top.get(x, _NO_COUNTS), self.alphabet, lower(x), self.discounts[x]) for x in self.names]
        return Part(models, [k for k, _ in top.values()])


class Identifier:
    """The languages, their models behind one table or in parts, and the limits of rejection."""

    def __init__(self, langs: list[str], model: Part | Parts | None) -> None:
        self.langs, self.model = langs, model
        self.limits = np.full((len(langs), 2), np.inf)

    def entropies(self, fold: Folder, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean cross-entropy by text and language, windows, letters), of a model behind one table."""
        sums, n, letters = self.model.sums(fold, texts)
        return mean_entropy(sums, n), n, letters

    def predict(self, fold: Folder, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        return self.verdicts(*self.entropies(fold, texts))

    def verdicts(self, mean: np.ndarray, n: np.ndarray, letters: np.ndarray) -> list[tuple[str, float, float | None, bool]]:
        out = []
        for row, size, some in zip(mean, n, letters, strict=True):
            if not some or not self.langs:
                out.append((UNDEFINED, 0.0, None, True))
                continue
            best = int(np.argmin(row))
            weight = np.exp(-(row - row[best]) * min(size, EVIDENCE))
            level, spread = self.limits[best]
            out.append((self.langs[best], float(1 / weight.sum()), float(row[best]), bool(row[best] > level + spread / np.sqrt(size))))
        return out

    def calibrate(self, mean: np.ndarray, n: np.ndarray, letters: np.ndarray, langs: list[str]) -> None:
        """Limits so that a share REJECT of each language's own texts is rejected: level + spread / sqrt(length)."""
        for i, lang in enumerate(self.langs):
            own = [k for k, x in enumerate(langs) if x == lang and letters[k]]
            if len(own) < 20:
                continue
            ce, size = mean[own, i], np.sqrt(n[own])
            level = np.average(ce, weights=n[own])
            self.limits[i] = level, max(np.quantile((ce - level) * size, 1 - REJECT), 0.0) + 1e-9


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _calibrates(doc_id: Column) -> Column:
    """A twentieth of the documents may be kept from the counts, so that rejection is calibrated on unseen texts."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 20 == 1, F.lit(False))


def _split(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts to count, texts to calibrate on): of each language the first CALIBRATION_DOCS documents by hash among
    those that may be kept; all others are counted."""
    ids = known.filter(_calibrates(F.col("doc_id"))).groupBy("lang", "doc_id").agg(F.max(F.length("text")).alias("chars")).filter(F.col("chars") <= CALIBRATION_CHARS).drop("chars")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = written(ids.withColumn("place", place).filter(F.col("place") <= CALIBRATION_DOCS).drop("place"), "langid-calibration")
    return known.join(F.broadcast(picked), ["lang", "doc_id"], "left_anti"), known.join(F.broadcast(picked), ["lang", "doc_id"], "left_semi").dropDuplicates(["lang", "doc_id", "text"])


def train(docs: DataFrame) -> Identifier:
    """Models from text and lang of the documents that are not held out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counted, calibrating = _split(known)
    grams = written(count_windows(counted), "langid-windows")
    of = max(1, math.ceil(grams.count() / MAX_GRAMS))
    if of == 1:
        counts = _by_lang(grams)
        chars = [np.unique(k & np.uint64(0xFFFF)) for k, _ in counts.values()]
        alphabet = 1 + len(np.unique(np.concatenate(chars))) if chars else 1
        model = Identifier(list(counts), Part([KneserNey(*c, alphabet) for c in counts.values()], [k for k, _ in counts.values()]))
        some = calibrating.select("lang", "text").toArrow()
        model.calibrate(*model.entropies(Folder(), some.column("text").to_pylist()), some.column("lang").to_pylist())
        return model
    levels = {ORDER: grams}
    for n in range(ORDER - 1, 0, -1):
        lower = F.col("gram").bitwiseAND(F.lit((1 << 16 * n) - 1)).alias("gram")
        levels[n] = written(levels[n + 1].groupBy("lang", lower).agg(F.count(F.lit(1)).alias("n")), "langid-windows")
    discounts: dict[str, dict[int, float]] = {}
    for n, table in levels.items():
        for r in table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect():
            discounts.setdefault(r.lang, {})[n] = _discount(r.ones, r.twos)
    names = sorted(discounts)
    alphabet = 1 + levels[1].select("gram").distinct().count()
    parts = Parts(of, levels[ORDER], levels[ORDER - 1], names, {n: _by_lang(levels[n]) for n in (1, 2)}, discounts, alphabet)
    model = Identifier(names, parts)
    scored = _sums_by_parts(calibrating.select(F.col("lang").alias("key"), "text"), parts, by_text=True).toArrow()
    sums = np.array(scored.column("sums").to_pylist(), float).reshape(len(scored), len(names))
    n, letters = (scored.column(c).to_numpy() for c in ("n", "letters"))
    model.calibrate(mean_entropy(sums, n), n, letters, scored.column("key").to_pylist())
    return model


def _by_lang(grams: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and counts by language, in the order of the languages."""
    return _by_lang_of(grams.select("lang", "gram", "n").toArrow())


def _by_lang_of(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    table = table.sort_by("lang")
    names = table.column("lang").combine_chunks().dictionary_encode() if len(table) else None
    if names is None:
        return {}
    codes = np.concatenate([c.indices.to_numpy() for c in getattr(names, "chunks", [names])])
    langs = (names.chunk(0) if hasattr(names, "chunks") else names).dictionary.to_pylist()
    keys, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    return {lang: _sum_by_key(keys[codes == i], n[codes == i]) for i, lang in sorted(enumerate(langs), key=lambda x: x[1])}


_OUT = "held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"


def _verdict_batch(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """docs (doc_id, text) to doc_id, held_out, lang_pred, score, cross_entropy, rejected."""
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_OUT}"
    held_out = is_held_out(F.col("doc_id")).alias("held_out")
    if isinstance(model.model, Parts):
        return _identify_by_parts(docs, model, held_out, out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_GRAMS windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, own = Folder(), shared.value
        for batch in batches:
            yield _verdict_batch(batch, own.predict(fold, batch.column(2).to_pylist()))

    return docs.select("doc_id", held_out, "text").mapInArrow(run, out)


def _part_windows(texts: DataFrame, of: int, groups: int) -> DataFrame:
    """texts (id, text) to a row for each text and part that has windows of it: part, salt, id, windows (their bytes),
    times (of each), n and letters (of the text). A text without windows has a row in part 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Folder()
        for batch in batches:
            ids, said = batch.column(0), batch.column(1).to_pylist()
            for a, b in _chunks(said):
                keys, start, letters = fold(said[a:b])
                own, part, at, windows, times = [], [], [], [], []
                for i in range(b - a):
                    mine, counts = np.unique(keys[start[i] : start[i + 1]], return_counts=True)
                    parts = _part_of(mine, of)
                    order = np.argsort(parts, kind="stable")
                    cuts = np.searchsorted(parts[order], np.arange(of + 1))
                    for p in range(of):
                        if cuts[p] < cuts[p + 1] or (p == 0 and not len(mine)):
                            chosen = order[cuts[p] : cuts[p + 1]]
                            own.append(a + i)
                            part.append(p)
                            at.append(i)
                            windows.append(mine[chosen].tobytes())
                            times.append(counts[chosen].astype(np.int64).tobytes())
                n = np.diff(start)[at]
                columns = [pa.array(part, pa.int32()), ids.take(pa.array(own, pa.int64())), pa.array(windows, pa.binary()), pa.array(times, pa.binary()), pa.array(n.astype(np.int64)), pa.array(letters[at].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "id", "windows", "times", "n", "letters"])

    spread = texts.select("id", "text").mapInArrow(run, "part int, id long, windows binary, times binary, n long, letters long")
    return spread.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))


def _sums_by_parts(docs: DataFrame, parts: Parts, by_text: bool = False) -> DataFrame:
    """docs (key, text) to key, sums (of logarithms, by language), n, letters. Rows with equal key and text are one, or
    with by_text every row stays; only windows and sums are shuffled."""
    rows = docs.withColumn("id", F.monotonically_increasing_id() if by_text else F.xxhash64("key", "text"))
    if by_text:
        rows = written(rows, "langid-texts")
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    groups = max(1, math.ceil(chars / (parts.of * GROUP_CHARS)))
    spread = _part_windows(rows, parts.of, groups)
    order = lambda table, n: table.select(_part_column(F.col("gram"), parts.of).cast("int").alias("part"), F.lit(n).alias("order"), "lang", "gram", "n")
    counts = order(parts.top, ORDER).unionByName(order(parts.next, ORDER - 1))
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    shared = rows.sparkSession.sparkContext.broadcast((parts.of, parts.names, parts.low, parts.discounts, parts.alphabet))  # bounded by the alphabet

    def score(texts: pa.Table, counts: pa.Table) -> pa.Table:
        of, *rest = shared.value
        own = Parts(of, None, None, *rest).part(counts)
        windows, times = (np.frombuffer(b"".join(texts.column(c).to_pylist()), t) for c, t in (("windows", np.uint64), ("times", np.int64)))
        ends = np.cumsum(np.array([len(x) // 8 for x in texts.column("windows").to_pylist()], np.int64))
        (logs, back), sums = own.of_windows(windows), np.zeros((len(ends), len(rest[0])))
        for j in range(sums.shape[1]):
            run = np.append(0.0, np.cumsum(logs[back, j] * times))
            sums[:, j] = run[ends] - run[np.append(0, ends)[:-1]]
        return pa.Table.from_arrays([texts.column("part"), texts.column("id"), pa.array(list(sums), pa.list_(pa.float64())), texts.column("n"), texts.column("letters")], names=["part", "id", "sums", "n", "letters"])

    scored = spread.groupBy("part", "salt").cogroup(counts.groupBy("part", "salt")).applyInArrow(score, "part int, id long, sums array<double>, n long, letters long")
    total = F.array(*[F.sum(F.col("sums")[i]) for i in range(len(parts.names))]).alias("sums")
    found = scored.dropDuplicates(["id", "part"]).groupBy("id").agg(total, F.max("n").alias("n"), F.max("letters").alias("letters"))
    return rows.select("id", "key").join(found, "id").select("key", "sums", "n", "letters") if by_text else found


def _identify_by_parts(docs: DataFrame, model: Identifier, held_out: Column, out: str) -> DataFrame:
    """Rows that agree in doc_id and text are scored once."""
    key = F.xxhash64("doc_id", "text").alias("id")
    final = Identifier(model.langs, None)
    final.limits = model.limits

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, letters = (batch.column(i).to_numpy() for i in (3, 4))
            sums = np.array(batch.column(2).to_pylist(), float).reshape(len(n), len(final.langs))
            yield _verdict_batch(batch, final.verdicts(mean_entropy(sums, n), n, letters))

    found = _sums_by_parts(docs.select(F.col("doc_id").alias("key"), "text"), model.model)
    return docs.select("doc_id", held_out, key).join(found, "id").select("doc_id", "held_out", "sums", "n", "letters").mapInArrow(finish, out)
