"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into words at places that no piece of the vocabulary can cross, so words can be encoded one by one:

1. The substrings of each distinct word, of up to `KEY_CHARS` characters, are exploded and equi-joined to the piece
   table (broadcast; its size is that of the vocabulary) by the pieces' first characters; longer pieces are compared in
   full where their beginning matches. Matches are the edges of the word's lattice; a character without a piece keeps an
   edge of its own, which becomes its UTF-8 bytes.
2. Edges are grouped by word. Since the rows of a word never leave the partition the word came from, that grouping
   needs no shuffle.
3. A Spark `aggregate` folds the edges. For a unigram model it is Viterbi's forward pass: the best score at each place
   in the word. A BPE model has no scores to add up, its best path is the one its merges lead to; there the fold takes
   the edges by merge rank, and the state is the set of open places between symbols as the bits of a long. An edge
   merges if its ends are open and exactly one place is open between them. Words whose places do not fit into a long,
   and runs of blanks, whose merges tie in rank, are folded over the same edges by a pandas function with a heap.

Which words come first is a matter of cost alone, every word gets the ids of its lattice: the commonest words of
`SAMPLE_DOCS` documents, chosen by hash, at most `FREQUENT` of them, are encoded first and broadcast. All other words of
all documents are encoded in a second run, once each, and go to the blocks of `BLOCK_ROWS` documents that hold them.
Texts are shuffled once, compressed by runs of rows, to meet them there; a task holds one such run, of bounded bytes, and the
different uncommon words of one block. Nothing that grows with the corpus is broadcast or
collected, except one row for each file of the input. Cuts are made in Arrow, and words are numbered there, so a batch
of texts costs Python one step for each distinct word.

A word is one row of its lattice, of some 300 bytes a character, so a text may hold no run of over about 5,000,000
characters without a place to cut at (a blank, or a change between letters and signs, as the vocabulary has it); Spark ends
the query there, since its rows end at 2 GB.

Rows come out in the order of the input: by file (Spark's part numbers first, then names) and row. Input that is not read
from Parquet files is written first. Null and empty texts have no tokens. Blanks are kept as they are. Equal rows are
encoded each. An empty table gives an empty one. Input columns may have any other names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import bound, drop_path, free_name, written, written_at

BLANK = "▁"
FREQUENT = 1 << 19
UNIGRAM, BPE = 1, 2
MASK_PLACES = 62
UNKNOWN_PENALTY = 10.0
SAMPLE_DOCS = 1 << 15
#: Rows, one after another in the input, whose uncommon words are brought together.
BLOCK_ROWS = 512
_WINDOW = 64
_LATTICE_PARTS = 4
#: Characters by which pieces are joined to a word's substrings; most places of a word begin no longer piece.
KEY_CHARS = 4
#: Characters that may part words while a batch is cut; one is taken that no text of the batch holds.
_PARTINGS = ("\x00", *map(chr, range(0xFDD0, 0xFDF0)))
_BYTES_AT_ONCE = 1 << 21
#: Groups that an aggregation with arrays keeps in memory before it sorts its input.
_GROUPS_IN_MEMORY = 1 << 17
#: Rows of the table of files up to which it is broadcast.
_BROADCAST_FILES = 1 << 16


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message; lengths and varints only are decoded."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class Vocabulary:
    """The pieces of a model file, and where words can be cut."""

    def __init__(self, raw: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model_type, self.dummy_prefix, self.squeeze, charsmap, own_type = UNIGRAM, True, True, b"", None
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(int(piece.get(3, 1)))
            elif number == 2:
                own_type = dict(_fields(value)).get(3)
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, self.dummy_prefix, self.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.model_type = own_type or UNIGRAM
        if charsmap or self.model_type not in (UNIGRAM, BPE):
            raise NotImplementedError("only unigram and BPE models without a character map")
        self.width, self.stored = (2, ">u2") if len(self.pieces) <= 1 << 16 else (4, ">u4")
        self.normal = [i for i, k in enumerate(self.kinds) if k in (1, 4)]
        self.bytes_from = next((i for i, p in enumerate(self.pieces) if self.kinds[i] == 6 and p == "<0x00>"), None)
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == 2), 0)
        by_score = {s: r for r, s in enumerate(sorted({self.scores[i] for i in self.normal}, reverse=True))}
        self.table = [(self.pieces[i], i, by_score[self.scores[i]], self.scores[i]) for i in self.normal]
        self.longest = max((len(p) for p, *_ in self.table), default=1)
        self.least = min((s for *_, s in self.table), default=0.0)
        pairs = {(p[k], p[k + 1]) for p, *_ in self.table for k in range(len(p) - 1)}
        if any(b == BLANK and a != BLANK for a, b in pairs):
            raise NotImplementedError("pieces that cross the start of a word")
        line = "\n" not in {c for pair in pairs for c in pair}
        tied = {b for a, b in pairs if a.isalpha()}
        # Signs that no piece has behind a letter end a word there.
        apart = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "_" and c not in tied)
        stop = r"\n" if line else ""
        ahead = f"(?![{re.escape(apart)}])" if apart else ""
        # The same for texts at once: behind a character that no piece has before such a sign.
        holding = "".join(sorted({a for a, b in pairs if b in apart and ord(a) > 127} | {BLANK}))
        self.signs = rf"([A-Za-z]|[^\x00-\x7f{re.escape(holding)}])([{re.escape(apart)}])" if apart else ""
        self.cuts_lines = line
        self.pattern = ("\\n|" if line else "") + rf"{BLANK}*+(?:[^\W\d_]++{ahead}|(?:(?![{BLANK}{stop}])[\W\d_])++)*+(?:[^\W\d_]++)?+"

    def normalised(self, text: str | None) -> str:
        if not text:
            return ""
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
            if not text:
                return ""
        return (BLANK if self.dummy_prefix else "") + text.replace(" ", BLANK)

    def units(self, text: str | None) -> list[str]:
        """The words of a text; any cut that no piece crosses is as good."""
        return [w for w in self._find(self.normalised(text)) if w]

    def plain(self, texts: pa.Array) -> pa.Array:
        """The normalised texts, blanks for their marks."""
        out = pc.replace_substring(pc.fill_null(texts, ""), BLANK, " ")
        if self.squeeze:
            out = pc.utf8_trim(pc.replace_substring_regex(out, " +", " "), " ")
        return pc.if_else(pc.equal(pc.binary_length(out), 0), "", pc.binary_join_element_wise("", out, " ")) if self.dummy_prefix else out

    def cut(self, texts: pa.Array, parting: str) -> pa.Array:
        """Plain texts with `parting` between words: before blanks, around line ends, and before signs that end a word."""
        out = pc.replace_substring_regex(texts, self.signs, rf"\1{parting}\2") if self.signs else texts
        if self.cuts_lines:
            out = pc.replace_substring(out, "\n", f"{parting}\n{parting}")
        out, doubled = pc.replace_substring(out, " ", parting + BLANK), BLANK + parting + BLANK
        more = pc.any(pc.match_substring(texts, "  ")).as_py()
        while more:
            out = pc.replace_substring(out, doubled, BLANK * 2)
            more = pc.any(pc.match_substring(out, doubled)).as_py()
        return out

    @cached_property
    def _find(self):  # noqa: ANN202
        return re.compile(self.pattern).findall

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_find", "said")}

    @cached_property
    def said(self) -> pa.Array:
        """What each piece adds to a text; nothing for the bytes of longer characters, which `raw_text` puts together."""
        by_kind = {2: lambda i: " ⁇ ", 3: lambda i: "", 6: lambda i: chr(i - self.bytes_from) if i - self.bytes_from < 128 else ""}
        plain = lambda i: self.pieces[i].replace(BLANK, " ")
        return pa.array([by_kind.get(k, plain)(i) for i, k in enumerate(self.kinds)], pa.string())

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids, the blank before them included."""
        tokens, starts = ids.flatten(), ids.offsets
        out = pc.binary_join(pa.ListArray.from_arrays(pc.subtract(starts, starts[0]), self.said.take(tokens)), "")
        if self.bytes_from is None:
            return out
        flat, begin = tokens.to_numpy(), starts.to_numpy() - starts[0].as_py()
        spelled = np.flatnonzero((flat >= self.bytes_from + 128) & (flat < self.bytes_from + 256))
        if not len(spelled):
            return out
        some = np.unique(np.searchsorted(begin, spelled, "right") - 1)
        mask = np.zeros(len(ids), bool)
        mask[some] = True
        whole = [self.raw_text(flat[begin[i] : begin[i + 1]].tolist()).replace(BLANK, " ") for i in some]
        return pc.replace_with_mask(out, pa.array(mask), pa.array(whole, pa.string()))

    def raw_text(self, ids) -> str:
        """The normalised text of a sequence of ids."""
        out, pending = [], bytearray()
        for i in ids:
            if self.kinds[i] == 6:
                pending.append(i - self.bytes_from)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if self.kinds[i] != 3:
                out.append(" ⁇ " if self.kinds[i] == 2 else self.pieces[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids) -> str:
        """The text of a sequence of ids."""
        text = self.raw_text(ids).replace(BLANK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def load(path: str) -> Vocabulary:
    """A model file that the driver can read; executors get it with the functions they run."""
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def unit_codes(vocabulary: Vocabulary, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word in order, where each text's words begin): `units` for many texts at once."""
    parting = None
    if type(vocabulary).units is Vocabulary.units:
        plain = vocabulary.plain(texts)
        parting = next((c for c in _PARTINGS if not pc.any(pc.match_substring(plain, c)).as_py()), None)
    if parting is None:
        lists = [vocabulary.units(t) for t in texts.to_pylist()]
        words, starts = pa.array([u for x in lists for u in x], pa.string()), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    else:
        parts = pc.split_pattern(vocabulary.cut(plain, parting), parting)
        words, starts = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    coded = words.dictionary_encode()
    codes, empty = coded.indices.to_numpy().astype(np.int64), pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        kept = codes != empty
        codes, starts = codes[kept], np.concatenate([[0], np.cumsum(kept)])[starts]
    return coded.dictionary, codes, starts


def _keys(words: pa.Array) -> list[bytes]:
    """Words as the keys of dictionaries: their bytes take less room than strings."""
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about _BYTES_AT_ONCE of text, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + _BYTES_AT_ONCE, "right")))
        yield batch.slice(at, to - at)
        at = to


def count_words(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs (text) to (word, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 0):
                words, codes, _ = unit_codes(vocabulary, part.column(0))
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(codes, minlength=len(words)))], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").filter("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def _with_pieces(spans: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """spans (s, len, key: a substring of at most KEY_CHARS characters, rest: the word from there on) to one row for each
    piece that stands there, with its len, id, rank and score; a character without a piece keeps its row, id null."""
    names = ["piece", "id", "rank", "score"]
    table = spans.sparkSession.createDataFrame(pd.DataFrame(vocabulary.table, columns=names), "piece string, id int, rank int, score double")
    table = table.select(F.substring("piece", 1, KEY_CHARS).alias("beginning"), F.length("piece").alias("chars"), *names)
    stands = (F.col("key") == F.col("beginning")) & ((F.col("chars") < KEY_CHARS) | F.col("rest").startswith(F.col("piece")))
    found = spans.join(F.broadcast(table), stands, "left").filter("id is not null or len = 1")
    kept = [F.col(c) for c in spans.columns if c not in ("key", "rest", "len")]
    return found.select(*kept, F.coalesce("chars", "len").alias("len"), "id", "rank", "score")


def _named(words: DataFrame) -> DataFrame:
    """words with two hashes, a and b, that stand for a word of any length wherever it would be copied often."""
    return words.withColumns({"a": F.xxhash64("word"), "b": F.xxhash64(F.lit(1), "word")})


def lattice(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """words (word, n), of any length, to (a, b, n, size, edges); an edge has rank, s, e (places), id (null: no piece),
    score, char (where id is null), ends, inner. Long words are cut into windows first, so that no row has a word."""
    most = vocabulary.longest
    window = max(_WINDOW, most)
    cut = F.regexp_extract_all("word", F.lit(f"(?s).{{1,{window}}}"), F.lit(0))
    lead = lambda parts: F.transform(parts, lambda x, i: F.concat(x, F.coalesce(F.substring(F.get(parts, i + 1), 1, most), F.lit(""))))
    windows = _named(words).select("a", "b", "n", F.length("word").alias("size"), F.posexplode(bound(cut, lead)).alias("w", "part"))
    last = F.least(F.lit(window), F.col("size") - window * F.col("w")) - 1
    starts = windows.select("a", "b", "n", "size", "w", "part", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    rest = starts.select("a", "b", "n", "size", (window * F.col("w") + F.col("at")).alias("s"), F.substring("part", F.col("at") + 1, F.lit(most)).alias("rest"))
    spans = rest.select("*", F.substring("rest", 1, 1).alias("char"), F.explode(F.sequence(F.lit(1), F.least(F.lit(KEY_CHARS), F.length("rest")))).alias("len"))
    edges = _with_pieces(spans.withColumn("key", F.substring("rest", F.lit(1), F.col("len"))), vocabulary)
    # Beyond 62 places the masks mean nothing and are not used.
    bits = {"ends": "shiftleft(1L, s) | shiftleft(1L, s + len)", "inner": "try_subtract(shiftleft(1L, s + len), shiftleft(1L, s + 1))", "char": "case when id is null then char end"}
    edges = edges.select("a", "b", "n", "size", F.struct("rank", "s", (F.col("s") + F.col("len")).alias("e"), "id", "score", *[F.expr(v).alias(k) for k, v in bits.items()]).alias("edge"))
    return edges.groupBy("a", "b", "n", "size").agg(F.collect_list("edge").alias("edges"))


#: An edge of a short word as one long: rank, start, length and id, from high bits to low.
_RANK_AT, _START_AT, _LENGTH_AT, _NO_PIECE = 32, 26, 20, (1 << 20) - 1


def packed_lattice(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """words (word, n) of at most MASK_PLACES characters to (word, n, edges, chars): the same edges as longs, those of
    single characters, which merge nothing, apart."""
    if len(vocabulary.pieces) >= _NO_PIECE:
        raise NotImplementedError("vocabularies of over a million pieces")
    starts = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("s"))
    rest = starts.select("word", "n", "s", F.substring("word", F.col("s") + 1, F.lit(vocabulary.longest)).alias("rest"))
    spans = rest.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(KEY_CHARS), F.length("rest")))).alias("len"))
    edges = _with_pieces(spans.withColumn("key", F.substring("rest", F.lit(1), F.col("len"))), vocabulary)
    place = f"shiftleft(cast(s as long), {_START_AT}) | shiftleft(cast(len as long), {_LENGTH_AT}) | coalesce(id, {_NO_PIECE})"
    pair = F.expr(f"case when len > 1 then shiftleft(cast(rank as long), {_RANK_AT}) | {place} end")
    return edges.groupBy("word", "n").agg(F.collect_list(pair).alias("edges"), F.collect_list(F.expr(f"case when len = 1 then {place} end")).alias("chars"))


def _part(edge: Column, at: int, bits: int = 6) -> Column:
    return F.shiftright(edge, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _ends_and_inner(edge: Column) -> tuple[Column, Column]:
    s = _part(edge, _START_AT)
    e = s + _part(edge, _LENGTH_AT)
    return _bit(s).bitwiseOR(_bit(e)), _bit(e) - _bit(s + 1)


def fold_merges(edges: Column) -> Column:
    """The open places of a word after all merges, as the bits of a long; edges as in `packed_lattice`."""
    everything = F.expr("shiftrightunsigned(-1L, 63 - length(word))")

    def merge(places: Column, edge: Column) -> Column:
        ends, inner = _ends_and_inner(edge)
        between = places.bitwiseAND(inner)
        merges = (places.bitwiseAND(ends) == ends) & (F.bit_count(between) == 1)
        return F.when(merges, places.bitwiseXOR(between)).otherwise(places)

    return F.aggregate(F.sort_array(edges), everything, merge)


def fold_viterbi(edges: Column, size: Column, unknown_score: float) -> Column:
    """The places of the best path as the bits of a long: a forward pass over edges by start, with the best score at
    each place and the places on the way there."""
    start = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.when(i == 0, F.lit(0.0)).otherwise(F.lit(float("-inf"))).alias("score"), F.when(i == 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("way")))

    def step(best: Column, edge: Column) -> Column:
        score = F.element_at(best, edge["s"] + 1)["score"] + F.coalesce(edge["score"], F.lit(unknown_score))
        way = F.element_at(best, edge["s"] + 1)["way"].bitwiseOR(edge["ends"])
        better = F.struct(score.alias("score"), way.alias("way"))
        return F.transform(best, lambda x, i: F.when((i == edge["e"]) & (score > x["score"]), better).otherwise(x))

    by_start = F.array_sort(F.transform(edges, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["score"].alias("score"), x["ends"].alias("ends"))))
    return F.aggregate(by_start, start, step, lambda best: F.element_at(best, -1)["way"])


def merged_path(edges: list[dict], size: int) -> list[tuple[int, int]]:
    """The segments of a word of any length by the same merges, over the same edges, with a heap."""
    rank = {(x["s"], x["e"]): x["rank"] for x in edges if x["rank"] is not None}
    after, before = {i: i + 1 for i in range(size)}, {i + 1: i for i in range(size)}
    heap = [(rank[i, i + 2], i, i + 1, i + 2) for i in range(size - 1) if (i, i + 2) in rank]
    heapq.heapify(heap)
    while heap:
        _, s, mid, e = heapq.heappop(heap)
        if after.get(s) != mid or after.get(mid) != e:
            continue
        after[s], before[e] = e, s
        del after[mid], before[mid]
        if s in before and (before[s], e) in rank:
            heapq.heappush(heap, (rank[before[s], e], before[s], s, e))
        if e in after and (s, after[e]) in rank:
            heapq.heappush(heap, (rank[s, after[e]], s, e, after[e]))
    out, at = [], 0
    while at < size:
        out.append((at, after[at]))
        at = after[at]
    return out


def best_path(edges: list[dict], size: int, unknown_score: float) -> list[tuple[int, int]]:
    """The segments of the best path of a word of any length."""
    best, came = [0.0] + [float("-inf")] * size, [0] * (size + 1)
    for x in sorted(edges, key=lambda x: (x["s"], x["e"])):
        score = best[x["s"]] + (unknown_score if x["score"] is None else x["score"])
        if score > best[x["e"]]:
            best[x["e"]], came[x["e"]] = score, x["s"]
    out, at = [], size
    while at:
        out.append((came[at], at))
        at = came[at]
    return out[::-1]


def _bytes_of(char: Column, first: int) -> Column:
    """The ids of a character's UTF-8 bytes."""
    said = F.hex(char)
    return F.transform(F.sequence(F.lit(0), (F.length(said) / 2 - 1).cast("int")), lambda k: F.conv(F.substring(said, (2 * k + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + first)


def _merge_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Short words of a BPE model to (word, n, ids)."""
    folded = packed_lattice(words, vocabulary).withColumn("places", fold_merges(F.col("edges")))

    def on_path(edge: Column) -> Column:
        ends, inner = _ends_and_inner(edge)
        return (F.col("places").bitwiseAND(ends) == ends) & (F.col("places").bitwiseAND(inner) == 0)

    low = lambda edge: edge.bitwiseAND(F.lit((1 << _RANK_AT) - 1))
    path = folded.select("word", "n", F.sort_array(F.concat(F.transform(F.filter("edges", on_path), low), F.filter("chars", on_path))).alias("path"))
    ident = lambda edge: _part(edge, 0, 20)
    first = vocabulary.bytes_from

    def tokens(edge: Column) -> Column:
        char = F.substring("word", _part(edge, _START_AT) + 1, F.lit(1))
        return F.when(ident(edge) != _NO_PIECE, F.array(ident(edge))).otherwise(F.array(F.lit(vocabulary.unknown)) if first is None else _bytes_of(char, first))

    strange = F.exists("path", lambda edge: ident(edge) == _NO_PIECE)
    return path.select("word", "n", F.when(strange, F.flatten(F.transform("path", tokens))).otherwise(F.transform("path", ident)).alias("ids"))


def _fold_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Words of a unigram model, and words of any length or with runs of blanks, to (word, n, ids)."""
    unknown_score = vocabulary.least - UNKNOWN_PENALTY
    bpe = vocabulary.model_type == BPE
    grouped = lattice(words, vocabulary)
    key = ("a", "b", "n")
    segment = "struct<s:int,id:int,char:string>"

    @F.pandas_udf(f"array<{segment}>")
    def long_path(edges: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for own, size in zip(edges, sizes, strict=True):
            own = list(own)
            at = {(x["s"], x["e"]): x for x in own}
            path = merged_path(own, size) if bpe else best_path(own, size, unknown_score)
            out.append([{"s": s, "id": None if pd.isna(at[s, e]["id"]) else int(at[s, e]["id"]), "char": at[s, e]["char"]} for s, e in path])
        return pd.Series(out)

    slim = F.transform("edges", lambda x: F.struct(*[x[c].alias(c) for c in ("rank", "s", "e", "id", "score", "char")]))
    if bpe:
        paths = grouped.select(*key, long_path(slim, "size").alias("path"))
    else:
        plain = F.col("size") <= MASK_PLACES
        short = grouped.filter(plain).withColumn("places", fold_viterbi(F.col("edges"), F.col("size"), unknown_score))
        on_path = F.filter("edges", lambda x: (F.col("places").bitwiseAND(x["ends"]) == x["ends"]) & (F.col("places").bitwiseAND(x["inner"]) == 0))
        short = short.select(*key, F.array_sort(F.transform(on_path, lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id"), x["char"].alias("char")))).alias("path"))
        paths = short.unionByName(grouped.filter(~plain).select(*key, long_path(slim, "size").alias("path")))
    first = vocabulary.bytes_from

    def tokens(x: Column) -> Column:
        if first is None:
            return F.array(F.coalesce(x["id"], F.lit(vocabulary.unknown)))
        return F.when(x["id"].isNotNull(), F.array(x["id"])).otherwise(_bytes_of(x["char"], first))

    ids = paths.select("a", "b", F.flatten(F.transform("path", tokens)).alias("ids"))
    return _named(words).join(ids, ["a", "b"]).select("word", "n", "ids")


def _is_short(word: Column) -> Column:
    return (F.length(word) <= MASK_PLACES) & ~word.contains(BLANK * 2)


def encode_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """words (word, n), each word once, to (word, n, ids)."""
    if vocabulary.model_type != BPE:
        return _fold_words(words, vocabulary)
    short = _is_short(F.col("word"))
    return _merge_words(words.filter(short), vocabulary).unionByName(_fold_words(words.filter(~short), vocabulary))


def _grouped_in_memory(spark: SparkSession, action: Callable[[], object]) -> object:
    """action() while aggregations with arrays keep more groups before they sort; the setting is put back."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(_GROUPS_IN_MEMORY))
    try:
        return action()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _part_number(path: str) -> tuple:
    m = re.search(r"part-(\d+)[^/]*$", path)
    return (int(m[1]) if m else -1, path.rsplit("/", 1)[-1], path)


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, int]:
    """docs with the row number `name` (long, from 0, in the order of files and rows, with gaps where rows are filtered),
    and a number above all of them."""
    path, row = free_name("path", docs.columns), free_name("row", docs.columns)

    def with_rows(frame: DataFrame) -> DataFrame:
        meta = frame.metadataColumn("_metadata")
        return frame.select("*", meta["file_path"].alias(path), meta["row_index"].alias(row))

    try:
        rows = with_rows(docs)
    except AnalysisException:
        rows = with_rows(written(docs, "pieces-input"))
    sizes = sorted(((r[0], r[1]) for r in rows.groupBy(path).agg(F.max(row) + 1).collect()), key=lambda x: _part_number(x[0]))
    first = np.concatenate([[0], np.cumsum([n for _, n in sizes], dtype=np.int64)]).tolist()
    begin = free_name("begin", docs.columns)
    files = docs.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, first, strict=False)], f"`{path}` string, `{begin}` long")
    joined = rows.join(F.broadcast(files) if len(sizes) <= _BROADCAST_FILES else files, path)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col(begin) + F.col(row)).alias(name)), first[-1]


def _blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, word, data), sorted by at, to one compressed row for each run of equal `at`: the number of words, the lengths
    of words and ids, the words, the ids."""
    for batch in batches:
        at, words, ids = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()), batch.column(2)
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
        blobs = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            parts = [_joined_bytes(x.slice(a, b - a)) for x in (words, ids)]
            blobs.append(zlib.compress(b"".join([np.int32(b - a).tobytes(), *[n.tobytes() for n, _ in parts], *[raw for _, raw in parts]])))
        yield pa.RecordBatch.from_arrays([pa.array(at[bounds[:-1]]), pa.array([True] * len(blobs)), pa.array(blobs, pa.binary())], names=["at", "words", "data"])


def _joined_bytes(values: pa.Array) -> tuple[np.ndarray, bytes]:
    """(lengths, all bytes together) of binary values without nulls."""
    sizes = pc.binary_length(values).to_numpy().astype(np.int32)
    return sizes, b"".join(values.to_numpy(zero_copy_only=False))


def _unpacked_words(blob: bytes) -> dict[bytes, bytes]:
    raw = zlib.decompress(blob)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.int32, 2 * n, 4)) + 4 + 8 * n
    cuts = [raw[a:b] for a, b in zip([4 + 8 * n, *ends.tolist()], ends.tolist(), strict=False)]
    return dict(zip(cuts[:n], cuts[n:], strict=True))


def encode(docs: DataFrame, vocabulary: Vocabulary, frequent: int = FREQUENT, sample_docs: int = SAMPLE_DOCS, number: str | None = None) -> DataFrame:
    """docs with the columns ids (array<int>), n_tokens (long) and round_trip (boolean: decoding gives the text back,
    as far as the model's own normalisation keeps it), and before them, if `number` names it, the row's number in the
    input. Input columns of these names are replaced."""
    spark: SparkSession = docs.sparkSession
    added = ("ids", "n_tokens", "round_trip")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added and c.lower() != (number or "").lower()])
    place = number or free_name("place", kept.columns)
    rows, total = numbered(kept, place)
    numbers = [T.StructField(place, T.LongType())] if number else []
    out = T.StructType([*kept.schema.fields, *numbers, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    if not total:
        return kept.limit(0).mapInArrow(lambda batches: iter(()), out)
    known = spark.sparkContext.broadcast(_commonest(rows, vocabulary, place, min(1.0, sample_docs / total), frequent))
    texts = rows.select("text", F.col(place).alias("place"))

    def strange_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = known.value
        for batch in batches:
            for part in _slices(batch, 0):
                words, codes, starts = unit_codes(vocabulary, part.column(0))
                strange = common.find(words) < 0
                at = np.flatnonzero(strange[codes])
                block = part.column(1).to_numpy()[np.searchsorted(starts, at, "right") - 1] // BLOCK_ROWS
                first = int(block.min()) if len(at) else 0
                pairs = np.unique((block - first) * len(words) + codes[at])
                yield pa.RecordBatch.from_arrays([words.take(pa.array(pairs % max(1, len(words)))), pa.array(first + pairs // max(1, len(words)))], names=["word", "block"])

    # The words are dealt out to more partitions than other shuffles need, because each grows to a lattice before its
    # partition is done.
    parts = _LATTICE_PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spots, spots_path = written_at(texts.mapInArrow(strange_words, "word string, block long"), "pieces-spots")

    def ids_by_block(own: DataFrame, encoded: Callable[[DataFrame, Vocabulary], DataFrame]) -> DataFrame:
        """Both sides of the join read the words from one exchange. Naming what the join would ask of its left side only,
        and asking the right side for the least block, which changes nothing, keeps it the same for both."""
        own = own.filter("word is not null and block is not null").repartition(parts, "word")
        ids = encoded(own.groupBy("word").agg(F.min("block").alias("n")), vocabulary).select("word", "n", packed_ids(F.col("ids"), vocabulary).alias("data"))
        return own.join(ids, "word").filter(F.col("n") <= F.col("block")).select((2 * BLOCK_ROWS * F.col("block")).alias("at"), "word", "data")

    short = _is_short(F.col("word")) & F.lit(vocabulary.model_type == BPE)
    rare = ids_by_block(spots.filter(short), _merge_words).unionByName(ids_by_block(spots.filter(~short), _fold_words))
    rare = rare.sortWithinPartitions("at").mapInArrow(_pack_words, "at long, words boolean, data binary")
    rare = _grouped_in_memory(spark, lambda: written(rare, "pieces-rare"))
    drop_path(spark, spots_path)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text_at):
                places = part.column(place_at).to_numpy()
                steps = np.diff(places)
                # A blob is a run of ascending places of one block.
                bounds = np.concatenate([[0], np.flatnonzero((np.diff(places // BLOCK_ROWS) != 0) | (steps <= 0)) + 1, [len(places)]])
                blobs = [_blob(part.slice(a, b - a)) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(2 * places[bounds[:-1]] + 1), pa.array(blobs, pa.binary())], names=["at", "data"])

    def finished(blobs: list[bytes], own: dict[bytes, bytes]) -> Iterator[pa.RecordBatch]:
        """Rows of one block in their order. Blobs come by their first places; only those whose places overlap, as of rows
        of several files in one task, are put together."""
        whole = pa.Table.from_batches([x for b in blobs for x in pa.ipc.open_stream(b)]).combine_chunks()
        places = whole.column(place_at).to_numpy()
        whole = whole if (np.diff(places) > 0).all() else whole.take(pa.array(np.argsort(places)))
        for batch in whole.to_batches():
            for part in _slices(batch, text_at):
                texts = part.column(text_at)
                ids = _ids_of(vocabulary, texts, known.value, own)
                new = [ids, pc.cast(pc.list_value_length(ids), pa.int64()), _said_again(vocabulary, texts, ids)]
                columns = part.columns if number else [c for i, c in enumerate(part.columns) if i != place_at]
                yield pa.RecordBatch.from_arrays(columns + new, names=names)

    def last_place(blob: bytes) -> int:
        return max(x.column(place_at).to_numpy().max() for x in pa.ipc.open_stream(blob))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, last, own_block = {}, [], -1, None
        for batch in batches:
            for at, words, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                block = at // (2 * BLOCK_ROWS)
                if held and (block != own_block or at // 2 > last):
                    yield from finished(held, own)
                    held = []
                if block != own_block:
                    own, last, own_block = {}, -1, block
                if words:
                    own |= _unpacked_words(blob.as_py())
                else:
                    held.append(blob.as_py())
                    last = max(last, last_place(held[-1]))
        if held:
            yield from finished(held, own)

    # The words of a block come before its rows, by the one number `at`.
    text_at, place_at, names = rows.columns.index("text"), rows.columns.index(place), [*(rows if number else kept).columns, *added]
    met = rare.unionByName(rows.mapInArrow(pack, "at long, data binary").withColumn("words", F.lit(False)))
    bins, span = int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * BLOCK_ROWS * (total // BLOCK_ROWS + 1)
    block_begin = F.expr(f"at - at % {2 * BLOCK_ROWS}")
    return met.repartitionById(bins, F.floor(block_begin * bins / span).cast("int")).sortWithinPartitions("at").mapInArrow(finish, out)


class Known:
    """Words with their ids, as a few arrays: a Python object for each word would take ten times their room."""

    def __init__(self, words: pa.Array, ids: list[bytes], stored: str) -> None:
        self.words, self.ids = words, np.frombuffer(b"".join(ids), stored)
        self.size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.ids.itemsize
        self.begin = np.cumsum(self.size) - self.size

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word here, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()


def _commonest(rows: DataFrame, vocabulary: Vocabulary, place: str, share: float, frequent: int) -> Known:
    """The ids of at most `frequent` words, those that the sample has most often."""
    sample = rows.filter(F.pmod(F.xxhash64(F.col(place)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text")
    counts, path = written_at(count_words(sample, vocabulary), "pieces-sample")
    most, taken, least = 1 << 16, 0, 1 << 16
    for n, words in counts.groupBy(F.least("n", F.lit(most)).alias("n")).count().orderBy(F.desc("n")).collect():
        taken += words
        if taken > frequent:
            break
        least = n
    # The commonest of all, `most` times and more, are fewer than the sample's words over that number.
    chosen = counts.filter(F.col("n") >= least)
    table = _grouped_in_memory(rows.sparkSession, lambda: encode_words(chosen, vocabulary).select("word", packed_ids(F.col("ids"), vocabulary)).toArrow())
    drop_path(rows.sparkSession, path)
    return Known(table.column(0).combine_chunks(), table.column(1).to_pylist(), vocabulary.stored)


def packed_ids(ids: Column, vocabulary: Vocabulary) -> Column:
    """Ids as bytes, `width` each, the high ones first."""
    return F.unhex(F.array_join(F.transform(ids, lambda x: F.lpad(F.hex(x), 2 * vocabulary.width, "0")), ""))


def _ids_of(vocabulary: Vocabulary, texts: pa.Array, known: Known, own: dict[bytes, bytes]) -> pa.ListArray:
    words, codes, starts = unit_codes(vocabulary, texts)
    at = known.find(words)
    rest = np.flatnonzero(at < 0)
    more = Known(words.take(pa.array(rest)), [own.get(w, b"") for w in _keys(words.take(pa.array(rest)))], vocabulary.stored)
    each, begin = known.size[at] if len(known.size) else np.zeros(len(at), np.int64), known.begin[at] if len(known.size) else np.zeros(len(at), np.int64)
    each[rest], begin[rest] = more.size, more.begin + len(known.ids)
    sizes = each[codes]
    if len(sizes) and not sizes.min():
        raise RuntimeError("a text holds a word that its block has not got: the input changed between two reads")
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    tokens = np.concatenate([known.ids, more.ids])[np.repeat(begin[codes] - (ends - sizes), sizes) + np.arange(n)]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends])[starts], pa.int32()), pa.array(tokens.astype(np.int32)))


def _said_again(vocabulary: Vocabulary, texts: pa.Array, ids: pa.ListArray) -> pa.Array:
    """Whether the decoded ids are the normalised texts."""
    return pc.equal(vocabulary.decode_all(ids), vocabulary.plain(texts))


def decode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """tokens with the column decoded, the text of the column ids; null ids give null."""

    @F.pandas_udf("string")
    def said(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else vocabulary.decode([int(i) for i in x]))

    return tokens.withColumn("decoded", said("ids"))
