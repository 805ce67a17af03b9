"""Chunkers as table-generating operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.rows import bound
from lexmill.functions.text import trim_blanks, windows_of

SIZE, OVERLAP = 1500, 250


def chunk_array(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows that begin every size - overlap characters, up to the first that reaches the end; none for an empty text.
    The text is cut once, into steps; a window is its step and the beginning of what follows."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    step, n = size - overlap, F.length(text)
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / step)).cast("int")
    following = -(-overlap // step)

    def window(parts: Column, k: Column) -> Column:
        if not overlap:
            return F.get(parts, k)
        return F.concat(F.get(parts, k), F.substring(F.array_join(F.slice(parts, k + 2, F.lit(following)), ""), 1, overlap))

    some = bound(windows_of(text, step), lambda parts: F.transform(F.sequence(F.lit(0), count - 1), lambda k: window(parts, k)))
    return F.when(n > 0, some).otherwise(F.array().cast("array<string>"))


def chunks(docs: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """docs without text, one row for each window: chunk_idx, chunk."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(chunk_array(F.col(text), size, overlap)).alias("chunk_idx", "chunk"))


def lenient_chunks(docs: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """As chunks; overlap is clamped, and size 0 or less gives the whole text."""
    rest = [c for c in docs.columns if c != text]
    if size <= 0:
        return docs.select(*rest, F.lit(0).alias("chunk_idx"), F.col(text).alias("chunk"))
    return chunks(docs, text, size, min(max(overlap, 0), size - 1))


def _tail(piece: Column, overlap: int) -> Column:
    """The last `overlap` characters, from the next word start on."""
    tail = F.substring(piece, -overlap, overlap) if overlap else F.lit("")
    return F.when(F.length(piece) <= overlap, piece).otherwise(F.regexp_replace(tail, r"^\S*\s+", ""))


def smart_chunk_array(text: Column, size: int, overlap: int) -> Column:
    """Paragraphs packed greedily; on overflow the chunk is closed and its word-aligned tail carried on. Chunks of more
    than twice the size are cut into windows."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def step(state: Column, part: Column) -> Column:
        grown = F.when(state["open"] == "", part).otherwise(F.concat(state["open"], F.lit("\n\n"), part))
        fits = (state["open"] == "") | (F.length(grown) <= size)
        carried = _tail(state["open"], overlap)
        reopened = F.when(carried == "", part).otherwise(F.concat(carried, F.lit("\n\n"), part))
        closed = F.concat(state["out"], F.array(state["open"]))
        return F.when(fits, F.struct(state["out"].alias("out"), grown.alias("open"))).otherwise(F.struct(closed.alias("out"), reopened.alias("open")))

    packed = F.aggregate(parts, start, step, lambda s: F.when(s["open"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["open"]))))
    split = F.transform(packed, lambda c: F.when(F.length(c) > 2 * size, chunk_array(c, size, min(overlap, size - 1))).otherwise(F.array(c)))
    return F.flatten(split)


def chunk_size_for(context: Column, prompt_chars: Column, profile_size: int) -> Column:
    """Characters for a chunk in a context of so many tokens; the profile's size without a known context."""
    reserve = F.greatest(F.lit(512.0), 0.22 * context)
    room = F.greatest(F.lit(256.0), context - reserve - F.ceil(prompt_chars / 4) - 96) * 4
    return F.when(context.isNull(), F.lit(profile_size)).otherwise(F.greatest(F.lit(500), F.least(F.lit(profile_size), room.cast("int"))))


def structured_chunk_array(blocks: Column, most: int) -> Column:
    """blocks (array of struct page int, type string, text string, in document order) to chunks of at most `most`
    characters. Blocks are taken by page, those without a page last. Each begins a line, headings and tables with a
    mark, and names its page where that changes; closing a chunk forgets the page. A longer block is cut hard and does
    not close the open chunk."""
    rest = F.coalesce(blocks, F.array().cast("array<struct<page:int,type:string,text:string>>"))
    placed = F.transform(rest, lambda b, i: F.struct(b["page"].isNull().alias("late"), b["page"].alias("page"), i.alias("i"), b["type"].alias("type"), trim_blanks(b["text"]).alias("text")))
    ordered = F.filter(F.array_sort(placed), lambda b: b["text"] != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"), F.lit(None).cast("int").alias("last"))

    def closed(out: Column, text: Column) -> Column:
        return F.when(trim_blanks(text) == "", out).otherwise(F.concat(out, F.array(trim_blanks(text))))

    def step(s: Column, b: Column) -> Column:
        names = b["page"].isNotNull() & ~b["page"].eqNullSafe(s["last"])
        prefix = F.when(names, F.concat(F.lit("[strana "), b["page"].cast("string"), F.lit("] "))).otherwise(F.lit(""))
        kind = F.coalesce(b["type"], F.lit(""))
        mark = F.when(kind.contains("heading") | (kind == "title"), F.lit("\n## ")).when(kind.contains("table"), F.lit("\n[TABULKA] ")).otherwise(F.lit("\n"))

        def with_piece(piece: Column) -> Column:
            full = (s["open"] != "") & (F.length(s["open"]) + F.length(piece) > most)
            out = F.when(full, closed(s["out"], s["open"])).otherwise(s["out"])
            open_ = F.when(full, F.lit("")).otherwise(s["open"])
            last = F.when(full, F.lit(None).cast("int")).when(names, b["page"]).otherwise(s["last"])
            long = F.length(piece) > most
            cut = F.filter(F.transform(chunk_array(piece, most, 0), lambda x: trim_blanks(x)), lambda x: x != "")
            return F.struct(F.when(long, F.concat(out, cut)).otherwise(out).alias("out"), F.when(long, open_).otherwise(F.concat(open_, piece)).alias("open"), last.alias("last"))

        return bound(F.concat(mark, prefix, b["text"]), with_piece)

    return F.aggregate(ordered, start, step, lambda s: closed(s["out"], s["open"]))


def page_batches(pages: Column, size: int) -> Column:
    """Pages in consecutive groups, for models that see several at once."""
    n = F.ceil(F.size(pages) / size).cast("int")
    return F.when(F.size(pages) > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.slice(pages, k * size + 1, F.lit(size)))).otherwise(F.array())
