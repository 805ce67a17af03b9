"""Boilerplate removal: frequent headers and footers, and line classifiers.

Everything about one document happens inside its row, over arrays, so cleaning needs no shuffle once pages are
together. Pages are an array of strings, in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.rows import bound
from lexmill.functions.text import BETWEEN_PAGES, PAGE_BREAK, has_usable_text, is_boilerplate, lines_of, nfc, normalize_whitespace

EDGE_LINES = 6
SHARE = 0.45


def collect_pages(rows: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """One row for each document with its pages in order."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(page), F.coalesce(F.col(text), F.lit("")).alias("text"))))
    return rows.groupBy(doc).agg(F.transform(ordered, lambda p: p["text"]).alias("pages"))


def _frequent(lines: Column, least: Column) -> Column:
    """The different lines that stand there `least` times or more: in the sorted array, the line so many places before
    the last of its run is the same."""

    def of(ordered: Column) -> Column:
        marked = F.transform(ordered, lambda x, i: F.when((F.get(ordered, i + 1) == x).isNull() | (F.get(ordered, i + 1) != x), F.when((i + 1 >= least) & (F.get(ordered, i + 1 - least) == x), x)))
        return F.filter(marked, lambda x: x.isNotNull())

    return bound(F.array_sort(lines), of)


def _repeated(lines: Column) -> Column:
    low = lambda page: F.transform(page, F.lower)
    least = F.greatest(F.lit(2), F.floor(F.size(lines) * SHARE).cast("int"))
    heads = F.flatten(F.transform(lines, lambda x: low(F.slice(x, 1, EDGE_LINES))))
    tails = F.flatten(F.transform(lines, lambda x: low(F.slice(x, F.greatest(F.size(x) - EDGE_LINES + 1, F.lit(1)), F.lit(EDGE_LINES)))))
    return F.array_union(_frequent(heads, least), _frequent(tails, least))


def repeated_lines(pages: Column) -> Column:
    """Lower-cased lines that stand often enough among the first or among the last six lines of the pages."""
    return bound(F.transform(pages, lines_of), _repeated)


def clean_pages(docs: DataFrame, pages: str = "pages") -> DataFrame:
    """docs with cleaned_pages (array) and cleaned_text (pages joined by a blank line)."""

    def kept(lines: Column, repeated: Column) -> Column:
        good = F.filter(lines, lambda x: ~F.array_contains(repeated, F.lower(x)) & ~is_boilerplate(x))
        return F.array_join(good, "\n")

    def cleaned(lines: Column) -> Column:
        return bound(_repeated(lines), lambda repeated: F.transform(lines, lambda page: kept(page, repeated)))

    out = docs.withColumn("cleaned_pages", bound(F.transform(F.col(pages), lines_of), cleaned))
    return out.withColumn("cleaned_text", F.array_join("cleaned_pages", "\n\n"))


def _without(rows: Column, marks: Column) -> Column:
    """rows from the first one on that is no mark."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(s: Column, x: Column) -> Column:
        on = s["on"] & F.array_contains(marks, x)
        return F.struct((s["n"] + on.cast("int")).alias("n"), on.alias("on"))

    return F.slice(rows, F.aggregate(rows, start, step, lambda s: s["n"]) + 1, F.size(rows))


def strip_edges(pages: Column, edge: int = 3) -> Column:
    """The older rule, page by page: lines that stand at the same place from the top (or the bottom) of at least half
    of the pages, and of two, are marks. Marks at the top go from all pages but the first, marks at the bottom from all,
    as long as the outermost line is one."""

    def marks(lines: Column) -> Column:
        least = F.greatest(F.lit(2), F.floor(F.size(lines) / 2).cast("int"))

        def at(place: int) -> Column:
            def line(page: Column) -> Column:
                return F.get(page, F.lit(place))

            return _frequent(F.filter(F.transform(lines, line), lambda x: x.isNotNull() & (x != "")), least)

        return F.array_distinct(F.flatten(F.array(*[at(k) for k in range(edge)])))

    def stripped(lines: Column, tops: Column, bottoms: Column) -> Column:
        def page(rows: Column, i: Column) -> Column:
            below = F.when(i > 0, _without(rows, tops)).otherwise(rows)
            return F.array_join(F.reverse(_without(F.reverse(below), bottoms)), "\n")

        return F.transform(lines, page)

    lines = F.transform(pages, lambda p: F.transform(F.split(p, "\n"), lambda x: F.trim(x)))
    upside = lambda x: F.transform(x, F.reverse)
    return bound(lines, lambda x: bound(marks(x), lambda tops: bound(marks(upside(x)), lambda bottoms: stripped(x, tops, bottoms))))


def preprocess(text: Column, dedup_headers: bool, normalize: bool) -> Column:
    """A document with page breaks to its text by a profile's switches."""
    text = nfc(text) if normalize else text
    pages = F.split(text, r"\[\[PAGE_BREAK\]\]")
    stripped = F.filter(F.transform(strip_edges(pages), lambda x: F.trim(x)), lambda p: p != "")
    joined = F.when(F.size(pages) < 2, text).otherwise(F.array_join(stripped, "\n\n")) if dedup_headers else F.replace(text, F.lit(PAGE_BREAK), F.lit("\n\n"))
    return normalize_whitespace(joined) if normalize else joined


def text_or_fallback(primary: DataFrame, fallback: DataFrame, least: int = 8) -> DataFrame:
    """(doc, page, text) twice: each page from primary if it has enough characters, else from fallback if that has
    the page, else from primary."""
    a, b = primary.select("doc", "page", F.col("text").alias("a")), fallback.select("doc", "page", F.col("text").alias("b"))
    good = F.length(F.trim(F.coalesce("a", F.lit("")))) >= least
    return a.join(b, ["doc", "page"], "full_outer").select("doc", "page", F.when(good, F.col("a")).otherwise(F.coalesce("b", "a", F.lit(""))).alias("text"))


def with_ocr_fallback(primary: DataFrame, run_fallback: Callable[[DataFrame], DataFrame], least: int = 8) -> DataFrame:
    """(doc, page, text) from primary; files of which any page has too few characters go through the fallback as a
    whole, and then each page is picked as in text_or_fallback."""
    short = F.length(F.trim(F.coalesce("text", F.lit("")))) < least
    weak = primary.groupBy("doc").agg(F.max(short).alias("weak")).filter("weak").select("doc")
    picked = text_or_fallback(primary.join(weak, "doc", "left_semi"), run_fallback(weak), least)
    return primary.join(weak, "doc", "left_anti").select("doc", "page", "text").unionByName(picked)


def layer_or_ocr_by_page(pages: DataFrame, least_usable: Callable[[Column], Column] = has_usable_text) -> DataFrame:
    """(doc, page, layer, ocr) to (doc, text): of each page the text layer if it is usable, else what OCR read; pages
    joined by the mark of a page break."""
    text = F.when(least_usable(F.col("layer")), F.col("layer")).otherwise(F.coalesce("ocr", "layer", F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct("page", text.alias("text"))))
    return pages.groupBy("doc").agg(F.array_join(F.transform(listed, lambda p: p["text"]), BETWEEN_PAGES).alias("text"))
