"""Sources: document folders, prompts, profiles, logs. Everything reads through Spark's own readers."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.jsonio import whole_number
from lexmill.functions.text import BETWEEN_PAGES, OTHER_TYPES, OWN_OUTPUT, PLAIN_TEXT_TYPES, extension, file_name, natural_key, trim_blanks
from lexmill.sources import office
from lexmill.sources.encodings import CODE_PAGES, code_page_of, sure_encoding_of, text_of


def visible() -> Column:
    return ~F.col("path").rlike(r"/\.[^/]*(/|$)")


def binary_files(spark: SparkSession, path: str, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """(path, file_hash, size, natural_key): files below a folder whose name matches, hidden ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).filter(visible())
    return files.select("path", F.sha2("content", 256).alias("file_hash"), F.col("length").alias("size"), natural_key(file_name(F.col("path"))).alias("natural_key"))


# What stands for the text of types that are not read.
SPREADSHEET_NOTE = "[Excel soubor detekován – pro analýzu je nutné převést jej na .csv nebo .txt. Obsah není zpracován.]"
SLIDES_NOTE = "[PowerPoint soubor detekován – pro analýzu je nutné převést prezentaci na .pdf. Obsah není zpracován.]"
UNKNOWN_NOTE = "[Nepodporovaný typ souboru: .%s]"
_FILE_TEXT = "text string, encoding string, problem string"


def file_text(kind: str, raw: bytes, pdf_pages: Callable[[bytes], list[str]] | None = None, spreadsheets: bool = False) -> tuple[str, str | None, str | None]:
    """(text, encoding, problem) of one file by its extension. A file that cannot be read has an empty text and the
    reason."""
    try:
        if kind in PLAIN_TEXT_TYPES:
            said, encoding = text_of(raw)
            return said, encoding, None if encoding else "no known encoding"
        if kind in office.EXTRACTORS:
            return office.EXTRACTORS[kind](raw), None, None
        if kind == "doc":
            return "", None, "the older word-processor format is not read"
        if kind == "pdf" and pdf_pages is not None:
            return BETWEEN_PAGES.join(pdf_pages(raw)), None, None
        if kind == "xlsx" and spreadsheets:
            return office.xlsx_text(raw), None, None
    except Exception as e:  # noqa: BLE001  a file's failure is that file's row
        return "", None, f"{e}" if isinstance(e, office.Unreadable) else f"{type(e).__name__}: {e}"
    note = SPREADSHEET_NOTE if kind in ("xlsx", "xls") else SLIDES_NOTE if kind in ("pptx", "ppt") else UNKNOWN_NOTE % kind
    return note, None, None


def text_files(spark: SparkSession, path: str, pdf_pages: Callable[[bytes], list[str]] | None = None, spreadsheets: bool = False) -> DataFrame:
    """(path, extension, text, encoding, problem): a row for each file of the supported types below a folder, own outputs
    left out, in one scan. Plain text is decoded by its detected encoding, html with its tags; word-processor files give
    their text; spreadsheets and slides a fixed note (spreadsheets=True: the cells), as does pdf without a page extractor.
    A file that cannot be read keeps its row, with the reason in `problem`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(visible())
    files = files.withColumn("extension", extension(F.col("path"))).filter(F.col("extension").isin(*PLAIN_TEXT_TYPES, *OTHER_TYPES) & ~file_name(F.col("path")).rlike(OWN_OUTPUT))

    def run(frames):  # noqa: ANN001, ANN202
        for pdf in frames:
            found = [file_text(kind, bytes(raw), pdf_pages, spreadsheets) for kind, raw in zip(pdf.extension, pdf.content, strict=True)]
            texts, encodings, problems = zip(*found, strict=True) if found else ((), (), ())
            yield pdf[["path", "extension"]].assign(text=texts, encoding=encodings, problem=problems)

    return files.select("path", "extension", "content").mapInPandas(run, f"path string, extension string, {_FILE_TEXT}")


def decoded_bytes(rows: DataFrame, content: str = "content") -> DataFrame:
    """rows with text and encoding of a binary column; null bytes give null. The rows are files of one origin: those that
    are not Unicode are counted by the code page they seem to be in, and what a file leaves open follows the others."""

    @F.pandas_udf("string")
    def seems(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: None if r is None or sure_encoding_of(bytes(r)) else code_page_of(bytes(r))).astype(object)

    @F.pandas_udf("text string, encoding string")
    def decoded(raw: pd.Series, beside: pd.Series) -> pd.DataFrame:
        found = [(None, None) if r is None else text_of(bytes(r), n) for r, n in zip(raw, beside, strict=True)]
        return pd.DataFrame(found, columns=["text", "encoding"])

    beside = rows.select(seems(content).alias("page")).agg(F.array(*[F.count_if(F.col("page") == p) for p in CODE_PAGES]).alias("__beside"))
    both = rows.crossJoin(F.broadcast(beside)).withColumn("__decoded", decoded(content, "__beside"))
    return both.select(*[c for c in rows.columns if c not in ("text", "encoding")], "__decoded.text", "__decoded.encoding")


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, content) of the markdown files below a folder."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path)
    rows = rows.select(F.input_file_name().alias("path"), F.col("value").alias("content")).filter(visible())
    return rows.select("path", F.regexp_replace(file_name(F.col("path")), r"\.md$", "").alias("title"), "content").withColumn("natural_key", natural_key(F.col("title")))


PROFILE_SCHEMA = "id string, displayName string, normalizeWhitespace boolean, deduplicatePageHeaders boolean, smartChunking boolean, embeddingSimilarityThreshold double, tokenRatio double, defaultPrompt string"


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """User profiles; unreadable files are left out, missing switches are on."""
    rows = spark.read.schema(PROFILE_SCHEMA).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path).filter("id is not null")
    defaults = {"normalizeWhitespace": True, "deduplicatePageHeaders": True, "smartChunking": True, "embeddingSimilarityThreshold": 0.93, "tokenRatio": 3.5}
    return rows.fillna(defaults)


def page_texts(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, content) to (doc, page, text) by a page extractor; files that cannot be read have no pages."""
    return extracted(files, extract).filter("page is not null").drop("problem")


def failed_files(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(doc, problem) of the files that cannot be read."""
    return extracted(files, extract).filter("problem is not null").select("doc", "problem")


def extracted(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, content) to (doc, page, text, problem): a row a page, trimmed, and one with its problem and no page for each
    file that cannot be read, so that no file vanishes. A file without pages has a row without either."""

    def run(frames):  # noqa: ANN001, ANN202
        for pdf in frames:
            rows = []
            for path, raw in zip(pdf.path, pdf.content, strict=True):
                try:
                    pages = [(path, i, (p or "").strip(), None) for i, p in enumerate(extract(bytes(raw)))]
                    rows += pages or [(path, None, None, None)]
                except Exception as e:  # noqa: BLE001  a file's failure is that file's row
                    rows.append((path, None, None, str(e) or type(e).__name__))
            out = pd.DataFrame(rows, columns=["doc", "page", "text", "problem"])
            yield out.astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, "doc string, page int, text string, problem string")


def text_layer_or_ocr(layer: DataFrame, ocr: DataFrame) -> DataFrame:
    """Documents whose pages have no text at all are taken from ocr, the others from their text layer."""
    has = layer.groupBy("doc").agg(F.max(trim_blanks(F.col("text")) != "").alias("has"))
    return layer.join(has.filter("has").select("doc"), "doc", "left_semi").unionByName(ocr.join(has.filter("has").select("doc"), "doc", "left_anti"))


# Names under which a layout extractor gives a block's text, type and page, by priority.
BLOCK_TEXT_NAMES = ("text", "content", "value", "markdown", "md")
BLOCK_TYPE_NAMES = ("type", "label", "kind", "category", "block_type")
BLOCK_PAGE_NAMES = ("page", "page_number", "pageNumber", "page_index", "pageIndex")
BLOCK_CHARS = 20_000


def _said(value: dict, names: tuple[str, ...]) -> str | None:
    """The first string under one of the names that is not blank, trimmed."""
    return next((t for n in names if isinstance(value.get(n), str) and (t := value[n].strip())), None)


def _page(value: dict) -> int | None:
    own = next((n for name in BLOCK_PAGE_NAMES if (n := whole_number(value.get(name))) is not None), None)
    return whole_number(value["bbox"].get("page")) if own is None and isinstance(value.get("bbox"), dict) else own


def blocks(text: str) -> list[tuple[int | None, str | None, str]]:
    """(page, type, text) of all objects with a text in a layout extractor's JSON, in document order, each once; types
    are lower-case. What is no JSON has no blocks."""
    try:
        todo = [json.loads(text)]
    except (ValueError, RecursionError):
        return []
    out: dict[tuple, None] = {}
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            said = _said(value, BLOCK_TEXT_NAMES)
            if said is not None and len(said) <= BLOCK_CHARS:
                kind = _said(value, BLOCK_TYPE_NAMES)
                out.setdefault((_page(value), kind and kind.lower(), said))
            value = list(value.values())
        if isinstance(value, list):
            todo += reversed(value)
    return list(out)


def block_rows(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with blocks, an array of (page, type, text), of the layout JSON in a column."""

    @F.pandas_udf("array<struct<page:int,type:string,text:string>>")
    def found(said: pd.Series) -> pd.Series:
        return said.map(lambda t: [{"page": p, "type": k, "text": x} for p, k, x in blocks(t or "")])

    return rows.withColumn("blocks", found(text))


def recognised(files: DataFrame, render: Callable[[bytes], list[bytes]], recognise: Callable[[bytes], str]) -> DataFrame:
    """(path, content) to (doc, page, text): each page is rendered to an image and read by an OCR engine or a model that
    sees images. A page that cannot be rendered (an empty image) or read has an empty text."""

    def pages(raw: bytes) -> list[str]:
        def one(image: bytes) -> str:
            try:
                return recognise(image).strip() if image else ""
            except Exception:  # noqa: BLE001  a page's failure is that page's
                return ""

        return [one(image) for image in render(raw)]

    return page_texts(files, pages)


class PromptError(Exception):
    """Why prompts cannot be read: `reason` is no_access, no_folder or no_file."""

    def __init__(self, reason: str, path: str) -> None:
        super().__init__(f"{reason}: {path}")
        self.reason = reason


def prompt_folder(spark: SparkSession, path: str) -> DataFrame:
    """prompts() of a folder, or a PromptError."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        raise PromptError("no_access", path)
    if not files.getFileStatus(target).isDirectory():
        raise PromptError("no_folder", path)
    return prompts(spark, path)


def prompt_content(spark: SparkSession, path: str) -> str:
    """The text of one prompt file, or a PromptError."""
    try:
        row = spark.read.option("wholetext", "true").text(path).first()
    except AnalysisException:
        raise PromptError("no_file", path) from None
    return row.value if row else ""
