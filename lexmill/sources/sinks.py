"""Sinks: CSV with a mark of order, text, JSON by document, workbook. Rows are rendered in the JVM; the single-file sinks
stream them to the driver partition by partition, since one file is one writer by nature."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.jsonio import is_json, pretty_json, quoted_json
from lexmill.functions.text import csv_field, file_name, sections, stem, xml_text

CSV_COLUMNS = ("source_file", "patient_name", "patient_id", "birth_date", "admission_date", "discharge_date", "diagnoses", "medication", "lab_values", "discharge_status", "warnings", "confidence")


def unique_names(rows: DataFrame, path: str, order: str, suffix: str, tail: str = "") -> DataFrame:
    """rows with name: the file's stem and `tail`, in order, with _2, _3, ... behind where a name is taken, whatever its
    case. Names can only meet that are the same up to numbers at their end. Where no stem ends in a number, the place
    among the equal stems is the number; else the rows of such a family are gone through in order, by (order, stem)."""
    stems = rows.withColumn("__stem", F.concat(stem(F.col(path)), F.lit(tail)))
    stems = stems.withColumn("__family", F.regexp_replace(F.lower("__stem"), r"(_[0-9]+)+$", ""))
    odd = stems.filter(F.lower("__stem") != F.col("__family")).select("__family").distinct()
    place = F.row_number().over(Window.partitionBy("__family").orderBy(order))
    behind = F.when(place > 1, F.concat(F.lit("_"), place.cast("string"))).otherwise(F.lit(""))
    plain = stems.join(odd, "__family", "left_anti").withColumn("name", F.concat("__stem", behind))

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family, taken, following = None, set(), {}
        for rows in batches:
            names = []
            for own, wanted in zip(rows["__family"], rows["__stem"], strict=True):
                if own != family:
                    family, taken, following = own, set(), {}
                name, low = wanted, wanted.lower()
                while name.lower() in taken:
                    following[low] = following.get(low, 1) + 1
                    name = f"{wanted}_{following[low]}"
                taken.add(name.lower())
                names.append(name)
            yield rows.assign(name=names)

    met = stems.join(odd, "__family", "left_semi")
    dealt = met.repartition("__family").sortWithinPartitions("__family", order)
    numbered = dealt.mapInPandas(in_order, T.StructType([*met.schema.fields, T.StructField("name", T.StringType())]))
    out = plain.select(*met.columns, "name").unionByName(numbered)
    return out.withColumn("name", F.concat("name", F.lit(suffix))).drop("__stem", "__family")


def csv_line(results: DataFrame) -> Column:
    kinds = dict(results.dtypes)
    value = lambda n: F.format_string("%.4f", n) if n == "confidence" else F.array_join(n, " | ") if kinds[n].startswith("array") else F.col(n)
    return F.concat_ws(",", *[csv_field(F.coalesce(value(n), F.lit(""))) for n in CSV_COLUMNS])


def txt_block(results: DataFrame) -> Column:
    lines = [
        F.concat(F.lit("Soubor: "), "source_file"), F.concat(F.lit("Pacient: "), "patient_name"), F.concat(F.lit("ID: "), "patient_id"),
        F.concat(F.lit("Přijetí: "), "admission_date", F.lit(" | Propuštění: "), "discharge_date"),
        F.concat(F.lit("Diagnózy: "), F.array_join("diagnoses", ", ")), F.concat(F.lit("Medikace: "), F.array_join("medication", ", ")),
        F.concat(F.lit("Laboratorní hodnoty: "), F.array_join("lab_values", ", ")), F.concat(F.lit("Stav: "), "discharge_status"),
        F.concat(F.lit("Confidence: "), F.format_string("%.2f", "confidence")), F.concat(F.lit("Varování: "), F.array_join("warnings", "; ")),
        F.when(F.col("raw_response") != "", F.concat(F.lit("--- Raw odpověď modelu ---\n"), "raw_response")), F.lit("-" * 45),
    ]
    return F.concat_ws("\n", *lines)


def _streamed(rows: DataFrame, column: Column, order: str, path: str, head: str = "", between: str = "\n", end: str = "\n") -> None:
    part = path + ".part"
    with open(part, "w", encoding="utf-8", newline="") as f:
        f.write(head)
        for i, row in enumerate(rows.orderBy(order).select(column.alias("x")).toLocalIterator()):
            f.write((between if i else "") + row.x)
        f.write(end)
    os.replace(part, path)


def write_csv(results: DataFrame, path: str) -> None:
    _streamed(results, F.concat(F.lit("\n"), csv_line(results)), "source_file", path, "﻿" + ",".join(CSV_COLUMNS), "")


def write_txt(results: DataFrame, path: str) -> None:
    _streamed(results, txt_block(results), "source_file", path)


def result_json(results: DataFrame) -> Column:
    """A result as indented JSON with sorted keys, nulls included."""
    return pretty_json(F.to_json(F.struct(*sorted(results.columns)), {"ignoreNullFields": "false"}))


def write_json(results: DataFrame, path: str) -> None:
    """A JSON array of the results with sorted keys."""
    body = F.concat(F.lit("  "), F.replace(result_json(results), F.lit("\n"), F.lit("\n  ")))
    _streamed(results, body, "source_file", path, "[\n", ",\n", "\n]\n")


def write_files(rows: DataFrame, folder: str) -> None:
    """Rows (name, content) as files of a folder that all executors share; each appears whole."""
    os.makedirs(folder, exist_ok=True)

    def put(part) -> None:  # noqa: ANN001
        for row in part:
            target = f"{folder}/{row.name}"
            with open(target + ".part", "w", encoding="utf-8", newline="") as f:
                f.write(row.content)
            os.replace(target + ".part", target)

    rows.select("name", "content").foreachPartition(put)


def write_each(results: DataFrame, folder: str) -> None:
    """One JSON file for each result."""
    body = results.select("source_file", result_json(results).alias("content"))
    write_files(unique_names(body, "source_file", "source_file", ".json"), folder)


def _raw_parts(results: DataFrame) -> DataFrame:
    csv, txt = sections(F.col("raw_response"))
    rows = results.select("source_file", "raw_response").filter(F.length("raw_response") > 0)
    rows = rows.withColumns({"csv": csv, "txt": txt, "json": F.when(is_json("raw_response"), F.col("raw_response"))})
    return rows.withColumn("kind", F.when(F.col("csv").isNotNull(), F.lit("sections")).when(F.col("json").isNotNull(), F.lit("json")).otherwise(F.lit("text")))


def raw_files(results: DataFrame) -> DataFrame:
    """(name, kind, content): the raw answers as files. Two sections become a CSV with its mark of order and a text, JSON
    an indented file, anything else a text; empty answers none. The files of one answer share a free name."""
    named = unique_names(_raw_parts(results), "source_file", "source_file", "", "_raw")
    part = lambda ending, content: F.struct(F.lit(ending).alias("ending"), content.alias("content"))
    files = (
        F.when(F.col("kind") == "sections", F.array(part(".csv", F.concat(F.lit("\ufeff"), "csv")), part(".txt", F.col("txt"))))
        .when(F.col("kind") == "json", F.array(part(".json", pretty_json("json"))))
        .otherwise(F.array(part(".txt", F.col("raw_response"))))
    )
    return named.select("name", "kind", F.explode(files).alias("f")).select(F.concat("name", "f.ending").alias("name"), "kind", F.col("f.content").alias("content"))


def raw_responses(results: DataFrame) -> DataFrame:
    """(base_name, value): what raw_responses.json maps each base name to, as JSON; of equal base names the last in
    order of source_file counts."""
    value = F.when(F.col("kind") == "sections", F.to_json(F.struct("csv", "txt"))).when(F.col("kind") == "json", F.col("json")).otherwise(quoted_json("raw_response"))
    base = F.regexp_replace(file_name(F.col("source_file")), r"(?<=.)\.[^.]*$", "")
    rows = _raw_parts(results).select(base.alias("base_name"), "source_file", value.alias("value"))
    return rows.groupBy("base_name").agg(F.max_by("value", "source_file").alias("value"))


def write_raw(results: DataFrame, folder: str) -> None:
    """raw_files as files, and raw_responses.json where any answer is not empty."""
    write_files(raw_files(results), folder)
    rows = raw_responses(results)
    if not rows.isEmpty():
        entry = F.concat(F.lit("  "), quoted_json("base_name"), F.lit(" : "), F.replace(pretty_json("value"), F.lit("\n"), F.lit("\n  ")))
        _streamed(rows, entry, "base_name", f"{folder}/raw_responses.json", "{\n", ",\n", "\n}\n")


def column_letters(n: int) -> str:
    """The name of the n-th column, from 0."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def write_workbook(rows: DataFrame, columns: tuple[str, str], order: str, path: str) -> None:
    """Two columns as a workbook with shared strings in the order in which they first occur, the header in bold."""
    shared: dict[str, int] = {}
    at = lambda s: shared.setdefault(s, len(shared))
    cells = rows.orderBy(order).select(*[xml_text(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])
    lines = ['<row r="1">' + "".join(f'<c r="{column_letters(i)}1" t="s" s="1"><v>{at(c)}</v></c>' for i, c in enumerate(columns)) + "</row>"]
    for n, row in enumerate(cells.toLocalIterator(), 2):
        lines.append(f'<row r="{n}">' + "".join(f'<c r="{column_letters(i)}{n}" t="s"><v>{at(v)}</v></c>' for i, v in enumerate(row)) + "</row>")
    main, rel, head = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    package = "http://schemas.openxmlformats.org/package/2006"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="{kind}.sharedStrings+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="rId3" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}" count="{2 * len(lines)}" uniqueCount="{len(shared)}">' + "".join(f'<si><t xml:space="preserve">{s}</t></si>' for s in shared) + "</sst>",
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, head + body)


def export_all(results: DataFrame, folder: str) -> None:
    """JSON, one file each, the raw answers, text, CSV, in that order."""
    os.makedirs(folder, exist_ok=True)
    write_json(results, f"{folder}/results.json")
    write_each(results, f"{folder}/documents")
    write_raw(results, f"{folder}/raw")
    write_txt(results, f"{folder}/results.txt")
    write_csv(results, f"{folder}/results.csv")


LOG_HEADER = "timestamp | level | file | phase | message | duration_ms"


def log_line(ts: Column, level: Column, file: Column, phase: Column, message: Column, duration_ms: Column) -> Column:
    from lexmill.functions.text import log_field

    said = F.coalesce(F.round(duration_ms).cast("long").cast("string"), F.lit(""))
    return F.concat_ws(" | ", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), level, log_field(file), log_field(phase), log_field(message), said)


def append_log(rows: DataFrame, path: str) -> None:
    """Log lines (ts, level, file, phase, message, duration_ms) as a table of text files that grows; a new table begins
    with the header."""
    spark = rows.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        spark.createDataFrame([(LOG_HEADER,)], "value string").coalesce(1).write.mode("append").text(path)
    rows.select(log_line(*(F.col(c) for c in ("ts", "level", "file", "phase", "message", "duration_ms"))).alias("value")).write.mode("append").text(path)


# The columns of a batch log and what its second column may say.
BATCH_COLUMNS = ("soubor", "stav", "počet_kroků_nebo_bloků", "velikost_inputu_znaků", "jazyk", "extrakce_s", "inference_s", "zápis_s", "chyba", "čas_celkem_s", "model")
BATCH_STATUSES = (
    "START", "EXTRACTED", "SKIP", "CHUNK", "CHUNK_ERR", "DEDUP_HIT", "EMBED_ERR", "VISION", "VISION_ERR", "OK", "ERR", "VALIDATION_WARN", "RETRY_OK", "RETRY_ERR", "DEDUP_SUMMARY",
)


def batch_line(rows: DataFrame) -> Column:
    """The columns of a batch log, joined by semicolons; seconds with two digits, nulls empty."""
    seconds = {"extrakce_s", "inference_s", "zápis_s", "čas_celkem_s"}
    value = lambda n: F.format_string("%.2f", F.col(n).cast("double")) if n in seconds else F.col(n).cast("string")
    return F.concat_ws(";", *[F.when(F.col(n).isNotNull(), value(n)).otherwise(F.lit("")) for n in BATCH_COLUMNS])


def append_batch_log(rows: DataFrame, path: str) -> None:
    """Rows of BATCH_COLUMNS as a table of text files; a status that is none of BATCH_STATUSES is an error."""
    known = F.col("stav").isin(*BATCH_STATUSES)
    checked = rows.withColumn("stav", F.when(known, F.col("stav")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.coalesce("stav", F.lit("null"))))))
    checked.select(batch_line(checked).alias("value")).write.mode("append").text(path)


def write_merged(answers: DataFrame, order: str, answer: str, prompt: str, path: str) -> None:
    """All answers in one text below the prompt."""
    head = f"Prompt:\n\n{prompt.strip()}\n\n=== Odpovědi podle souborů ===\n\n"
    _streamed(answers, F.col(answer), order, path, head, "\n\n---\n\n", "")


def write_summary(text: str | None, folder: str, at: datetime) -> str | None:
    """A run's summary as the file souhrn--<time>--.txt, which appears whole; no text, no file. Returns its path."""
    if text is None:
        return None
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/souhrn--{at:%Y%m%d-%H%M%S}--.txt"
    with open(path + ".part", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".part", path)
    return path


def mirrored_path(path: Column, root: str) -> Column:
    """Where a file's answer goes: the same place below the output, with the ending .lm.txt."""
    inside = F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))).otherwise(F.element_at(F.split(path, "/"), -1))
    return F.concat(inside, F.lit(".lm.txt"))


def write_mirrored(answers: DataFrame, path: str, answer: str, root: str, folder: str) -> None:
    """Each answer in the place below `folder` that its input has below `root`."""
    os.makedirs(folder, exist_ok=True)
    rows = answers.select(mirrored_path(F.col(path), root).alias("name"), F.col(answer).alias("content"))

    def put(part) -> None:  # noqa: ANN001
        for row in part:
            target = f"{folder}/{row.name}"
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target + ".part", "w", encoding="utf-8") as f:
                f.write(row.content or "")
            os.replace(target + ".part", target)

    rows.foreachPartition(put)
