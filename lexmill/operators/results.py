"""Result rows: the ordered merge of partial results, and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.jsonio import ARRAYS, STRINGS
from lexmill.functions.text import binary_answer

BINARY_PROMPT = r"ano/ne|ano / ne|yes/no|yes / no|pouze ano|stačí ano"


def merged_confidence(values: Column) -> Column:
    """Pairwise in order: zero takes the next value, two positive values are averaged."""
    return F.aggregate(values, F.lit(0.0), lambda a, b: F.when(a == 0, b).when(b > 0, (a + b) / 2).otherwise(a))


def merge(partials: DataFrame, doc: str, order: str) -> DataFrame:
    """One row for each document: scalars and arrays are the first that are not empty, warnings are put together,
    raw responses joined by a rule."""
    names = [n for n in STRINGS if n in partials.columns and n != doc]
    arrays = [n for n in ARRAYS if n in partials.columns and n != "warnings"]
    rest = [n for n in ("confidence", "warnings", "raw_response") if n in partials.columns]
    listed = partials.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(order, *names, *arrays, *rest))).alias("p"))
    each = lambda n: F.transform("p", lambda x: x[n])
    first = lambda n: F.coalesce(F.get(F.filter(each(n), lambda v: v != ""), F.lit(0)), F.lit("")).alias(n)
    some = lambda n: F.coalesce(F.get(F.filter(each(n), lambda v: F.size(v) > 0), F.lit(0)), F.array().cast("array<string>")).alias(n)
    more = {
        "confidence": lambda: merged_confidence(each("confidence")).alias("confidence"),
        "warnings": lambda: F.flatten(each("warnings")).alias("warnings"),
        "raw_response": lambda: F.array_join(F.filter(each("raw_response"), lambda v: v != ""), "\n---\n").alias("raw_response"),
    }
    return listed.select(doc, *[first(n) for n in names], *[some(n) for n in arrays], *[more[n]() for n in rest])


def binary_vote(responses: DataFrame, doc: str, response: str, prompt: str) -> DataFrame:
    """(doc, verdict): yes or no if the prompt asks for it and every one of several responses says so; mixed answers are
    yes if the prompt asks whether something is contained, else the majority decides, a tie for yes."""
    low = F.lower(F.lit(prompt))
    said = binary_answer(F.col(response))
    counts = responses.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.count(said).alias("parsed"), F.count_if(said).alias("yes"))
    wins = F.when(F.col("yes") == F.col("n"), F.lit(True)).when(F.col("yes") == 0, F.lit(False)).when(low.rlike("obsahuje|contains"), F.lit(True)).otherwise(2 * F.col("yes") >= F.col("n"))
    usable = (F.col("n") > 1) & (F.col("parsed") == F.col("n")) & low.rlike(BINARY_PROMPT)
    return counts.select(doc, F.when(usable, F.when(wins, F.lit("ANO")).otherwise(F.lit("NE"))).alias("verdict"))
