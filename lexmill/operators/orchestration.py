"""The older way to run a prompt over files: chunk by chunk, then one answer for each file, a second try for files that
failed, and one summary over all.

Every model stage is written before it is read, so each request is sent once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import is_cacheable, trim_blanks
from lexmill.operators import chunking, results, retrieval
from lexmill.operators.models import Chat, shrinking, split_on_overflow
from lexmill.storage import written

# What is added to the user's prompt.
CONCISE = "\n\nOdpověď napiš výstižně a stručně jako souvislý text. Nepoužívej tabulky, odrážky ani technické poznámky."
CONCISE_BELOW = 3000
FILE_SUMMARY = (
    "Na základě následujících dílčích odpovědí vytvoř jeden finální výsledek pro jeden soubor.\n\nPůvodní zadání uživatele:\n%s\n\nPožadavky:\n"
    "- vrať pouze finální odpověď, ne mezikroky a ne informace po blocích\n- nepiš technické poznámky o zpracování\n"
    "- pokud zadání vyžaduje ANO/NE, vrať pouze ANO nebo NE\n- zachovej pouze informace, které vyplývají z podkladů\n\nDílčí odpovědi:"
)
RUN_SUMMARY = (
    "Na základě následujících výsledků po jednotlivých souborech vytvoř jeden celkový souhrn celé dávky.\n\nPůvodní zadání uživatele:\n%s\n\nPožadavky:\n"
    "- napiš jeden souvislý přehled bez technických poznámek\n- neopakuj stejné informace\n- uveď jen to, co vyplývá z podkladů\n"
    "- když zadání vyžaduje ANO/NE, zachovej tento styl odpovědi\n\nVýsledky po souborech:"
)
FILE_SUMMARY_CHARS, RUN_SUMMARY_CHARS = 6000, 7000


def chunk_prompt(prompt: str, chunk_idx: Column, n_chunks: Column, chars: Column, continuation: str | None = None, concise: bool = False) -> Column:
    """The prompt of a chunk: the continuation prompt behind the first of several, with the wish for brevity if asked
    for or if the file is short."""
    base = F.lit(prompt) if continuation is None else F.when((chunk_idx > 0) & (n_chunks > 1), F.lit(continuation)).otherwise(F.lit(prompt))
    return F.concat(base, F.when(F.lit(concise) | (chars < CONCISE_BELOW), F.lit(CONCISE)).otherwise(F.lit("")))


def summary_limit(template: str, context: int | None, otherwise: int) -> int:
    """Characters of partial answers that a summary may read in a context of so many tokens."""
    if context is None:
        return otherwise
    room = context - max(512, int(context * 0.22)) - max(1, math.ceil(len(template) / 4)) - 96
    return max(256, room) * 4


def _asked(rows: DataFrame, prompt: str, text: str, make_chat: Callable[[], Chat], ask: Callable[[Chat, str, str], str | None]) -> DataFrame:
    """rows with answer and error of one request each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = make_chat()
        for pdf in frames:
            answers, errors = [], []
            for p, t in zip(pdf[prompt], pdf[text], strict=True):
                try:
                    answers.append(ask(chat, p, t))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a row's failure is that row's
                    answers.append(None)
                    errors.append(str(e))
            yield pdf.assign(answer=answers, error=errors)

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())]))


def _whole(chat: Chat, prompt: str, text: str) -> str:
    return split_on_overflow(chat, "", prompt, text)


def _summary(limit: int) -> Callable[[Chat, str, str], str | None]:
    return lambda chat, template, text: shrinking(chat, "", template, text, min(limit, len(text)))


def analyse(
    files: DataFrame, path: str, text: str, prompt: str, make_chat: Callable[[], Chat], size: int = 1000, overlap: int = 120, continuation: str | None = None, concise: bool = False, context: int | None = None,
) -> DataFrame:
    """files to (path, n_chunks, response, error): every chunk is asked about; the answers of a file are yes or no where
    the prompt wants that and all say so, one summarising answer where there are several, else as they are. Chunks that
    fail leave an error mark in their place and the file's error. Files without text are skipped."""
    rows = files.select(path, F.length(text).alias("chars"), F.posexplode(chunking.smart_chunk_array(F.col(text), size, overlap)).alias("chunk_idx", "chunk"))
    counts = rows.groupBy(path).agg(F.count(F.lit(1)).alias("n_chunks"))
    rows = rows.join(counts, path).withColumn("prompt", chunk_prompt(prompt, F.col("chunk_idx"), F.col("n_chunks"), F.col("chars"), continuation, concise))
    said = _asked(rows.select(path, "chunk_idx", "n_chunks", "prompt", "chunk"), "prompt", "chunk", make_chat, _whole)
    said = written(said.withColumn("answer", F.when(F.col("error").isNotNull(), F.concat(F.lit("[Chyba: "), "error", F.lit("]"))).otherwise(F.col("answer"))), "chunk-answers")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "answer"))), lambda x: x["answer"])
    merged = said.groupBy(path, "n_chunks").agg(F.array_join(ordered, "\n\n").alias("joined"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("chunk_idx"))).alias("error"))
    merged = merged.join(results.binary_vote(said, path, "answer", prompt), path)
    merged = merged.withColumn("alone", F.col("verdict").isNotNull() | F.col("error").isNotNull() | (F.col("n_chunks") == 1))
    done = merged.filter("alone").select(path, "n_chunks", F.coalesce("verdict", trim_blanks(F.col("joined"))).alias("response"), "error")
    template = FILE_SUMMARY % prompt
    several = merged.filter("not alone").drop("error").withColumn("prompt", F.lit(template))
    summed = written(_asked(several.select(path, "n_chunks", "prompt", "joined"), "prompt", "joined", make_chat, _summary(summary_limit(template, context, FILE_SUMMARY_CHARS))), "file-answers")
    failed = F.concat("joined", F.lit("\n\n[Chyba konsolidace: "), "error", F.lit("]"))
    summed = summed.select(path, "n_chunks", F.when(F.col("error").isNotNull(), failed).otherwise(F.coalesce("answer", "joined")).alias("response"), "error")
    return done.unionByName(summed)


def asked_by_likeness(chunks: DataFrame, group: str, key: str, embedding: str, prompt: str, text: str, make_chat: Callable[[], Chat], threshold: float) -> DataFrame:
    """chunks to (group, key, answer, error, reused): of chunks whose vectors are alike only the first is asked about, in
    order of key within a group, and the others take its answer. An answer that may not be kept (an error, or nothing)
    serves nobody else: those alike are asked about themselves."""
    placed = written(chunks.join(retrieval.leaders(chunks, group, key, embedding, threshold), [group, key]).withColumn("prompt", F.lit(prompt)), "leaders")
    columns = [group, key, "leader", "prompt", text]
    first = written(_asked(placed.filter("not hit").select(*columns), "prompt", text, make_chat, _whole), "leader-answers")
    kept = first.filter(F.col("error").isNull() & is_cacheable(F.array(trim_blanks(F.col("answer")))))
    others = placed.filter("hit").select(*columns)
    served = others.join(kept.select(group, "leader", "answer"), [group, "leader"]).select(group, key, "answer", F.lit(None).cast("string").alias("error"), F.lit(True).alias("reused"))
    again = written(_asked(others.join(kept.select(group, "leader"), [group, "leader"], "left_anti").select(*columns), "prompt", text, make_chat, _whole), "member-answers")
    own = first.unionByName(again).select(group, key, "answer", "error", F.lit(False).alias("reused"))
    return own.unionByName(served)


def retry_failed(answers: DataFrame, files: DataFrame, path: str, text: str, prompt: str, make_chat: Callable[[], Chat]) -> DataFrame:
    """answers (path, response, error, ...) with `status`. Files that failed are asked about once more, as a whole; a
    success takes the place of the first answer."""
    again = files.join(answers.filter("error is not null").select(path), path, "left_semi").filter(trim_blanks(F.coalesce(F.col(text), F.lit(""))) != "")
    second = written(_asked(again.select(path, F.lit(prompt).alias("prompt"), F.col(text).alias("whole")), "prompt", "whole", make_chat, _whole), "retried")
    joined = answers.join(second.select(path, F.col("answer").alias("__answer"), F.col("error").alias("__again"), F.lit(True).alias("__tried")), path, "left")
    good = F.col("__tried").isNotNull() & F.col("__again").isNull()
    status = F.when(good, F.lit("RETRY_OK")).when(F.col("__tried").isNotNull(), F.lit("RETRY_ERR")).when(F.col("error").isNotNull(), F.lit("ERR")).otherwise(F.lit("OK"))
    joined = joined.withColumns({"status": status, "response": F.when(good, F.col("__answer")).otherwise(F.col("response")), "error": F.when(good, F.lit(None)).otherwise(F.coalesce("__again", "error"))})
    return joined.drop("__answer", "__again", "__tried")


def run_summary(answers: DataFrame, path: str, response: str, prompt: str, make_chat: Callable[[], Chat], context: int | None = None) -> str | None:
    """One text over the answers of all files, in order of path; None where there are none or the summary fails, which
    ends nothing. As much of the answers is read as the model may see, a bounded number of characters."""
    template = RUN_SUMMARY % prompt
    limit = summary_limit(template, context, RUN_SUMMARY_CHARS)
    blocks, size = [], 0
    for row in answers.select(F.col(path).alias("p"), F.col(response).alias("r")).orderBy("p").toLocalIterator():
        blocks.append(f"Soubor: {row.p}\n\n{row.r}")
        size += len(blocks[-1]) + 2
        if size > limit:
            break
    if not blocks:
        return None
    try:
        said = shrinking(make_chat(), "", template, "\n\n".join(blocks), min(limit, size - 2))
    except Exception:  # noqa: BLE001  a summary that fails ends nothing
        return None
    return None if said is None else f"Prompt:\n\n{prompt.strip()}\n\n=== Celkový souhrn dávky ===\n\n{said}"


def analyse_pages(files: DataFrame, path: str, content: str, prompt: str, make_vision, render: Callable[[bytes], list[bytes]], batch: int = 4) -> DataFrame:  # noqa: ANN001
    """files (path, bytes) to (path, response, error): the page images of a file, some at a time, to a model that sees."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        see = make_vision()
        for pdf in frames:
            out = []
            for name, raw in zip(pdf[path], pdf[content], strict=True):
                try:
                    images = render(bytes(raw))
                    out.append((name, "\n\n".join(see("", prompt, images[i : i + batch]) for i in range(0, len(images), batch)), None if images else "no page"))
                except Exception as e:  # noqa: BLE001  a file's failure is that file's
                    out.append((name, "", str(e)))
            yield pd.DataFrame(out, columns=[path, "response", "error"])

    return files.select(path, content).mapInPandas(run, T.StructType([files.schema[path], T.StructField("response", T.StringType()), T.StructField("error", T.StringType())]))
