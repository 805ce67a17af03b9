"""The three ways to run a prompt over documents: per document, per document with retrieved context, per folder.

Every request has a key of all that the model sees. `answered` looks the keys up in a store, asks the model once for
each key that is not there, and writes what it said before anything reads it; so no answer is computed twice, however
many branches of a plan use it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import keys
from lexmill.functions.jsonio import RESULT_TYPE, strict_json
from lexmill.functions.rows import bound
from lexmill.functions.text import file_name
from lexmill.functions.vectors import cosine
from lexmill.operators import cache, chunking, packing, results, retrieval
from lexmill.operators.models import Chat, Embedder, Reranker, ask_model, echo_chat, embed_texts, letter_embedder, rerank_texts
from lexmill.storage import written

# What the model is told beside the user's prompt.
SYSTEM = "Jsi extrakční engine. Odpovídej výhradně validním JSON podle schématu ze zadání. Nevracej markdown ani vysvětlení, pouze samotný JSON."
BATCH_NOTE = "[Toto je dávka #%d z %d. Zpracuj jen přiložené dokumenty a vrať výstup ve stejném formátu, jako bys měl jen tyto dokumenty. Deduplikace napříč dávkami proběhne v další fázi.]\n\n"
MERGE_NOTE = (
    "[Dříve jsi zpracoval stejnou úlohu v %d dávkách. Níže jsou jejich dílčí výstupy. Spoj je do jediného finálního výstupu ve stejném formátu – dedupli­kuj záznamy (pokud stejný subjekt přišel ve více dávkách, "
    "vyber nejúplnější/nejspolehlivější hodnoty), zachovej formát výstupu definovaný úlohou. Nevracej komentáře ani metainformace, pouze finální výstup.]\n\n"
)
REDUCED = "Map-reduce: vstup překračoval kontext modelu, proto byl rozdělen do %d dávek a spojen finálním reduce voláním."
REDUCE_FAILED = "Map-reduce: final reduce selhal (%s). V rawResponse jsou jednotlivé dávky oddělené markerem === Dávka #N ===."
NO_PROMPT = "Prompt není zadaný"

_NO_STRINGS = "array<string>"


def answered(requests: DataFrame, make_chat: Callable[[], Chat], store: cache.Store | None = None, bypass: bool = False, model: str = "", mode: str = "", **options) -> DataFrame:
    """requests (key, user, ...) with response, error and hit. Answers that are neither empty nor errors go to the
    store, also with bypass, which only reads nothing."""
    asked = requests.groupBy("key").agg(F.min("user").alias("user"))
    if store is None:
        fresh = written(ask_model(asked, "user", make_chat, SYSTEM, **options), "answers")
        return requests.join(fresh.select("key", "response", "error"), "key").withColumn("hit", F.lit(False))
    found = written(cache.lookup(asked, store.read().select("key", "response", "created_at"), bypass=bypass), "answers-known")
    fresh = written(ask_model(found.filter("not hit").select("key", "user"), "user", make_chat, SYSTEM, **options), "answers")
    good = fresh.filter(F.col("error").isNull() & (F.length("response") > 0))
    store.put(good.select("key", "response", F.lit(model).alias("model"), F.lit(mode).alias("mode"), F.current_timestamp().alias("created_at")))
    known = found.filter("hit").select("key", "response", F.lit(None).cast("string").alias("error"), "hit")
    return requests.join(known.unionByName(fresh.select("key", "response", "error", F.lit(False).alias("hit"))), "key")


def decoded(rows: DataFrame, key: list[str], source: str) -> DataFrame:
    """Best effort: the canonical fields where an answer has them, else an empty row; the raw answer always; errors are
    warnings; an empty source_file is filled in."""
    out = rows.withColumn("json", strict_json("response")).withColumn("r", F.from_json("json", RESULT_TYPE))
    fields = [x.split()[0] for x in RESULT_TYPE.split(", ")]
    empty = {"confidence": F.lit(0.0)} | {n: F.array().cast(_NO_STRINGS) for n in ("diagnoses", "medication", "lab_values", "warnings")}
    columns = {n: F.coalesce(F.col(f"r.{n}"), empty.get(n, F.lit(""))) for n in fields}
    columns["source_file"] = F.when(columns["source_file"] == "", F.col(source)).otherwise(columns["source_file"])
    columns["warnings"] = F.concat(columns["warnings"], F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.array().cast(_NO_STRINGS)))
    return out.select(*key, *[v.alias(n) for n, v in columns.items()], F.col("response").alias("raw_response"))


def request_key(prompt: str, hashes: Column, model: str, mode: str, embedding_model: str = "", reranker_model: str = "") -> Column:
    return keys.inference_key(F.lit(SYSTEM), F.lit(prompt), hashes, F.lit(model), F.lit(embedding_model), F.lit(reranker_model), F.lit(mode))


def document_request(prompt: str, source: Column, context: Column) -> Column:
    return F.concat(F.lit(f"{prompt}\n\nZdrojový soubor: "), source, F.lit("\n\nText dokumentu:\n"), context)


def _empty_rows(docs: DataFrame, key: list[str], source: str) -> DataFrame:
    return decoded(docs.select(*key, F.col(source).alias("__source"), F.lit("").alias("response"), F.lit(NO_PROMPT).alias("error")), key, "__source")


def _per_document(docs: DataFrame, key: str, source: str, text: str, prompts: list[str], context: Callable[[str], Column | DataFrame], mode: str, names: dict, make_chat, **options) -> DataFrame:  # noqa: ANN001
    """One answer for each document and prompt; those of a document are merged in the prompts' order."""
    if not prompts:
        return _empty_rows(docs, [key], source)
    hashed = docs.withColumn("__hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    asked = None
    for place, prompt in enumerate(prompts):
        rows = context(prompt) if mode == "search" else hashed.withColumn("__context", F.coalesce(F.col(text), F.lit("")))
        one = rows.select(
            key, F.col(source).alias("__source"), F.lit(place).alias("__place"),
            request_key(prompt, F.array(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), mode=mode, **names).alias("key"),
            document_request(prompt, F.col(source), F.col("__context")).alias("user"),
        )
        asked = one if asked is None else asked.unionByName(one)
    said = answered(asked.withColumnRenamed(key, "__doc"), make_chat, model=names["model"], mode=mode, **options)
    parts = decoded(said.withColumnRenamed("__doc", key), [key, "__source", "__place"], "__source")
    if len(prompts) == 1:
        return parts.drop("__source", "__place")
    merged = results.merge(parts.drop("source_file").withColumnRenamed(key, "__doc"), "__doc", "__place").withColumnRenamed("__doc", key)
    sources = parts.filter("__place = 0").select(key, F.col("__source").alias("source_file"))
    return merged.join(sources, key).select(key, *[x.split()[0] for x in RESULT_TYPE.split(", ")], "raw_response")


def _listed(prompt: str | list[str]) -> list[str]:
    return [prompt] if isinstance(prompt, str) else list(prompt)


def fast(docs: DataFrame, key: str, source: str, text: str, prompt: str | list[str], make_chat: Callable[[], Chat] = lambda: echo_chat, model: str = "", **options) -> DataFrame:
    """One call for each document and prompt over the whole text. options: store, bypass, and those of ask_model."""
    return _per_document(docs, key, source, text, _listed(prompt), lambda _: F.col(text), "fast", {"model": model}, make_chat, **options)


def embedded(texts: DataFrame, make_embedder: Callable[[], Embedder], store: cache.Store | None = None, model: str = "") -> DataFrame:
    """texts (key, text) to (key, vector), each key once: from the store, else from the model, whose vectors are kept.
    The result is written, so a run asks for a text once wherever it occurs."""
    wanted = texts.groupBy("key").agg(F.min("text").alias("text"))
    if store is None:
        return written(embed_texts(wanted, make_embedder), "vectors")
    found = written(cache.lookup(wanted, store.read().select("key", "vector", "created_at")), "vectors-known")
    fresh = written(embed_texts(found.filter("not hit"), make_embedder), "vectors")
    store.put(fresh.select("key", "vector", F.lit(model).alias("model"), F.current_timestamp().alias("created_at")))
    return found.filter("hit").select("key", "vector").unionByName(fresh)


def run_vectors(docs: DataFrame, key: str, text: str, prompts: list[str], make_embedder: Callable[[], Embedder], vectors: cache.Store | None = None, server: str = "", embedding_model: str = "") -> tuple[DataFrame, DataFrame]:
    """(windows (key, chunk_idx, ekey), vectors (ekey, vector)) of all windows of a run and its prompts: each different
    text is asked for once, however many windows, documents and prompts have it."""
    name = lambda t: keys.embedding_key(F.lit(server), F.lit(embedding_model), t)
    windows = chunking.chunks(docs.select(key, F.col(text).alias("text"))).withColumn("ekey", name(F.col("chunk")))
    asked = docs.sparkSession.createDataFrame([(p,) for p in prompts], "text string").select(name(F.col("text")).alias("key"), "text")
    known = embedded(windows.select(F.col("ekey").alias("key"), F.col("chunk").alias("text")).unionByName(asked), make_embedder, vectors, embedding_model)
    return windows.select(key, "chunk_idx", "ekey"), known.withColumnRenamed("key", "ekey")


def retrieved(
    docs: DataFrame, key: str, text: str, prompt: str, make_embedder: Callable[[], Embedder] | None, make_reranker: Callable[[], Reranker] | None = None,
    vectors: cache.Store | None = None, server: str = "", embedding_model: str = "", run: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """docs with __context: the six best windows of the text by cosine with the prompt, or of the 20 best by cosine
    those that the reranker likes best; the first six windows without an embedder, a vector of the prompt or of any
    window, and an empty text as it is. Windows are ranked by their places; their texts are cut from their document where
    it is again. `run` are the run_vectors of a run of several prompts."""
    first = F.array_join(F.slice(chunking.chunk_array(F.col(text)), 1, retrieval.TOP_K), "\n\n")
    if make_embedder is None:
        return docs.withColumn("__context", F.coalesce(first, F.lit("")))
    windows, known = run or run_vectors(docs, key, text, [prompt], make_embedder, vectors, server, embedding_model)
    query = known.filter(F.col("ekey") == keys.embedding_key(F.lit(server), F.lit(embedding_model), F.lit(prompt))).select("vector").first()
    if query is None:
        return docs.withColumn("__context", F.coalesce(first, F.lit("")))
    score = F.round(cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query.vector])), 9)
    some = retrieval.CANDIDATES if make_reranker else retrieval.TOP_K
    ranked = retrieval.top_chunks(windows.join(known, "ekey").select(key, "chunk_idx", "vector"), score, key, some)
    places = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_idx"))), lambda x: x["chunk_idx"]).alias("__places"))
    cut = lambda at: bound(chunking.chunk_array(F.col(text)), lambda chunks: F.transform(at, lambda i: F.get(chunks, i)))
    if make_reranker:
        groups = written(docs.join(places, key).select(key, "__places", cut(F.col("__places")).alias("texts")), "candidates")
        liked = groups.select(key, "__places").join(rerank_texts(groups, key, prompt, make_reranker, retrieval.TOP_K), key, "left")
        places = liked.select(key, F.coalesce(F.transform("best", lambda i: F.get("__places", i)), "__places").alias("__places"))
    found = F.when(F.col("__places").isNotNull(), F.array_join(cut(F.slice("__places", 1, retrieval.TOP_K)), "\n\n"))
    return docs.join(places, key, "left").withColumn("__context", F.coalesce(found, first, F.lit(""))).drop("__places")


def search(
    docs: DataFrame, key: str, source: str, text: str, prompt: str | list[str], make_chat: Callable[[], Chat] = lambda: echo_chat, make_embedder: Callable[[], Embedder] | None = lambda: letter_embedder,
    make_reranker: Callable[[], Reranker] | None = None, vectors: cache.Store | None = None, model: str = "", embedding_model: str = "", reranker_model: str = "", server: str = "", **options,
) -> DataFrame:
    """As fast, over the context that `retrieved` finds for each prompt. Windows are embedded once for all prompts."""
    prompts = [p for p in _listed(prompt) if p.strip()]
    run = run_vectors(docs, key, text, prompts, make_embedder, vectors, server, embedding_model) if make_embedder and len(prompts) > 1 else None
    context = lambda p: retrieved(docs, key, text, p, make_embedder, make_reranker, vectors, server, embedding_model, run)
    names = {"model": model, "embedding_model": embedding_model, "reranker_model": reranker_model}
    return _per_document(docs, key, source, text, _listed(prompt), context, "search", names, make_chat, **options)


def run_totals(docs: DataFrame, run: str, key: str, source: str, text: str, prompt: str) -> DataFrame:
    """(run, n_docs, hashes, tokens): tokens are those of a single request over all documents of the run, from lengths
    alone."""
    said = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(run, key, F.sha2(said, 256).alias("hash"), (F.length(file_name(F.col(source))) + F.length(said)).alias("chars"))
    totals = sized.groupBy(run).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("chars").alias("chars"), F.collect_list("hash").alias("hashes"))
    n = F.col("n_docs")
    # Each place has as many digits as it has; places of k digits and more are n - 10^(k-1) + 1.
    digits = sum((F.greatest(n - (10**k - 1), F.lit(0)) for k in range(12)), F.lit(0))
    label = len("=== Dokument #:  ===\n")
    head = len(prompt) + len("\n\nVstupní dokumenty ():\n") + F.length(n.cast("string"))
    whole = F.col("chars") + n * label + digits + 2 * (n - 1) + head + len(SYSTEM)
    return totals.select(run, "n_docs", "hashes", F.ceil(whole / packing.CHARS_PER_TOKEN).alias("tokens"))


def run_request(prompt: str, n_docs: Column, payload: Column) -> Column:
    return F.concat(F.lit(f"{prompt}\n\nVstupní dokumenty ("), n_docs.cast("string"), F.lit("):\n"), payload)


def single_requests(docs: DataFrame, run: str, key: str, source: str, text: str, prompt: str) -> DataFrame:
    """(run, user): one request over all documents of each run, numbered from 1 in order of key."""
    place = docs.select(run, key, F.row_number().over(Window.partitionBy(run).orderBy(key)).alias("place"), F.lit(1).alias("batch"))
    whole = packing.payloads(docs, place, run, key, file_name(F.col(source)), F.coalesce(F.col(text), F.lit("")))
    return whole.select(run, run_request(prompt, F.col("n_docs"), F.col("payload")).alias("user"))


def batch_requests(docs: DataFrame, run: str, key: str, source: str, text: str, prompt: str, context: int = packing.CONTEXT) -> DataFrame:
    """(run, batch, n_batches, hashes, user): the requests over the batches of each run."""
    said = F.coalesce(F.col(text), F.lit(""))
    placed = packing.pack(docs, run, key, F.length(said), packing.batch_budget(len(prompt), context, len(SYSTEM)))
    parts = packing.payloads(docs, placed, run, key, file_name(F.col(source)), said)
    hashes = docs.select(run, key, F.sha2(said, 256).alias("hash")).join(placed, [run, key]).groupBy(run, "batch").agg(F.collect_list("hash").alias("hashes"))
    many = placed.groupBy(run).agg(F.max("batch").alias("n_batches"))
    user = F.concat(F.format_string(BATCH_NOTE, "batch", "n_batches"), F.lit(f"{prompt}\n\nVstupní dokumenty v této dávce ("), F.col("n_docs").cast("string"), F.lit("):\n"), F.col("payload"))
    return parts.join(many, run).join(hashes, [run, "batch"]).select(run, "batch", "n_batches", "hashes", user.alias("user"))


def merge_request(prompt: str, n_batches: Column, payload: Column) -> Column:
    return F.concat(F.format_string(MERGE_NOTE, n_batches), F.lit(f"Původní zadání:\n{prompt}\n\nDílčí výstupy:\n"), payload)


def consolidated(
    docs: DataFrame, run: str, key: str, source: str, text: str, prompt: str, make_chat: Callable[[], Chat] = lambda: echo_chat, context: int = packing.CONTEXT,
    model: str = "", store: cache.Store | None = None, bypass: bool = False, **options,
) -> DataFrame:
    """One result for each run (folder). Answers over the whole run that the store has come first, whatever the budget
    of today. Other runs that fit the token budget are one call over all documents; the rest are packed into batches,
    mapped, and reduced by one more call over the labelled partial outputs. A failed batch goes on as a literal error;
    a failed reduce leaves the partial outputs and a warning."""
    ask = lambda rows, mode: answered(rows, make_chat, store, bypass, model, mode, **options)
    totals = run_totals(docs, run, key, source, text, prompt).withColumn("key", request_key(prompt, F.col("hashes"), model, "consolidate"))
    if store is not None:
        totals = cache.lookup(totals, store.read().select("key", "created_at"), bypass=bypass)
    else:
        totals = totals.withColumn("hit", F.lit(False))
    totals = written(totals.withColumn("fits", F.col("hit") | (F.col("tokens") <= packing.token_budget(context))), "runs")
    whole = totals.filter("fits")
    one = single_requests(docs.join(whole.select(run), run, "left_semi"), run, key, source, text, prompt)
    single = ask(whole.select(run, "key").join(one, run), "consolidate").select(run, "response", "error", F.lit(0).alias("batches"), F.lit(None).cast("string").alias("note"))
    large = docs.join(totals.filter("not fits").select(run), run, "left_semi")
    maps = batch_requests(large, run, key, source, text, prompt, context).withColumn("key", request_key(prompt, F.col("hashes"), model, "consolidate-map"))
    said = ask(maps.select(run, "batch", "n_batches", "key", "user"), "consolidate-map")
    failed = F.concat(F.lit("[CHYBA dávky "), F.col("batch").cast("string"), F.lit(": "), F.col("error"), F.lit("]"))
    partial = written(said.select(run, "batch", F.when(F.col("error").isNotNull(), failed).otherwise(F.col("response")).alias("output")), "partials")
    merges = packing.reduce_payload(partial, run).join(totals.select(run, "hashes"), run)
    of_all = F.array_append("hashes", F.concat(F.lit("batches="), F.col("n_batches").cast("string")))
    merges = merges.select(run, "n_batches", request_key(prompt, of_all, model, "consolidate-reduce").alias("key"), merge_request(prompt, F.col("n_batches"), F.col("payload")).alias("user"))
    merged = ask(merges, "consolidate-reduce").drop("n_batches").join(packing.labelled_outputs(partial, run, "=== Dávka #"), run)
    bad = F.col("error").isNotNull()
    merged = merged.select(
        run, F.when(bad, F.col("payload")).otherwise(F.col("response")).alias("response"), F.when(bad, F.format_string(REDUCE_FAILED, "error")).alias("error"), F.col("n_batches").cast("int").alias("batches"),
        F.when(~bad, F.format_string(REDUCED, "n_batches")).alias("note"),
    )
    label = F.concat(F.lit("Consolidated ("), F.col("n_docs").cast("string"), F.lit(" dokumentů)"))
    rows = single.unionByName(merged).join(totals.select(run, "n_docs"), run).withColumn("__label", label)
    out = decoded(rows, [run, "n_docs", "__label", "note"], "__label").withColumn("source_file", F.col("__label"))
    return out.withColumn("warnings", F.when(F.col("note").isNotNull(), F.concat(F.array("note"), "warnings")).otherwise(F.col("warnings"))).drop("__label", "note")
