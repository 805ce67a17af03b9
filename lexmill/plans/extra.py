"""More queries of the reference operators and their SQL: sizes, groups of pages, model stages with failures, files and
logs. Values that are fixed are written out in the SQL, not taken from the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import text as texts
from lexmill.functions import vectors
from lexmill.operators import chunking, modes, models, orchestration, packing, profiles
from lexmill.plans.catalogue import _PACK_CTE, _packed, _query, docs_view, table
from lexmill.sources import readers, sinks
from lexmill.storage import fresh_path
from lexmill.streaming import incremental


@_query(
    """WITH d AS (SELECT doc_id, length(text) AS prompt_chars, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1024 + 512 * (doc_id % 40) END AS context FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, greatest(256.0, context - greatest(512.0, 0.22 * context) - ceil(prompt_chars / 4.0) - 96) * 4 AS room FROM d)
SELECT doc_id, (CASE WHEN context IS NULL THEN 1000 ELSE greatest(500, least(1000, trunc(room))) END)::INTEGER AS size FROM r"""
)
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters for a chunk in contexts of several sizes, the texts being the prompts."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    context = F.when(F.col("doc_id") % 5 != 0, 1024 + 512 * (F.col("doc_id") % 40))
    return d.select("doc_id", chunking.chunk_size_for(context, F.length("text"), 1000).cast("int").alias("size"))


@_query(
    """WITH p AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS pages FROM conversations GROUP BY conv_id),
g AS (SELECT conv_id, pages, unnest(range((len(pages) + 3) // 4)) AS number FROM p)
SELECT conv_id, number::INTEGER AS number, md5(array_to_string(pages[number * 4 + 1:number * 4 + 4], '|')) AS pages_md5 FROM g"""
)
def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages, four at a time."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    groups = c.select("conv_id", F.posexplode(chunking.page_batches(F.transform("p", lambda x: x["text"]), 4)).alias("number", "pages"))
    return groups.select("conv_id", "number", F.md5(F.array_join("pages", "|")).alias("pages_md5"))


@_query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, CASE WHEN vec_id % 7 = 0 THEN embedding[1:3]::DOUBLE[] WHEN vec_id % 11 = 0 THEN []::DOUBLE[] ELSE list_reverse(embedding::DOUBLE[]) END AS w FROM embeddings)
SELECT vec_id, CASE WHEN len(v) <> len(w) THEN -1.0 ELSE round(list_cosine_similarity(v, CASE WHEN len(v) <> len(w) THEN v ELSE w END), 9) END AS score FROM e"""
)
def older_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with itself turned round; a length that differs, and a null, give -1."""
    e = table(spark, sf_dir, "embeddings")
    other = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 3)).when(F.col("vec_id") % 11 != 0, F.reverse("embedding"))
    return e.select("vec_id", F.coalesce(F.round(vectors.cosine_or_minus_one(F.col("embedding"), other), 9), F.lit(-1.0)).alias("score"))


@_query(
    """WITH d AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 8 WHEN 0 THEN ' Context Length' WHEN 1 THEN ' context window' WHEN 2 THEN 'number of tokens to keep' WHEN 3 THEN 'Provide a shorter input' WHEN 4 THEN 'prompt is too long'
  WHEN 5 THEN 'exceeded the context' ELSE '' END AS t FROM documents)
SELECT doc_id, regexp_matches(lower(t), 'context length|context window|number of tokens to keep|provide a shorter input|prompt is too long|exceeded the context') AS too_long FROM d"""
)
def context_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as error messages, most with one of the phrases by which a server says that its context is too small."""
    phrases = [" Context Length", " context window", "number of tokens to keep", "Provide a shorter input", "prompt is too long", "exceeded the context", "", ""]
    said = F.concat(F.coalesce("text", F.lit("")), F.get(F.array(*[F.lit(p) for p in phrases]), (F.col("doc_id") % 8).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", texts.is_context_overflow(said).alias("too_long"))


@_query(
    """WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '[Chyba: ' || coalesce(text, '') WHEN 1 THEN '[Žádná odpověď]' WHEN 2 THEN '' ELSE coalesce(text, '') END AS one FROM documents)
SELECT doc_id, (doc_id % 7 <> 0 AND one <> '' AND NOT starts_with(one, '[Chyba') AND NOT starts_with(one, '[Žádná')) AS cacheable FROM d"""
)
def cacheable_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as answers, some of them errors, empty, or two answers instead of one."""
    said = F.coalesce("text", F.lit(""))
    one = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("[Chyba: "), said)).when(F.col("doc_id") % 5 == 1, F.lit("[Žádná odpověď]")).when(F.col("doc_id") % 5 == 2, F.lit("")).otherwise(said)
    answers = F.when(F.col("doc_id") % 7 == 0, F.array(one, one)).otherwise(F.array(one))
    return table(spark, sf_dir, "documents").select("doc_id", texts.is_cacheable(answers).alias("cacheable"))


_NAMES = "CASE doc_id % 12 WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'log--x.csv' WHEN 2 THEN 'vystup--x.txt' WHEN 3 THEN 'souhrn--x.txt' WHEN 4 THEN 'a.pdf.lm.txt' WHEN 5 THEN '.b-checkpoint.json' WHEN 6 THEN 'catalog--x.csv' WHEN 7 THEN 'c.exe' WHEN 8 THEN 'noending' WHEN 9 THEN 'd.tar.YML' WHEN 10 THEN 'e.docx' ELSE 'f.mp3' END"
_TYPES = (
    "'c', 'cfg', 'conf', 'cpp', 'cs', 'css', 'csv', 'env', 'fnc', 'html', 'htm', 'ini', 'java', 'js', 'json', 'md', 'pck', 'pkb', 'pks', 'pls', 'prc', 'properties', 'psql', 'py', 'sql', 'swift', 'toml', 'trg', 'ts', 'txt', 'vw', 'xml', 'yaml', 'yml', "
    "'doc', 'docx', 'odt', 'pdf', 'ppt', 'pptx', 'rtf', 'xls', 'xlsx'"
)


@_query(
    f"""WITH n AS (SELECT doc_id, {_NAMES} AS name FROM documents)
SELECT doc_id, lower(regexp_extract(name, '\\.([^.]*)$', 1)) IN ({_TYPES}) AND NOT regexp_matches(name, '\\.lm\\.txt$|^(log--|vystup--|souhrn--)|^\\.[^/]*-checkpoint\\.json$') AS taken,
       source || '/sub/' || name || '.lm.txt' AS answer_path FROM n JOIN documents USING (doc_id)"""
)
def input_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names are inputs (a supported type, and no output of an earlier run), and where their answers go."""
    d = table(spark, sf_dir, "documents").withColumn("name", F.expr(_NAMES)).withColumn("path", F.concat(F.lit("in/"), "source", F.lit("/sub/"), "name"))
    known = texts.extension(F.col("path")).isin(*texts.PLAIN_TEXT_TYPES, *texts.OTHER_TYPES)
    own = texts.file_name(F.col("path")).rlike(texts.OWN_OUTPUT)
    return d.select("doc_id", (known & ~own).alias("taken"), sinks.mirrored_path(F.col("path"), "in").alias("answer_path"))


@_query(
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z | ' || event_type || ' | ' || 'f¦' || user_id || ' | phase | a  b¦' || props || ' | ' || CASE WHEN event_id % 4 = 0 THEN '' ELSE round(value)::BIGINT::VARCHAR END AS line FROM events"""
)
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a run's log; separators and line ends inside a field are replaced."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    file, message = F.concat(F.lit("f|"), F.col("user_id").cast("string")), F.concat(F.lit("a\r\nb|"), "props")
    return e.select("event_id", sinks.log_line(F.col("ts"), F.col("event_type"), file, F.lit("phase"), message, F.when(F.col("event_id") % 4 != 0, F.col("value"))).alias("line"))


@_query(
    """SELECT doc_id AS event_id, concat_ws(';', coalesce(source, ''), 'OK', CASE WHEN doc_id % 3 = 0 THEN '' ELSE (doc_id % 9)::VARCHAR END, coalesce(length(text)::VARCHAR, ''), coalesce(lang, ''), printf('%.2f', (doc_id % 100) / 4.0), printf('%.2f', (doc_id % 10) / 4.0), '', '', printf('%.2f', doc_id / 2.0), 'm') AS line FROM documents"""
)
def batch_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of a batch log."""
    d = table(spark, sf_dir, "documents")
    values = [F.col("source"), F.lit("OK"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 9), F.length("text"), F.col("lang"), (F.col("doc_id") % 100) / 4, (F.col("doc_id") % 10) / 4, F.lit(None), F.lit(None), F.col("doc_id") / 2, F.lit("m")]
    rows = d.select(F.col("doc_id").alias("event_id"), *[v.alias(n) for v, n in zip(values, sinks.BATCH_COLUMNS, strict=True)])
    return rows.select("event_id", sinks.batch_line(rows).alias("line"))


@_query("SELECT doc_id AS id, quality AS n, 'own' AS origin FROM labels UNION ALL SELECT doc_id, -1, 'built in' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def overridden_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as built-in profiles, labels as a user's own, which take the place of those with their id."""
    built = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(-1).alias("n"), F.lit("built in").alias("origin"))
    own = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("n"), F.lit("own").alias("origin"))
    return profiles.with_overrides(built, own)


def _sometimes():  # noqa: ANN202
    def chat(system: str, user: str) -> str:
        if len(user) % 3 == 0:
            raise RuntimeError("no answer")
        return f"{len(user)} characters: {user}"

    return chat


@_query(
    """SELECT doc_id, CASE WHEN length(t) % 3 = 0 THEN md5('') ELSE md5(length(t) || ' characters: ' || t) END AS response_md5, CASE WHEN length(t) % 3 = 0 THEN 'no answer' END AS error
FROM (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL)"""
)
def answers_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that fails for a third of the texts: each failure is its row's."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    return models.ask_model(d, "text", _sometimes).select("doc_id", F.md5("response").alias("response_md5"), "error")


@_query(
    """WITH a AS (SELECT doc_id, text, doc_id % 2 = 0 AS failed, trim(coalesce(text, ''), E' \\t\\n\\r') <> '' AS has FROM documents)
SELECT doc_id::VARCHAR AS path, CASE WHEN NOT failed THEN 'OK' WHEN NOT has THEN 'ERR' WHEN length(text) % 2 = 0 THEN 'RETRY_OK' ELSE 'RETRY_ERR' END AS status,
       CASE WHEN failed AND has AND length(text) % 2 = 0 THEN md5('again Prompt' || chr(10) || chr(10) || text) ELSE md5('first') END AS response_md5,
       CASE WHEN NOT failed OR (has AND length(text) % 2 = 0) THEN NULL WHEN has THEN 'odd' ELSE 'down' END AS error FROM a"""
)
def retried_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that failed are asked about once more; a success takes the place of the first answer."""

    def make():  # noqa: ANN202
        def chat(system: str, user: str) -> str:
            if len(user) % 2:
                raise RuntimeError("odd")
            return f"again {user}"

        return chat

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", (F.col("doc_id") % 2 == 0).alias("failed"))
    first = d.select("path", F.lit("first").alias("response"), F.when(F.col("failed"), F.lit("down")).alias("error"))
    got = orchestration.retry_failed(first, d, "path", "text", "Prompt", make)
    return got.select("path", "status", F.md5("response").alias("response_md5"), "error")


@_query(
    """WITH d AS (SELECT doc_id::VARCHAR AS doc, text FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS page, string_split(text, chr(10) || chr(10)) AS parts FROM d WHERE length(text) % 5 <> 0)
SELECT doc, page::INTEGER AS page, md5(regexp_replace(parts[page + 1], '^\\s+|\\s+$', '', 'g')) AS page_md5, NULL AS problem FROM p
UNION ALL SELECT doc, -1, NULL, 'cannot be read' FROM d WHERE length(text) % 5 = 0"""
)
def extracted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs as pages of a file; a fifth of the files cannot be read and are rows with their problem."""

    def pages(raw: bytes) -> list[str]:
        said = raw.decode()
        if len(said) % 5 == 0:
            raise ValueError("cannot be read")
        return said.split("\n\n")

    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return readers.extracted(d, pages).select("doc", F.coalesce("page", F.lit(-1)).alias("page"), F.md5("text").alias("page_md5"), "problem")


_MERGED = (
    "'[Dříve jsi zpracoval stejnou úlohu v ' || n || ' dávkách. Níže jsou jejich dílčí výstupy. Spoj je do jediného finálního výstupu ve stejném formátu – dedupli' || chr(173) || 'kuj záznamy (pokud stejný subjekt přišel ve více dávkách, "
    "vyber nejúplnější/nejspolehlivější hodnoty), zachovej formát výstupu definovaný úlohou. Nevracej komentáře ani metainformace, pouze finální výstup.]' || chr(10) || chr(10)"
)


@_query(
    f"""WITH RECURSIVE {_PACK_CTE}, b AS (SELECT source, batch, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS said FROM f GROUP BY source, batch),
r AS (SELECT source, count(*) AS n, string_agg('=== Výstup dávky #' || batch || '/' || total || ' ===' || chr(10) || said, chr(10) || chr(10) ORDER BY batch) AS payload
      FROM (SELECT *, count(*) OVER (PARTITION BY source) AS total FROM b) GROUP BY source)
SELECT source, md5({_MERGED} || 'Původní zadání:' || chr(10) || 'Spoj to.' || chr(10) || chr(10) || 'Dílčí výstupy:' || chr(10) || payload) AS request_md5 FROM r"""
)
def reduce_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reduce call of each folder gets to read, the batches' outputs being the ids in them."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    partial = _packed(docs_view(spark, sf_dir)).groupBy("source", "batch").agg(ids.alias("output"))
    whole = packing.reduce_payload(partial, "source")
    return whole.select("source", F.md5(modes.merge_request("Spoj to.", F.col("n_batches"), F.col("payload"))).alias("request_md5"))


@_query("SELECT DISTINCT md5(text) AS key, length(text)::INTEGER AS chars FROM documents WHERE text IS NOT NULL")
def incremental_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a folder that is read as a stream and worked on incrementally: equal content once."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.md5("text").alias("key"), F.length("text").alias("chars"))
    source, store, checkpoint = (fresh_path(spark, f"incremental-{n}") for n in ("in", "out", "checkpoint"))
    d.repartition(4).write.parquet(source)
    schema = "key string, chars int"
    incremental.process_new(incremental.parquet_stream(spark, source, schema, 1), "key", lambda rows: rows, store, schema, checkpoint).awaitTermination()
    return spark.read.schema(T._parse_datatype_string(schema)).parquet(store)
