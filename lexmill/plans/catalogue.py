"""Registry of the queries over the reference operators and of their SQL oracles.

Views: `docs` are documents as one-page files of a folder (`source`), `turns` are conversations as files with one page
a turn, `noisy` are documents between injected boilerplate lines (the plain texts hold none).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import keys, text, vectors
from lexmill.functions.jsonio import is_json, strict_json
from lexmill.operators import cache, chunking, cleaning, matching, metrics, modes, orchestration, packing, results, retrieval
from lexmill.operators.models import letter_embedder, overlap_reranker
from lexmill.sources import readers, sinks
from lexmill.streaming import health

NOISY = (
    "concat_ws(chr(10), 'Fakultní nemocnice Motol', concat('Strana ', CAST(doc_id % 7 + 1 AS STRING), '/7'), text, CASE doc_id % 8 WHEN 0 THEN 'MUDr. Jan Novák' "
    "WHEN 1 THEN 'www.example.com' WHEN 2 THEN 'tel.: +420 123' WHEN 3 THEN 'info@example.com' WHEN 4 THEN '150 06 Praha' WHEN 5 THEN 'Datum tisku 1.1.2024' "
    "WHEN 6 THEN '=====' ELSE '### *** !!!' END, 'Jméno Příjmení, Ph.D.', 'Oddělení kardiologie', 'Fakultní nemocnice Motol')"
)
QUERY_TEXT = "the nature of things in the house of letters"
TERMS = ["the", "nature", "things", "house", "letters", "that", "and"]
PROMPT = "Odpověz ano/ne, zda text obsahuje diagnózu."
PACK_BUDGET = 20_000
LEADER_THRESHOLD = 0.35

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return d.withColumns({"source_file": F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")), "file_hash": F.sha2("text", 256)})


def noisy_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(NOISY).alias("text"))


# ---------------------------------------------------------------- SQL parts

DOCS = "docs AS (SELECT doc_id, text, source, source || '/' || doc_id || '.pdf' AS source_file, sha256(text) AS file_hash FROM documents)"
NOISY_CTE = f"noisy AS (SELECT doc_id, {NOISY} AS text FROM documents)"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '{text.TRIM}', '', 'g')"


def _lines(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '{text.LINE_END}'), lambda l: {_trim('l')}), lambda l: l <> '')"


_M = lambda x, p: f"regexp_matches({x}, '{p}')"
CLASSIFIER_SQL = {
    "page_number": _M("lower(line)", text.PAGE_NUMBER),
    "signature": f"({_M('lower(line)', text.SIGNATURE)} OR (length(line) < 80 AND {_M('lower(line)', text.CREDENTIAL)}))",
    "visual_noise": f"({_M('lower(line)', text.VISUAL_NOISE)} OR (length(line) < 32 AND {_M('lower(line)', text.DEPARTMENT)}))",
    "contact": f"({_M('lower(line)', text.CONTACT)} OR (length(line) < 60 AND {_M('line', text.EMAIL_ONLY)}) OR {_M('line', text.POSTCODE)})",
    "audit": _M("lower(line)", text.AUDIT),
    "glyph": f"(length(line) >= 3 AND length(regexp_replace(line, '{text.NOT_ALNUM}', '', 'g')) < 0.25 * length(line))",
    "rule": _M("line", text.RULE),
}
BOILERPLATE_SQL = " OR ".join(CLASSIFIER_SQL.values())


# ---------------------------------------------------------------- chunks and retrieval

_CHUNKS_SQL = """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((n - {o}) / {s}.0) AS BIGINT)))) AS k FROM d)
SELECT doc_id, k::INTEGER AS chunk_idx, length(substr(text, k * {s} + 1, {z})) AS chunk_chars, md5(substr(text, k * {s} + 1, {z})) AS chunk_md5 FROM c
"""


@_query(_CHUNKS_SQL.format(o=250, s=1250, z=1500))
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return c.select("doc_id", "chunk_idx", F.length("chunk").cast("long").alias("chunk_chars"), F.md5("chunk").alias("chunk_md5"))


@_query(_CHUNKS_SQL.format(o=120, s=880, z=1000))
def chunk_windows_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.lenient_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), size=1000, overlap=120)
    return c.select("doc_id", "chunk_idx", F.length("chunk").cast("long").alias("chunk_chars"), F.md5("chunk").alias("chunk_md5"))


_LETTERS_SQL = "[" + ", ".join(f"(length(chunk) - length(replace(chunk, '{c}', '')))::DOUBLE" for c in vectors.LETTERS) + "]"
_QUERY_VECTOR = [float(QUERY_TEXT.count(c)) for c in vectors.LETTERS]
_CHUNK_CTE = """d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
k AS (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((n - 250) / 1250.0) AS BIGINT)))) AS chunk_idx FROM d),
c AS (SELECT doc_id, chunk_idx, substr(text, chunk_idx * 1250 + 1, 1500) AS chunk FROM k)"""
_SCORE_SQL = f"round(CASE WHEN list_sum({_LETTERS_SQL}) > 0 THEN list_cosine_similarity({_LETTERS_SQL}, {_QUERY_VECTOR}::DOUBLE[]) ELSE 0 END, 9)"


@_query(
    f"""WITH {_CHUNK_CTE}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_SCORE_SQL} DESC, chunk_idx) AS r FROM c)
SELECT doc_id, string_agg(chunk_idx::VARCHAR, ',' ORDER BY r) AS chunk_ids, string_agg(chunk, chr(10) || chr(10) ORDER BY r) AS context FROM s WHERE r <= 6 GROUP BY doc_id"""
)
def search_topk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_context(table(spark, sf_dir, "documents").select("doc_id", "text"), _QUERY_VECTOR, vectors.letter_embedding, "doc_id")


_OVERLAP_SQL = " + ".join(f"contains(lower(chunk), '{t}')::INT" for t in TERMS)


@_query(
    f"""WITH {_CHUNK_CTE}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_SCORE_SQL} DESC, chunk_idx) AS r FROM c),
b AS (SELECT doc_id, chunk_idx, {_OVERLAP_SQL} AS score FROM a WHERE r <= 20)
SELECT doc_id, chunk_idx::INTEGER AS chunk_idx, score::INTEGER AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_idx)::INTEGER AS rank FROM b QUALIFY rank <= 6"""
)
def rerank_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda c: F.round(vectors.cosine(vectors.letter_embedding(c), F.array(*[F.lit(x) for x in _QUERY_VECTOR])), 9)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.two_stage(docs, first, lambda c: retrieval.overlap_score(c, TERMS), "doc_id").select("doc_id", "chunk_idx", "score", "rank")


@_query(f"WITH {_CHUNK_CTE} SELECT doc_id, string_agg(chunk, chr(10) || chr(10) ORDER BY chunk_idx) AS context FROM c WHERE chunk_idx < 6 GROUP BY doc_id")
def context_fallback_first6(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    return d.select("doc_id", F.array_join(F.slice(chunking.chunk_array(F.col("text")), 1, 6), "\n\n").alias("context"))


@_query(
    """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.query, vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q.e), 9) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query, label, vec_id, rank::INTEGER AS rank FROM r WHERE rank <= 6"""
)
def embedding_topk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose id is divisible by 100 are the queries, against all rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return retrieval.nearest_by_group(e, e.filter("vec_id % 100 = 0"), "vec_id", "label", "embedding").select("query", "label", "vec_id", "rank")


_LEADERS_SQL = f"""WITH RECURSIVE e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
f(label, n, ids, vs, vec_id, leader) AS (
  SELECT label, n, [vec_id], [v], vec_id, vec_id FROM e WHERE n = 1
  UNION ALL
  SELECT label, n, CASE WHEN best.s >= {LEADER_THRESHOLD} THEN ids ELSE list_append(ids, vec_id) END, CASE WHEN best.s >= {LEADER_THRESHOLD} THEN vs ELSE list_append(vs, v) END,
         vec_id, CASE WHEN best.s >= {LEADER_THRESHOLD} THEN ids[best.i] ELSE vec_id END
  FROM (SELECT e.label, e.n, e.vec_id, e.v, f.ids, f.vs, list_transform(f.vs, lambda x: round(list_cosine_similarity(x, e.v), 9)) AS sims,
               {{'s': list_max(list_transform(f.vs, lambda x: round(list_cosine_similarity(x, e.v), 9))),
                 'i': list_position(list_transform(f.vs, lambda x: round(list_cosine_similarity(x, e.v), 9)), list_max(list_transform(f.vs, lambda x: round(list_cosine_similarity(x, e.v), 9))))}} AS best
        FROM f JOIN e ON e.label = f.label AND e.n = f.n + 1))"""


@_query(_LEADERS_SQL + " SELECT label, vec_id, leader, leader <> vec_id AS hit FROM f")
def semantic_dedup_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.leaders(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", LEADER_THRESHOLD)


@_query(_LEADERS_SQL.replace("SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id)", "SELECT 0 AS label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id)") + " SELECT vec_id, leader, leader <> vec_id AS hit FROM f")
def semantic_leaders_one_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one collection, which is clustered over all tasks."""
    e = table(spark, sf_dir, "embeddings").withColumn("label", F.lit(0))
    return retrieval.leaders(e, "label", "vec_id", "embedding", LEADER_THRESHOLD).drop("label")


@_query(_LEADERS_SQL + " SELECT label, count(*) FILTER (leader <> vec_id)::BIGINT AS hits, count(*) FILTER (leader = vec_id)::BIGINT AS stored, (100 * count(*) FILTER (leader <> vec_id)) // count(*) AS hit_percent FROM f GROUP BY label")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = semantic_dedup_leaders(spark, sf_dir).groupBy("label").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("stored"))
    return hits.withColumn("hit_percent", F.expr("(100 * hits) div (hits + stored)"))


# ---------------------------------------------------------------- cleaning


def _classifier_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = noisy_view(spark, sf_dir).select("doc_id", F.posexplode(text.lines_of(F.col("text"))).alias("line_no", "line"))
        return rows.filter(text.CLASSIFIERS[name](F.col("line")))

    run.__name__ = f"{name}_lines"
    sql = f"WITH {NOISY_CTE}, l AS (SELECT doc_id, {_lines('text')} AS ls FROM noisy), x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l) SELECT doc_id, line_no::INTEGER AS line_no, line FROM x WHERE {CLASSIFIER_SQL[name]}"
    _query(sql)(run)


for _name in text.CLASSIFIERS:
    _classifier_query(_name)

_FREQ = "list_filter(list_distinct({x}), lambda a: len(list_filter({x}, lambda b: b = a)) >= greatest(2, floor(len(pages) * 0.45)::INT))"
_REPEATED = f"list_concat({_FREQ.format(x='heads')}, {_FREQ.format(x='tails')})"


def _clean_sql(source: str) -> str:
    low = f"list_transform({_lines('p')}, lambda l: lower(l))"
    return f"""pg AS ({source}),
h AS (SELECT id, pages, flatten(list_transform(pages, lambda p: {low}[1:6])) AS heads, flatten(list_transform(pages, lambda p: {low}[greatest(len({low}) - 5, 1):])) AS tails FROM pg),
r AS (SELECT id, pages, list_distinct({_REPEATED}) AS repeated FROM h),
l AS (SELECT id, pages, repeated, i, unnest({_lines('pages[i]')}) AS line, generate_subscripts({_lines('pages[i]')}, 1) AS n FROM (SELECT *, unnest(range(1, len(pages) + 1)) AS i FROM r)),
k AS (SELECT id, i, string_agg(line, chr(10) ORDER BY n) AS page FROM l WHERE NOT list_contains(repeated, lower(line)) AND NOT ({BOILERPLATE_SQL}) GROUP BY id, i),
c AS (SELECT r.id, len(r.pages) AS n_pages, (SELECT string_agg(coalesce(k.page, ''), chr(10) || chr(10) ORDER BY g.i) FROM (SELECT unnest(range(1, len(r.pages) + 1)) AS i) g LEFT JOIN k ON k.id = r.id AND k.i = g.i) AS cleaned FROM r)"""


@_query(f"WITH {NOISY_CTE}, {_clean_sql('SELECT doc_id AS id, [text] AS pages FROM noisy')} SELECT id AS doc_id, unnest(repeated) AS line FROM r")
def repeated_header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = noisy_view(spark, sf_dir).select("doc_id", F.array("text").alias("pages"))
    return pages.select("doc_id", F.explode(cleaning.repeated_lines(F.col("pages"))).alias("line"))


@_query(f"WITH {NOISY_CTE}, {_clean_sql('SELECT doc_id AS id, [text] AS pages FROM noisy')} SELECT id AS doc_id, coalesce(cleaned, '') AS cleaned_text FROM c")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = noisy_view(spark, sf_dir).select("doc_id", F.array("text").alias("pages"))
    return cleaning.clean_pages(pages).select("doc_id", "cleaned_text")


_TURN_PAGE = "concat_ws(chr(10), 'Ward round', text, concat('- ', CAST(turn AS STRING), ' -'), 'Strana 1/2')"


@_query(f"WITH {_clean_sql(f'SELECT conv_id AS id, list({_TURN_PAGE} ORDER BY turn, {_TURN_PAGE}) AS pages FROM conversations GROUP BY conv_id')} SELECT id AS conv_id, n_pages::INTEGER AS n_pages, coalesce(cleaned, '') AS cleaned_text FROM c")
def clean_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_TURN_PAGE).alias("text"))
    pages = cleaning.collect_pages(turns, "conv_id", "turn", "text")
    return cleaning.clean_pages(pages).select("conv_id", F.size("pages").alias("n_pages"), "cleaned_text")


@_query(f"WITH {NOISY_CTE}, {_clean_sql('SELECT doc_id AS id, [text] AS pages FROM noisy')} SELECT count(*)::BIGINT AS n_docs, sum(length(n.text))::BIGINT AS raw_chars, sum(length(coalesce(c.cleaned, '')))::BIGINT AS cleaned_chars FROM c JOIN noisy n ON n.doc_id = c.id")
def clean_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = noisy_view(spark, sf_dir).select("text", F.array("text").alias("pages"))
    return cleaning.clean_pages(pages).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("raw_chars"), F.sum(F.length("cleaned_text")).alias("cleaned_chars"))


_WS = "concat_ws('', chr(65279), replace(text, ' ', '  '), '  ', chr(10), chr(10), chr(10), chr(10), 'end', chr(9), chr(13), chr(10))"


@_query(
    f"""WITH a AS (SELECT doc_id, replace({_WS}, chr(13) || chr(10), chr(10)) AS t FROM documents), b AS (SELECT doc_id, regexp_replace(t, '[ \\t]+\\n', chr(10), 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM b), d AS (SELECT doc_id, replace(regexp_replace(t, '[ \\t]{{2,}}', ' ', 'g'), chr(65279), '') AS t FROM c)
SELECT doc_id, md5({_trim('t')}) AS md5, length({_trim('t')}) AS chars FROM d"""
)
def whitespace_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.normalize_whitespace(F.expr(_WS.replace("chr(65279)", "'﻿'")))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.md5("t").alias("md5"), F.length("t").cast("long").alias("chars"))


@_query(
    """WITH p AS (SELECT conv_id, list(concat_ws(chr(10), 'HEAD', 'Unit ' || CAST(turn % 2 AS STRING), text, 'FOOT') ORDER BY turn) AS pages FROM conversations GROUP BY conv_id),
x AS (SELECT conv_id, len(pages) AS n, unnest(pages) AS page, generate_subscripts(pages, 1) AS i FROM p), l AS (SELECT conv_id, n, i, list_transform(string_split(page, chr(10)), lambda s: trim(s)) AS ls FROM x),
e AS (SELECT conv_id, n, k, side, line FROM (SELECT conv_id, n, i, unnest([1, 2, 3]) AS k, ls FROM l) JOIN (SELECT unnest(['top', 'bottom']) AS side) ON true CROSS JOIN LATERAL (SELECT CASE side WHEN 'top' THEN ls[k] ELSE ls[len(ls) + 1 - k] END AS line)),
m AS (SELECT DISTINCT conv_id, side, line FROM (SELECT conv_id, n, side, k, line, count(*) AS c FROM e WHERE line IS NOT NULL AND line <> '' GROUP BY ALL) WHERE c >= greatest(2, n // 2)),
t AS (SELECT conv_id, coalesce(list(line) FILTER (side = 'top'), []) AS tops, coalesce(list(line) FILTER (side = 'bottom'), []) AS bottoms FROM m GROUP BY conv_id),
a AS (SELECT l.conv_id, l.i, l.ls, coalesce(t.tops, []) AS tops, coalesce(t.bottoms, []) AS bottoms FROM l LEFT JOIN t USING (conv_id)),
b AS (SELECT conv_id, i, bottoms, CASE WHEN i = 1 THEN ls ELSE ls[coalesce(list_position(list_transform(ls, lambda s: list_contains(tops, s)), false), len(ls) + 1):] END AS ls FROM a),
c AS (SELECT conv_id, i, list_reverse(list_reverse(ls)[coalesce(list_position(list_transform(list_reverse(ls), lambda s: list_contains(bottoms, s)), false), len(ls) + 1):]) AS ls FROM b)
SELECT conv_id, (i - 1)::INTEGER AS page, md5(array_to_string(ls, chr(10))) AS md5 FROM c"""
)
def header_dedup_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("concat_ws(chr(10), 'HEAD', concat('Unit ', CAST(turn % 2 AS STRING)), text, 'FOOT')")
    pages = cleaning.collect_pages(table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("text")), "conv_id", "turn", "text")
    return pages.select("conv_id", F.posexplode(cleaning.strip_edges(F.col("pages"))).alias("page", "t")).select("conv_id", "page", F.md5("t").alias("md5"))


# ---------------------------------------------------------------- keys and caches


@_query(f"WITH {DOCS} SELECT doc_id, file_hash, CASE WHEN doc_id % 3 = 0 THEN file_hash ELSE sha256(file_hash || chr(0) || 'vision/' || (doc_id % 3)) END AS key FROM docs")
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    signature = F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("vision/"), (F.col("doc_id") % 3).cast("string")))
    return docs_view(spark, sf_dir).select("doc_id", "file_hash", keys.document_key(F.col("file_hash"), signature).alias("key"))


@_query(
    f"""WITH {DOCS}, h AS (SELECT source, string_agg(file_hash || chr(1), '' ORDER BY file_hash) AS hs FROM docs GROUP BY source)
SELECT source, sha256('schema=v3' || chr(0) || 'system' || chr(0) || 'prompt' || chr(0) || 'cleaner=v2' || chr(0) || hs || chr(0) || 'model=m1' || chr(0) || 'embModel=' || chr(0) || 'rerankerModel=' || chr(0) || 'mode=consolidate' || chr(0)) AS key FROM h"""
)
def inference_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = docs_view(spark, sf_dir).groupBy("source").agg(F.collect_list("file_hash").alias("hashes"))
    k = keys.inference_key(F.lit("system"), F.lit("prompt"), F.col("hashes"), F.lit("m1"), F.lit(""), F.lit(""), F.lit("consolidate"))
    return g.select("source", k.alias("key"))


@_query("SELECT item_id, sha256('schema=v2' || chr(0) || 'server=http://localhost:1234' || chr(0) || 'model=bge-m3' || chr(0) || text || chr(0)) AS key FROM benchmark")
def embedding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", keys.embedding_key(F.lit("http://localhost:1234"), F.lit("bge-m3"), F.col("text")).alias("key"))


@_query(
    f"""WITH {DOCS}, cached AS (SELECT DISTINCT file_hash FROM docs JOIN labels USING (doc_id)), j AS (SELECT d.doc_id, d.source, c.file_hash IS NOT NULL AS hit FROM docs d LEFT JOIN cached c USING (file_hash))
SELECT source, count(*) FILTER (hit)::BIGINT AS hits, count(*) FILTER (NOT hit)::BIGINT AS misses FROM j GROUP BY source"""
)
def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs_view(spark, sf_dir).withColumnRenamed("file_hash", "key")
    stored = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("key", F.lit("x").alias("response"), F.col("doc_id").alias("created_at"))
    return cache.lookup(d.select("key", "source"), stored).groupBy("source").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@_query(f"WITH {DOCS}, c AS (SELECT file_hash, 'old/' || max(doc_id) AS stored_path FROM docs JOIN labels USING (doc_id) GROUP BY file_hash) SELECT d.doc_id, d.source_file AS path, c.stored_path <> d.source_file AS renamed FROM docs d JOIN c USING (file_hash)")
def cache_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs_view(spark, sf_dir).withColumnRenamed("file_hash", "key")
    stored = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("key", F.concat(F.lit("old/"), F.col("doc_id").cast("string")).alias("stored_path"), F.col("doc_id").alias("created_at"))
    return cache.lookup(d.select("doc_id", "source_file", "key"), stored).filter("hit").select("doc_id", F.col("source_file").alias("path"), (F.col("stored_path") != F.col("source_file")).alias("renamed"))


@_query(f"WITH {DOCS} SELECT file_hash, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM docs GROUP BY file_hash HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_view(spark, sf_dir).groupBy("file_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.remaining(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


# ---------------------------------------------------------------- files


@_query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files in several encodings, by turns and without a mark, decoded again: what is detected gives the text."""

    @F.pandas_udf("binary")
    def encoded(texts: pd.Series, number: pd.Series) -> pd.Series:
        def one(text: str, n: int) -> bytes:
            try:
                return text.encode(("cp1252", "utf-16-le", "utf-8", "utf-16")[n])
            except UnicodeEncodeError:
                return text.encode("utf-8")

        return pd.Series([one(t, n) for t, n in zip(texts, number, strict=True)])

    d = table(spark, sf_dir, "documents").filter("text is not null")
    files = d.select("doc_id", encoded("text", (F.col("doc_id") % 4).cast("int")).alias("content"))
    return readers.decoded_bytes(files).select("doc_id", F.md5("text").alias("text_md5"))


# Fixed values in the SQL: a page's layer is usable with 50 characters, of which 40 in a hundred are letters or digits.
_USABLE_SQL = "length(head) >= 50 AND 10 * length(regexp_replace(head, '[^\\p{L}\\p{N}]', '', 'g')) >= 4 * length(head) AND length(head) - length(replace(head, '�', '')) <= length(head) // 10"


@_query(
    """WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN ' ' ELSE coalesce(text, '') END AS layer, 'read: ' || coalesce(text, '') AS ocr FROM conversations),
h AS (SELECT conv_id, max(CASE WHEN trim(layer, E' \\t\\n\\r') <> '' THEN 1 ELSE 0 END) AS has FROM c GROUP BY conv_id)
SELECT conv_id AS doc, turn AS page, CASE WHEN has = 1 THEN layer ELSE ocr END AS page_text FROM c JOIN h USING (conv_id)"""
)
def layer_or_ocr_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of a page a turn; a third of them have a blank text layer and go to OCR as a whole."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    layer = c.withColumn("text", F.when(F.col("doc") % 3 == 0, " ").otherwise(F.col("text")))
    ocr = c.withColumn("text", F.concat(F.lit("read: "), "text"))
    return readers.text_layer_or_ocr(layer, ocr).select("doc", "page", F.col("text").alias("page_text"))


@_query(
    f"""WITH c AS (SELECT conv_id, turn, text AS layer, 'read ' || turn AS ocr, substr({_trim("coalesce(text, '')")}, 1, 500) AS head FROM conversations)
SELECT conv_id AS doc, md5(string_agg(CASE WHEN {_USABLE_SQL} THEN layer ELSE ocr END, chr(10) || chr(10) || '[[PAGE_BREAK]]' || chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM c GROUP BY conv_id"""
)
def layer_or_ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page its text layer where that is usable, else what OCR read; pages joined by the mark of a page break."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.col("text").alias("layer"), F.concat(F.lit("read "), F.col("turn").cast("string")).alias("ocr"))
    return cleaning.layer_or_ocr_by_page(c).select("doc", F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------- matching

_WORDS_SQL = "list_distinct(list_filter(string_split_regex({}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> ''))"
_FILES_SQL = """files AS (SELECT lang AS folder, CASE WHEN (doc_id // 20) % 2 = 0 THEN 'in' ELSE 'out' END AS kind, doc_id::VARCHAR AS path,
  lower(array_to_string(string_split(text, ' ')[1:CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 3 END], ' ')) AS stem, length(text) AS bytes FROM documents WHERE text <> '')"""


@_query(
    f"""WITH RECURSIVE {_FILES_SQL},
pairs AS (SELECT i.folder, i.path AS input, o.path AS output, o.bytes, i.stem AS a, o.stem AS b, len(list_intersect({_WORDS_SQL.format("i.stem")}, {_WORDS_SQL.format("o.stem")})) AS common
  FROM files i JOIN files o ON i.folder = o.folder AND i.kind = 'in' AND o.kind = 'out'),
scored AS (SELECT folder, input, output, bytes, CASE WHEN a = b THEN 1000 WHEN starts_with(b, a) THEN 900 WHEN contains(b, a) THEN 800 WHEN contains(a, b) THEN 700 WHEN common > 0 THEN 500 + 10 * common END AS score FROM pairs),
turns AS (SELECT folder, input, row_number() OVER (PARTITION BY folder ORDER BY max(score) DESC, input) AS n,
                 list({{'output': output, 'score': score}} ORDER BY score DESC, bytes DESC, output) AS wishes FROM scored WHERE score IS NOT NULL GROUP BY folder, input),
f(folder, n, taken, input, got) AS (
  SELECT folder, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::STRUCT(output VARCHAR, score INTEGER) FROM turns GROUP BY folder
  UNION ALL
  SELECT folder, n, CASE WHEN got IS NULL THEN taken ELSE list_append(taken, got.output) END, input, got
  FROM (SELECT t.folder, t.n, f.taken, t.input, list_filter(t.wishes, lambda w: NOT list_contains(f.taken, w.output))[1] AS got FROM f JOIN turns t ON t.folder = f.folder AND t.n = f.n + 1))
SELECT folder, input, got.output AS output, got.score::INTEGER AS score FROM f WHERE got IS NOT NULL"""
)
def matched_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents by turns are inputs and outputs of their language; a file is named by the first words of its text."""
    d = table(spark, sf_dir, "documents").filter("text <> ''")
    words = F.slice(F.split("text", " ", -1), 1, F.when(F.col("doc_id") % 3 == 0, 2).otherwise(3))
    kind = F.when(F.floor(F.col("doc_id") / 20) % 2 == 0, "in").otherwise("out")
    files = d.select(F.col("lang").alias("folder"), kind.alias("kind"), F.col("doc_id").cast("string").alias("path"), F.array_join(words, " ").alias("stem"), F.length("text").alias("bytes"))
    return matching.match_outputs(files)


# ---------------------------------------------------------------- packing

_PACK_CTE = f"""{DOCS}, o AS (SELECT source, doc_id, length(text) + 80 AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM docs),
f(source, doc_id, n, used, batch, place) AS (SELECT source, doc_id, n, size, 1, 1 FROM o WHERE n = 1 UNION ALL
  SELECT o.source, o.doc_id, o.n, CASE WHEN f.used + o.size > {PACK_BUDGET} THEN o.size ELSE f.used + o.size END, f.batch + (f.used + o.size > {PACK_BUDGET})::INT, CASE WHEN f.used + o.size > {PACK_BUDGET} THEN 1 ELSE f.place + 1 END
  FROM f JOIN o ON o.source = f.source AND o.n = f.n + 1)"""


def _packed(d: DataFrame) -> DataFrame:
    return packing.pack(d, "source", "doc_id", F.length("text"), PACK_BUDGET)


@_query(f"WITH RECURSIVE {_PACK_CTE} SELECT source, doc_id, batch::INTEGER AS batch, place::INTEGER AS place FROM f")
def batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(docs_view(spark, sf_dir))


_ONE_RUN_CTE = _PACK_CTE.replace("SELECT source, doc_id, length(text) + 80 AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id)", "SELECT 'all' AS source, doc_id, length(text) + 80 AS size, row_number() OVER (ORDER BY doc_id)")


@_query(f"WITH RECURSIVE {_ONE_RUN_CTE} SELECT doc_id, batch::INTEGER AS batch, place::INTEGER AS place FROM f")
def batch_packing_one_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one run, which is packed over all tasks."""
    d = docs_view(spark, sf_dir).withColumn("run", F.lit("all"))
    return packing.pack(d, "run", "doc_id", F.length("text"), PACK_BUDGET).drop("run")


_PART = "'=== Dokument #' || f.place || ': ' || d.doc_id || '.pdf ===' || chr(10) || d.text"


@_query(f"WITH RECURSIVE {_PACK_CTE} SELECT f.source, f.batch::INTEGER AS batch, count(*)::BIGINT AS n_docs, md5(string_agg({_PART}, chr(10) || chr(10) ORDER BY f.place)) AS payload_md5 FROM f JOIN docs d USING (source, doc_id) GROUP BY f.source, f.batch")
def batch_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs_view(spark, sf_dir)
    p = packing.payloads(d, _packed(d), "source", "doc_id", text.file_name(F.col("source_file")), F.col("text"))
    return p.select("source", "batch", "n_docs", F.md5("payload").alias("payload_md5"))


@_query(
    f"""WITH RECURSIVE {_PACK_CTE}, b AS (SELECT source, batch, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT source, count(*) AS n_batches FROM b GROUP BY source)
SELECT source, n_batches::BIGINT AS n_batches, string_agg('=== Výstup dávky #' || batch || '/' || n_batches || ' ===' || chr(10) || 'n=' || n, chr(10) || chr(10) ORDER BY batch) AS payload FROM b JOIN t USING (source) GROUP BY source, n_batches"""
)
def map_reduce_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    partial = _packed(docs_view(spark, sf_dir)).groupBy("source", "batch").agg(F.concat(F.lit("n="), F.count(F.lit(1)).cast("string")).alias("output"))
    return packing.reduce_payload(partial, "source")


@_query(
    f"""WITH {DOCS} SELECT source, sum(CAST(ceil(length(text) / 3.0) AS BIGINT))::BIGINT AS tokens, 22937 AS budget,
sum(CAST(ceil(length(text) / 3.0) AS BIGINT)) <= 22937 AS fits FROM docs GROUP BY source"""
)
def preflight_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs_view(spark, sf_dir).groupBy("source").agg(F.sum(packing.tokens(F.col("text"))).alias("tokens"))
    return t.withColumn("budget", F.lit(packing.token_budget())).withColumn("fits", F.col("tokens") <= F.col("budget"))


# ---------------------------------------------------------------- results and exports

_PARTIALS = "SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN concat(role, ' ', CAST(turn AS STRING)) ELSE '' END AS patient_name, CAST((turn * 7) % 5 AS DOUBLE) / 8 AS confidence, concat('r', CAST(turn AS STRING)) AS raw_response FROM conversations"


@_query(
    f"""WITH p AS ({_PARTIALS}), l AS (SELECT conv_id, list(patient_name ORDER BY turn) AS names, list(confidence ORDER BY turn) AS cs, list(raw_response ORDER BY turn) AS rs FROM p GROUP BY conv_id)
SELECT conv_id, coalesce(list_filter(names, lambda x: x <> '')[1], '') AS patient_name, list_reduce(list_concat([0.0::DOUBLE], cs), lambda a, b: CASE WHEN a = 0 THEN b WHEN b > 0 THEN (a + b) / 2 ELSE a END) AS confidence,
array_to_string(rs, chr(10) || '---' || chr(10)) AS raw_response FROM l"""
)
def merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    p = t.select("conv_id", "turn", F.expr("CASE WHEN turn % 2 = 1 THEN concat(role, ' ', CAST(turn AS STRING)) ELSE '' END").alias("patient_name"), F.expr("CAST((turn * 7) % 5 AS DOUBLE) / 8").alias("confidence"), F.concat(F.lit("r"), F.col("turn").cast("string")).alias("raw_response"))
    return results.merge(p, "conv_id", "turn")


_RAW = """CASE doc_id % 5 WHEN 0 THEN concat('{"n":', CAST(doc_id AS STRING), '}') WHEN 1 THEN concat('x =====CSV===== a;', CAST(doc_id AS STRING), ' =====TXT===== t ', coalesce(text, '')) WHEN 2 THEN CAST(doc_id AS STRING) WHEN 3 THEN concat('{"n":1} ', coalesce(text, '')) ELSE '=====TXT===== a =====CSV===== b' END"""
_SECTIONS_CTE = f"""r AS (SELECT doc_id, {_RAW} AS raw FROM documents), s AS (SELECT *, instr(raw, '=====CSV=====') AS a, instr(raw, '=====TXT=====') AS b FROM r),
t AS (SELECT *, CASE WHEN a > 0 AND b >= a + 13 THEN {_trim('substr(raw, a + 13, b - a - 13)')} END AS csv, CASE WHEN a > 0 AND b >= a + 13 THEN {_trim('substr(raw, b + 13)')} END AS txt FROM s)"""


@_query(f"WITH {_SECTIONS_CTE} SELECT doc_id, csv, txt FROM t WHERE csv <> '' AND txt <> ''")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "documents").select("doc_id", F.expr(_RAW).alias("raw"))
    csv, txt = text.sections(F.col("raw"))
    return r.select("doc_id", csv.alias("csv"), txt.alias("txt")).filter("csv is not null")


@_query(f"WITH {_SECTIONS_CTE} SELECT doc_id, CASE WHEN csv <> '' AND txt <> '' THEN 'sections' WHEN json_valid(raw) THEN 'json' ELSE 'text' END AS kind FROM t")
def raw_kind_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "documents").select("doc_id", F.expr(_RAW).alias("raw"))
    csv, _ = text.sections(F.col("raw"))
    r = r.withColumn("csv", csv).withColumn("json", is_json("raw"))
    return r.select("doc_id", F.when(F.col("csv").isNotNull(), F.lit("sections")).when(F.col("json"), F.lit("json")).otherwise(F.lit("text")).alias("kind"))


@_query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 10) / 10.0::DOUBLE END AS confidence, doc_id % 3 = 0 AS valid FROM documents")
def strict_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ", ".join([*(f'"{n}":"v"' for n in ("source_file", "patient_name", "patient_id", "birth_date", "admission_date", "discharge_date", "discharge_status")), *(f'"{n}":[]' for n in ("diagnoses", "medication", "lab_values", "warnings"))])
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Answer: {" + fields + ', "confidence": '), (F.col("doc_id") % 10 / 10).cast("string"), F.lit("} done"))).when(F.col("doc_id") % 3 == 1, F.lit('{"confidence": true}')).otherwise(F.lit("none"))
    rows = table(spark, sf_dir, "documents").select("doc_id", strict_json(raw).alias("json"))
    return rows.select("doc_id", F.get_json_object("json", "$.confidence").cast("double").alias("confidence"), F.col("json").isNotNull().alias("valid"))


_CSV_FIELD = lambda x: f"""'"' || replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '"', '""') || '"'"""


def results_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result row for each document, with whole texts in its fields."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit("/"), "lang", F.lit(".pdf")).alias("source_file"), F.expr("concat('a \"', lang, '\" ', chr(13), chr(10), source)").alias("patient_name"),
        F.col("doc_id").cast("string").alias("patient_id"), F.lit("").alias("birth_date"), F.lit("1.1.").alias("admission_date"), F.lit("2.1.").alias("discharge_date"), F.lit("home").alias("discharge_status"),
        F.array("source", "text").alias("diagnoses"), F.array().cast("array<string>").alias("medication"), F.array(F.lit("x")).alias("lab_values"), F.array("lang").alias("warnings"),
        (F.col("n_chars") / 7).alias("confidence"), F.expr(_RAW).alias("raw_response"),
    )


_NAME = "'a \"' || lang || '\" ' || chr(13) || chr(10) || source"
_CSV_SQL = " || ',' || ".join(
    _CSV_FIELD(x)
    for x in ("'in/' || doc_id || '/' || lang || '.pdf'", _NAME, "doc_id::VARCHAR", "''", "'1.1.'", "'2.1.'", "source || ' | ' || text", "''", "'x'", "'home'", "lang", "printf('%.4f', n_chars / 7.0::DOUBLE)")
)


@_query(f"SELECT doc_id, md5({_CSV_SQL}) AS line_md5 FROM documents")
def export_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results_view(spark, sf_dir)
    return r.select("doc_id", F.md5(sinks.csv_line(r)).alias("line_md5"))


@_query(
    f"""WITH r AS (SELECT *, {_RAW} AS raw FROM documents) SELECT doc_id, md5('Soubor: in/' || doc_id || '/' || lang || '.pdf' || chr(10) || 'Pacient: ' || {_NAME} || chr(10) || 'ID: ' || doc_id || chr(10)
|| 'Přijetí: 1.1. | Propuštění: 2.1.' || chr(10) || 'Diagnózy: ' || source || ', ' || text || chr(10) || 'Medikace: ' || chr(10) || 'Laboratorní hodnoty: x' || chr(10) || 'Stav: home' || chr(10)
|| 'Confidence: ' || printf('%.2f', n_chars / 7.0::DOUBLE) || chr(10) || 'Varování: ' || lang || chr(10) || '--- Raw odpověď modelu ---' || chr(10) || raw || chr(10) || repeat('-', 45)) AS block_md5 FROM r"""
)
def export_txt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results_view(spark, sf_dir)
    return r.select("doc_id", F.md5(sinks.txt_block(r)).alias("block_md5"))


@_query(
    f"""WITH {_SECTIONS_CTE}, n AS (SELECT t.*, lang || '_raw' || CASE WHEN row_number() OVER w > 1 THEN '_' || row_number() OVER w ELSE '' END AS base,
CASE WHEN csv <> '' AND txt <> '' THEN 'sections' WHEN json_valid(raw) THEN 'json' ELSE 'text' END AS kind FROM t JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY lang ORDER BY 'in/' || doc_id || '/' || lang || '.pdf')),
f AS (SELECT base || '.csv' AS name, kind, chr(65279) || csv AS content FROM n WHERE kind = 'sections' UNION ALL SELECT base || '.txt', kind, txt FROM n WHERE kind = 'sections'
UNION ALL SELECT base || '.json', kind, CASE doc_id % 5 WHEN 0 THEN '{{' || chr(10) || '  "n": ' || doc_id || chr(10) || '}}' ELSE raw END FROM n WHERE kind = 'json' UNION ALL SELECT base || '.txt', kind, raw FROM n WHERE kind = 'text')
SELECT name, kind, md5(content) AS content_md5 FROM f"""
)
def raw_export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.raw_files(results_view(spark, sf_dir)).select("name", "kind", F.md5("content").alias("content_md5"))


@_query("SELECT doc_id, source || CASE WHEN row_number() OVER (PARTITION BY lower(source) ORDER BY doc_id) > 1 THEN '_' || row_number() OVER (PARTITION BY lower(source) ORDER BY doc_id) ELSE '' END || '.json' AS name FROM documents")
def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("in/"), "source", F.lit(".pdf")).alias("path"))
    return sinks.unique_names(d, "path", "doc_id", ".json").select("doc_id", "name")


@_query(
    f"""WITH {_SECTIONS_CTE}, v AS (SELECT lang AS base_name, 'in/' || doc_id || '/' || lang || '.pdf' AS f, CASE WHEN csv <> '' AND txt <> '' THEN '{{"csv":' || to_json(csv) || ',"txt":' || to_json(txt) || '}}'
WHEN json_valid(raw) THEN raw ELSE to_json(raw)::VARCHAR END AS value FROM t JOIN documents USING (doc_id)) SELECT base_name, arg_max(value, f) AS value FROM v GROUP BY base_name"""
)
def raw_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.raw_responses(results_view(spark, sf_dir))


@_query(f"SELECT doc_id, md5(replace(replace(replace(replace(replace({NOISY}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS xml_md5, md5(translate({NOISY}, '|' || chr(13) || chr(10), '¦  ')) AS log_md5 FROM documents")
def escaped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.expr(NOISY)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.xml_text(n)).alias("xml_md5"), F.md5(text.log_field(n)).alias("log_md5"))


# ---------------------------------------------------------------- prompts, profiles, checks

_MODE_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(t), '{w}')''' for w in ws)} THEN '{m}'" for m, ws in text.MODE_KEYWORDS.items()) + " END"


@_query(f"WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Agreguj ' || text WHEN 1 THEN 'Once PER FILE please' ELSE text END AS t FROM documents) SELECT doc_id, {_MODE_SQL} AS mode FROM p")
def prompt_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('Agreguj ', text) WHEN 1 THEN 'Once PER FILE please' ELSE text END")
    return table(spark, sf_dir, "documents").select("doc_id", text.prompt_mode(p).alias("mode"))


@_query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'keep ' || doc_id ELSE 'q ' || doc_id END AS prompt FROM documents")
def thinking_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('keep ', doc_id) WHEN 1 THEN concat(' ', chr(10), ' /No_Think ', chr(10), 'q ', doc_id) ELSE concat('thinking', chr(10), 'q ', doc_id, ' ') END")
    return table(spark, sf_dir, "documents").select("doc_id", text.without_thinking_mark(p).alias("prompt"))


_USABLE = "CASE doc_id % 3 WHEN 0 THEN concat('?!*', repeat('#-', 200), text) WHEN 1 THEN concat(repeat('�', 60), text) ELSE text END"


@_query(
    f"""WITH a AS (SELECT doc_id, {_trim(_USABLE)} AS t FROM documents), b AS (SELECT doc_id, t, substr(t, 1, 500) AS h FROM a)
SELECT doc_id, (length(t) >= 50 AND 10 * length(regexp_replace(h, '{text.NOT_ALNUM}', '', 'g')) >= 4 * length(h) AND length(h) - length(replace(h, '�', '')) <= length(h) // 10) AS usable FROM b"""
)
def usable_text_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.has_usable_text(F.expr(_USABLE)).alias("usable"))


_OUTPUT = "CASE doc_id % 4 WHEN 0 THEN '[Chyba x' WHEN 1 THEN repeat(concat(lpad('', 99, 'ab'), '.'), 8) WHEN 2 THEN ' ' ELSE text END"


@_query(
    f"""WITH a AS (SELECT doc_id, {_trim(_OUTPUT)} AS t, length(text) AS n FROM documents),
b AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS ls, list_transform(range(0, greatest(length(t), 1), 100), lambda i: substr(t, i + 1, 100)) AS bs FROM a)
SELECT doc_id, CASE WHEN t = '' THEN 'empty' ELSE array_to_string(list_filter([CASE WHEN len(ls) > 0 AND len(list_filter(ls, lambda x: NOT starts_with(trim(x), '[Chyba'))) = 0 THEN 'only_errors' END,
CASE WHEN n > 200 AND length(t) < n // 20 THEN 'short' END, CASE WHEN n > 200 AND length(t) > 2 * n THEN 'long' END,
CASE WHEN length(t) > 500 AND list_max(list_transform(list_distinct(bs), lambda x: len(list_filter(bs, lambda y: y = x)))) >= 3 THEN 'repeated' END], lambda x: x IS NOT NULL), ',') END AS warnings FROM b"""
)
def output_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(text.output_warnings(F.expr(_OUTPUT), F.length("text")), ",").alias("warnings"))


_ANSWER = "CASE (conv_id + turn) % 3 WHEN 0 THEN 'Ano, určitě.' WHEN 1 THEN 'NE!' ELSE CASE WHEN conv_id % 5 = 0 THEN 'nevím' ELSE 'yes' END END"


@_query(
    f"""WITH a AS (SELECT conv_id, {_ANSWER} AS t FROM conversations), b AS (SELECT conv_id, CASE WHEN t IN ('Ano, určitě.', 'yes') THEN true WHEN t = 'NE!' THEN false END AS y FROM a)
SELECT conv_id, CASE WHEN count(*) > 1 AND count(y) = count(*) THEN CASE WHEN bool_or(y) THEN 'ANO' ELSE 'NE' END END AS verdict FROM b GROUP BY conv_id"""
)
def binary_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "conversations").select("conv_id", F.expr(_ANSWER).alias("t"))
    return results.binary_vote(r, "conv_id", "t", PROMPT)


_EXT = "['py', 'CSV', 'docx', 'md', 'pdf', 'yaml', 'zzz']"


@_query(f"SELECT doc_id, CASE {_EXT}[doc_id % 7 + 1] WHEN 'py' THEN 'code' WHEN 'yaml' THEN 'code' WHEN 'CSV' THEN 'tabular' WHEN 'docx' THEN 'word' ELSE 'medical' END AS profile FROM documents")
def profile_for_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in ("py", "CSV", "docx", "md", "pdf", "yaml", "zzz")]), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.profile_of_extension(ext).alias("profile"))


@_query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'gpt-oss-20b' WHEN 1 THEN 'qwen3-coder' WHEN 2 THEN 'llama' ELSE 'default' END AS profile, CASE doc_id % 4 WHEN 0 THEN 1200 WHEN 2 THEN 900 ELSE 1000 END AS chunk_size FROM documents")
def profile_for_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.operators.profiles import chunk_profile

    model = F.element_at(F.array(*[F.lit(x) for x in ("x/GPT-OSS-20B-gguf", "Qwen3-8b", "meta-llama-3", "mistral")]), (F.col("doc_id") % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", model.alias("model"))
    return chunk_profile(d, "model").select("doc_id", "profile", "chunk_size")


# ---------------------------------------------------------------- metrics and logs


@_query("SELECT event_type AS phase, count(*)::BIGINT AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY event_type")
def phase_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.phase_totals(table(spark, sf_dir, "events"), "event_type", "value")
    return m.select(F.col("event_type").alias("phase"), "n", F.round("total", 4).alias("total"), "most")


@_query("WITH g AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_s FROM events) SELECT event_id, user_id, round(gap_s, 3) AS gap_s FROM g WHERE gap_s > 600")
def progress_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return metrics.stalls(e, "user_id", "ts", 600).select("event_id", "user_id", F.round("gap_s", 3).alias("gap_s"))


@_query(
    """WITH w AS (SELECT event_id, user_id, count(*) OVER a AS done, count(*) OVER (PARTITION BY user_id) AS total, epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER a AS elapsed FROM events
WINDOW a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, done::BIGINT AS done, round(elapsed / done * greatest(total - done, 0), 2) AS eta_s FROM w"""
)
def eta_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return metrics.eta(e, "user_id", "ts").select("event_id", "done", F.round("eta_s", 2).alias("eta_s"))


@_query(
    """WITH a AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'finish' ELSE 'progress' END AS kind, epoch_us(ts) // 1000 AS ms FROM events),
b AS (SELECT *, CASE kind WHEN 'start' THEN 0 WHEN 'progress' THEN 1 ELSE 2 END AS k FROM a),
p AS (SELECT *, coalesce(count(*) FILTER (kind = 'finish') OVER (PARTITION BY user_id ORDER BY ms, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM b),
s AS (SELECT *, CASE kind WHEN 'progress' THEN ms + 600001 WHEN 'start' THEN ms + 300000 END AS due FROM p QUALIFY kind <> 'start' OR row_number() OVER (PARTITION BY user_id, part ORDER BY ms, k) = 1),
w AS (SELECT *, lead(ms) OVER v AS next_ms, lag(kind) OVER v AS was, lag(due) OVER v AS was_due FROM s WINDOW v AS (PARTITION BY user_id, part ORDER BY ms, k)),
o AS (SELECT user_id, CASE WHEN kind = 'finish' THEN 'finished' WHEN kind = 'start' THEN 'starting' WHEN was IS NULL OR was = 'start' OR ms >= was_due THEN 'ok' END AS health, ms AS at_ms FROM w
      UNION ALL SELECT user_id, 'stuck', due FROM w WHERE due IS NOT NULL AND (next_ms IS NULL OR next_ms >= due))
SELECT * FROM o WHERE health IS NOT NULL"""
)
def run_health_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs: a signup starts one, a purchase ends it. The same rules as the stream's, over the whole log."""
    kind = F.when(F.col("event_type") == "signup", health.START).when(F.col("event_type") == "purchase", health.FINISH).otherwise(health.PROGRESS)
    e = table(spark, sf_dir, "events").select("user_id", kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return health.health_of(e, "user_id", "kind", "ts", 300, 600).select("user_id", "health", F.unix_millis("at").alias("at_ms"))


@_query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 300")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tail(table(spark, sf_dir, "events"), "ts", 300).select("event_id", "event_type")


@_query("SELECT page_id, md5(html) AS md5, length(html) AS chars FROM pages")
def html_raw_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5("html").alias("md5"), F.length("html").cast("long").alias("chars"))


@_query("WITH n AS (SELECT doc_id, source || '/' || doc_id || '.pdf' AS f FROM documents) SELECT f AS source_file, row_number() OVER (ORDER BY lpad(regexp_extract(f, '[0-9]+', 0), 20, '0'), lpad(regexp_extract(f, '/([0-9]+)', 1), 20, '0'))::INTEGER AS place FROM n")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their places in natural order."""
    d = docs_view(spark, sf_dir).select("source_file")
    return metrics.ranked(d, text.natural_key(F.col("source_file")), "place").withColumn("place", F.col("place").cast("int"))


# ---------------------------------------------------------------- modes


@_query("SELECT doc_id, source || '/' || doc_id || '.pdf' AS source_file, 'chars ' || length(text) AS patient_name, 0.5::DOUBLE AS confidence FROM documents WHERE length(text) > 0")
def fast_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs_view(spark, sf_dir).filter(F.length("text") > 0)
    return modes.fast(d, "doc_id", "source_file", "text", "prompt").select("doc_id", "source_file", "patient_name", "confidence")


@_query(f"WITH {DOCS} SELECT source, 'Consolidated (' || count(*) || ' dokumentů)' AS source_file, count(*)::BIGINT AS n_docs FROM docs GROUP BY source")
def consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.consolidated(docs_view(spark, sf_dir), "source", "doc_id", "source_file", "text", "prompt").select("source", "source_file", "n_docs")


@_query("SELECT doc_id AS path_id, CASE WHEN length(text) % 2 = 0 AND length(trim(source)) >= 8 THEN source ELSE text END AS page_text FROM documents")
def ocr_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(0).alias("page"), "text", "source")
    primary = d.filter(F.length("text") % 2 == 0).select("doc", "page", F.col("source").alias("text"))
    return cleaning.text_or_fallback(primary, d).select(F.col("doc").alias("path_id"), F.col("text").alias("page_text"))


@_query(
    r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, '. ', '.' || chr(10) || chr(10)), '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL),
f(doc_id, ps, i, o, out) AS (SELECT doc_id, ps, 1, '', []::VARCHAR[] FROM d
UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN o = '' THEN ps[i] WHEN length(o) + 2 + length(ps[i]) <= 1000 THEN o || chr(10) || chr(10) || ps[i] WHEN t = '' THEN ps[i] ELSE t || chr(10) || chr(10) || ps[i] END,
CASE WHEN o = '' OR length(o) + 2 + length(ps[i]) <= 1000 THEN out ELSE list_append(out, o) END
FROM (SELECT *, CASE WHEN length(o) <= 120 THEN o ELSE regexp_replace(right(o, 120), '^\S*\s+', '') END AS t FROM f) WHERE i <= len(ps)),
c AS (SELECT doc_id, CASE WHEN o = '' THEN out ELSE list_append(out, o) END AS cs FROM f WHERE i > len(ps)),
w AS (SELECT doc_id, flatten(list_transform(cs, lambda x: CASE WHEN length(x) > 2000 THEN list_transform(range(0, CAST(ceil((length(x) - 120) / 880.0) AS BIGINT)), lambda k: substr(x, k * 880 + 1, 1000)) ELSE [x] END)) AS cs FROM c)
SELECT doc_id, (i - 1)::INTEGER AS chunk_idx, length(cs[i])::INTEGER AS chunk_chars FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM w)"""
)
def smart_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n")).alias("text"))
    return d.select("doc_id", F.posexplode(chunking.smart_chunk_array(F.col("text"), 1000, 120)).alias("chunk_idx", "chunk")).select("doc_id", "chunk_idx", F.length("chunk").alias("chunk_chars"))


# ---------------------------------------------------------------- requests, caches, layout, rollups

_RUN_CONTEXT, _RUN_TOKENS = 60_000, 42_000
_NUMBERED = f"{DOCS}, n AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM docs)"


@_query(
    f"""WITH {_NUMBERED}, u AS (SELECT source, 'prompt' || chr(10) || chr(10) || 'Vstupní dokumenty (' || count(*) || '):' || chr(10)
|| string_agg('=== Dokument #' || i || ': ' || doc_id || '.pdf ===' || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS usr FROM n GROUP BY source)
SELECT source, ceil((length(usr) + 134) / 3.0)::BIGINT AS tokens, ceil((length(usr) + 134) / 3.0) <= {_RUN_TOKENS} AS fits, md5(usr) AS user_md5 FROM u"""
)
def consolidate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole request over each folder, and its size reckoned from lengths alone."""
    d, columns = docs_view(spark, sf_dir), ("source", "doc_id", "source_file", "text", "prompt")
    totals = modes.run_totals(d, *columns).select("source", "tokens", (F.col("tokens") <= packing.token_budget(_RUN_CONTEXT)).alias("fits"))
    return totals.join(modes.single_requests(d, *columns), "source").select("source", "tokens", "fits", F.md5("user").alias("user_md5"))


_BIG_PACK = _PACK_CTE.replace(str(PACK_BUDGET), "125120")


@_query(
    f"""WITH RECURSIVE {_BIG_PACK}, t AS (SELECT source, max(batch) AS n_batches FROM f GROUP BY source),
u AS (SELECT f.source, f.batch, count(*) AS n, string_agg({_PART}, chr(10) || chr(10) ORDER BY f.place) AS payload FROM f JOIN docs d USING (source, doc_id) GROUP BY f.source, f.batch)
SELECT source, batch::INTEGER AS batch, n_batches::INTEGER AS n_batches, md5('[Toto je dávka #' || batch || ' z ' || n_batches
|| '. Zpracuj jen přiložené dokumenty a vrať výstup ve stejném formátu, jako bys měl jen tyto dokumenty. Deduplikace napříč dávkami proběhne v další fázi.]' || chr(10) || chr(10) || 'prompt' || chr(10) || chr(10)
|| 'Vstupní dokumenty v této dávce (' || n || '):' || chr(10) || payload) AS user_md5 FROM u JOIN t USING (source)"""
)
def map_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modes.batch_requests(docs_view(spark, sf_dir), "source", "doc_id", "source_file", "text", "prompt", _RUN_CONTEXT)
    return m.select("source", "batch", "n_batches", F.md5("user").alias("user_md5"))


@_query(
    f"""WITH {_CHUNK_CTE}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_SCORE_SQL} DESC, chunk_idx) AS r FROM c),
b AS (SELECT *, len(list_intersect(list_distinct(string_split_regex(lower(chunk), '[ \\n]+')), {sorted(set(QUERY_TEXT.split()))})) AS s FROM a WHERE r <= 20),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, r) AS k FROM b)
SELECT doc_id, md5(string_agg(chunk, chr(10) || chr(10) ORDER BY k)) AS context_md5 FROM e WHERE k <= 6 GROUP BY doc_id"""
)
def search_reranked_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of SEARCH with an embedder and a reranker passed in."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").filter(F.length("text") > 0)
    return modes.retrieved(d, "doc_id", "text", QUERY_TEXT, lambda: letter_embedder, lambda: overlap_reranker).select("doc_id", F.md5("__context").alias("context_md5"))


@_query(
    f"""WITH {DOCS}, c AS (SELECT DISTINCT file_hash FROM docs JOIN labels USING (doc_id)), j AS (SELECT d.*, c.file_hash IS NOT NULL AS hit FROM docs d LEFT JOIN c USING (file_hash))
SELECT source, count(*)::BIGINT AS n, count(*) FILTER (hit)::BIGINT AS from_cache, md5(string_agg(CASE WHEN hit THEN 'old' ELSE upper(file_hash) END, ',' ORDER BY doc_id)) AS answers_md5 FROM j GROUP BY source"""
)
def cache_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered from a cache of labelled documents, else computed once for each key."""
    d = docs_view(spark, sf_dir).withColumnRenamed("file_hash", "key")
    stored = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("key", F.lit("old").alias("response"), F.current_timestamp().alias("created_at"))
    answers, _ = cache.fill(d.select("key", "source", "doc_id"), stored, lambda rows: rows.withColumn("response", F.upper("key")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "response"))), lambda x: x["response"])
    return answers.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("response") == "old").alias("from_cache"), F.md5(F.array_join(listed, ",")).alias("answers_md5"))


@_query(
    f"""WITH x AS (SELECT doc_id, {_trim('text')} AS t, source, (doc_id % 4)::INTEGER AS p FROM documents),
b AS (SELECT doc_id, p AS page, 'heading' AS type, t FROM x WHERE t <> '' AND length(t) <= 20000 UNION ALL SELECT doc_id, 7, 'table', source FROM x UNION ALL SELECT doc_id, NULL, NULL, source || '!' FROM x)
SELECT doc_id, page, type, md5(t) AS text_md5 FROM b"""
)
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks out of a layout extractor's JSON: names by priority, types in lower case, repeated blocks once."""
    page = (F.col("doc_id") % 4).cast("string")
    said = F.to_json(
        F.struct(
            F.struct(F.lit(" ").alias("text"), F.col("text").alias("md"), page.alias("pageIndex"), F.lit("Heading").alias("label"), F.lit("x").alias("kind")).alias("first"),
            F.array(*[F.struct(F.col("source").alias("content"), F.lit("Table").alias("type"), F.struct(F.lit(7).alias("page")).alias("bbox"))] * 2).alias("kids"),
            F.struct(F.concat("source", F.lit("! ")).alias("value"), F.lit("x").alias("page")).alias("last"),
        )
    )
    rows = readers.block_rows(table(spark, sf_dir, "documents").select("doc_id", said.alias("said")), "said")
    return rows.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.page", "b.type", F.md5("b.text").alias("text_md5"))


_PHASE = "CASE event_type WHEN 'click' THEN 'scan' WHEN 'view' THEN 'ocr' WHEN 'purchase' THEN 'text' ELSE 'inference' END"


@_query(
    f"""WITH l AS (SELECT {_PHASE} AS phase, value, user_id, 1 AS pages FROM events), s AS (SELECT coalesce(sum(value) FILTER (phase = 'scan'), 0) AS a, coalesce(sum(value) FILTER (phase <> 'scan'), 0) AS b, max(user_id) AS d, sum(pages) AS p FROM l)
SELECT d AS n_docs, p::BIGINT AS n_pages, round(b / p, 6) AS avg_page_ms, round((a + b) / d, 6) AS avg_doc_ms, round(d * 60000.0 / (a + b), 6) AS docs_per_minute FROM s"""
)
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.expr(_PHASE).alias("phase"), "value", "user_id", F.lit(1).alias("pages"))
    r = metrics.rollup(log, "phase", "value", "user_id", "pages")
    return r.select("n_docs", "n_pages", *[F.round(c, 6).alias(c) for c in ("avg_page_ms", "avg_doc_ms", "docs_per_minute")])


@_query(
    f"""WITH {DOCS} SELECT count(*)::BIGINT AS found, count(*) FILTER (l.doc_id IS NOT NULL)::BIGINT AS cached, count(*) FILTER (length(d.text) < 50)::BIGINT AS read_by_ocr, count(*) FILTER (l.toxic = 0)::BIGINT AS completed
FROM docs d LEFT JOIN labels l USING (doc_id)"""
)
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs_view(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = d.select(F.col("toxic").isNotNull().alias("cached"), (F.length("text") < 50).alias("ocr"), F.when(F.col("toxic") == 0, F.lit("OK")).otherwise(F.lit("ERR")).alias("status"))
    return metrics.run_counters(rows, "status", "cached", "ocr")


@_query(
    """WITH g AS (SELECT event_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS gap, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id FROM g WHERE gap IS NULL OR gap >= 3600 OR n % 5 = 0"""
)
def throttled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return metrics.throttled(e, "user_id", "ts", 3600, 5).select("event_id")


@_query("SELECT doc_id, CASE WHEN length(text) > 240 THEN substr(text, 1, 240) || '…' ELSE text END AS said, md5(nfc_normalize(replace(text, 'e', 'e' || chr(769)))) AS nfc_md5 FROM documents")
def error_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a text goes into an error message, and the text's composed form."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.snippet(F.col("text")).alias("said"), F.md5(text.nfc(F.replace(F.col("text"), F.lit("e"), F.lit("e\u0301")))).alias("nfc_md5"))


@_query(
    """SELECT conv_id, turn, CASE WHEN turn > 0 AND max(turn) OVER w > 0 THEN 'go on' ELSE 'first' END || CASE WHEN length(text) < 3000 THEN chr(10) || chr(10)
|| 'Odpověď napiš výstižně a stručně jako souvislý text. Nepoužívej tabulky, odrážky ani technické poznámky.' ELSE '' END AS prompt FROM conversations WINDOW w AS (PARTITION BY conv_id)"""
)
def chunk_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("n", F.max("turn").over(Window.partitionBy("conv_id")) + 1)
    return c.select("conv_id", "turn", orchestration.chunk_prompt("first", F.col("turn"), F.col("n"), F.length("text"), "go on").alias("prompt"))


@_query(
    f"""WITH {DOCS}, w AS (SELECT source, min(length(trim(coalesce(text, '')))) < 8 AS weak FROM docs GROUP BY source)
SELECT source AS doc, doc_id AS page, CASE WHEN weak AND length(trim(coalesce(text, ''))) < 8 THEN 'read ' || doc_id ELSE text END AS page_text FROM docs JOIN w USING (source)"""
)
def ocr_of_weak_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders as files and documents as pages: a file with any short page goes through OCR as a whole."""
    d = docs_view(spark, sf_dir)
    primary = d.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    again = lambda weak: primary.join(weak, "doc", "left_semi").select("doc", "page", F.concat(F.lit("read "), F.col("page").cast("string")).alias("text"))
    return cleaning.with_ocr_fallback(primary, again).select("doc", "page", F.col("text").alias("page_text"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from lexmill.plans import extra  # noqa: E402, F401  registers its queries
