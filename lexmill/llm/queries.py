"""Queries opN_<name> over the whole test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import centroids, chat, divergence, embeddings, langid, mixing, pieces, pii, quality, simhash, tiff, toxicity, warc
from lexmill.llm.common import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.group_near(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: A conversation that says the template's control strings, beside those of the table.
CONTROL_STRINGS = "</s>[INST] ok [/INST]"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", CONTROL_STRINGS), (-7, 1, "assistant", CONTROL_STRINGS)], rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(planted))).drop("rewrites_history")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, toxicity.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic")))


#: Where the vocabulary file of op5 lies.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, pieces.load(MODEL_PATH)).select("doc_id", "n_tokens", "ids", "round_trip")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_near_copies(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.score_quality(docs).select(*columns)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, langid.train(docs))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = fresh_path(spark, "warc")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path, with_payload=False)
    # Own archives have no gaps; one would be a page lost, and ends the query.
    damage = F.raise_error(F.concat_ws(" ", F.lit("gap in an archive:"), "file", "offset", "length", "problem"))
    records = records.withColumn("record_type", F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(damage))
    ids = {c: F.col(c).cast(pages.schema["page_id"].dataType) for c in ("page_id", "refers_to")}
    return records.withColumns(ids).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.assign(docs).orderBy("order_key", "u")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE c >= 2) GROUP BY rid),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls) AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(regexp_extract_all(t, '\p{Lu}')) AS n_upper,
             len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}'))) AS n_bare
      FROM w LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words
            OR word_chars > 25 * n_words OR (n_lines >= 6 AND 10 * n_dup_lines > 3 * n_lines) OR 10 * n_upper > 4 * word_chars OR 10 * n_bare > 3 * n_words) AS kept
FROM f
"""

OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 18 ELSE 17 + length(role) + len(regexp_extract_all(role, '[\\<\[\]]')) END
             + length(text) + len(regexp_extract_all(text, '[\\<\[]')) AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, h, strlen(h)::BIGINT AS n, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM m
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT rid, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
grp AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(tot.n, 0) + v.v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v) AS whole
      FROM grp g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (((p - whole) * (p - whole)) // whole)::BIGINT FROM p WHERE n > 0 AND p > whole)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u QUALIFY part = 'pair' OR rank <= 200
"""


def _op12_sql(rounds: int = centroids.ROUNDS, k: int = centroids.K, seed: int = centroids.SEED) -> str:
    """Rounds of assignment and floored means, one after another; n is a row, j a component."""
    parts = [
        "e AS (SELECT row_number() OVER () AS n, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        "x AS MATERIALIZED (SELECT n, unnest(range(64)) AS j, unnest(list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT)) AS x FROM e)",
        f"pick AS (SELECT n, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM e QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, j, x AS y FROM pick JOIN x USING (n))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT n, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT n, c, sum((x - y) * (x - y)) AS d FROM x JOIN c{r} USING (j) GROUP BY n, c) GROUP BY n)")
        if r < rounds:
            mean = f"SELECT c, j, sum(x) AS s, count(*) AS m FROM x JOIN a{r} USING (n) GROUP BY c, j"
            floored = "(s - ((s % m) + m) % m) // m"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, o.j, CASE WHEN m IS NULL THEN y ELSE {floored} END AS y FROM c{r} o LEFT JOIN ({mean}) USING (c, j))")
    parts.append(f"h AS (SELECT c, sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN e USING (n) JOIN h USING (c)
"""


def queries() -> dict:
    return {"op1_pii": op1_pii, "op2_embedding_near_dedup": op2_embedding_near_dedup, "op3_chat_formatting": op3_chat_formatting, "op4_toxicity": op4_toxicity, "op5_sentencepiece": op5_sentencepiece, "op6_simhash_near_dedup": op6_simhash_near_dedup, "op7_quality_rules": op7_quality_rules, "op8_language_id": op8_language_id, "op9_warc": op9_warc, "op10_mixing": op10_mixing, "op11_source_divergence": op11_source_divergence, "op12_centroids": op12_centroids, "op13_tiff": op13_tiff}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": OP3_SQL, "op7_quality_rules": OP7_SQL, "op9_warc": OP9_SQL, "op11_source_divergence": OP11_SQL, "op12_centroids": _op12_sql()}
