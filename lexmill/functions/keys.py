"""Content keys: lower-case SHA-256 over fields that end in NUL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL, ONE = "\u0000", "\u0001"
INFERENCE_SCHEMA, EMBEDDING_SCHEMA, CLEANER = "v3", "v2", "v2"


def _fed(*fields: Column) -> Column:
    return F.concat(*[x for f in fields for x in (f, F.lit(NUL))])


def document_key(file_hash: Column, signature: Column) -> Column:
    """The file's hash, or its digest with the settings that the text depends on."""
    return F.when(F.trim(signature) == "", file_hash).otherwise(F.sha2(F.concat(file_hash, F.lit(NUL), signature), 256))


def inference_key(system: Column, prompt: Column, hashes: Column, model: Column, embedding_model: Column, reranker: Column, mode: Column) -> Column:
    listed = F.array_join(F.transform(F.array_sort(hashes), lambda h: F.concat(h, F.lit(ONE))), "")
    named = lambda name, value: F.concat(F.lit(f"{name}="), value)
    head = _fed(F.lit(f"schema={INFERENCE_SCHEMA}"), system, prompt, F.lit(f"cleaner={CLEANER}"), listed)
    return F.sha2(F.concat(head, _fed(named("model", model), named("embModel", embedding_model), named("rerankerModel", reranker), named("mode", mode))), 256)


def embedding_key(server: Column, model: Column, text: Column) -> Column:
    return F.sha2(_fed(F.lit(f"schema={EMBEDDING_SCHEMA}"), F.concat(F.lit("server="), server), F.concat(F.lit("model="), model), text), 256)
