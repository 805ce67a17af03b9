"""Small dimension tables of settings, joined by broadcast (their size is fixed)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.cache import VECTORS, Store, latest

# Chunk profiles by the model they suit, first match wins, the last is the default.
CHUNK_PROFILES = (
    ("gpt-oss-20b", ("gpt-oss-20b", "gpt oss 20b"), 1200, 150, "rag-bge-m3-c1200-o150-v1024"),
    ("qwen3-coder", ("qwen3-coder", "qwen coder", "qwen3"), 1000, 120, "rag-bge-m3-c1000-o120-v1024"),
    ("llama", ("llama", "meta-llama"), 900, 120, "rag-bge-m3-c900-o120-v1024"),
    ("default", (), 1000, 120, "rag-bge-m3-c1000-o120-v1024"),
)
EMBEDDING_MODEL, VECTOR_SIZE = "bge-m3", 1024


def chunk_profile(rows: DataFrame, model: str) -> DataFrame:
    """rows with profile, chunk_size, chunk_overlap and collection of the first profile that matches the model."""
    low, out = F.lower(F.col(model)), None
    for name, matchers, size, overlap, collection in CHUNK_PROFILES:
        value = F.struct(F.lit(name).alias("profile"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"), F.lit(collection).alias("collection"))
        if matchers:
            hit = low.rlike("|".join(m.replace("-", "[-]") for m in matchers))
            out = F.when(hit, value) if out is None else out.when(hit, value)
        else:
            out = out.otherwise(value)
    return rows.withColumn("__profile", out).select("*", "__profile.*").drop("__profile")


def with_overrides(builtin: DataFrame, own: DataFrame, key: str = "id") -> DataFrame:
    """Own profiles, and the built-in ones whose id they don't take."""
    return own.unionByName(builtin.join(own.select(key), key, "left_anti"), allowMissingColumns=True)


def manifest_mismatches(manifest: dict, size: int, overlap: int, model: str, vector_size: int, collection: str, profile: str) -> list[str]:
    """Names of the properties in which a vector collection differs from what is asked for."""
    asked = {"profile": profile, "collection": collection, "chunk_size": size, "chunk_overlap": overlap, "embedding_model": model, "vector_size": vector_size}
    return [k for k, v in asked.items() if manifest.get(k) != v]


class MismatchError(Exception):
    """A collection that was made for something else; says in which properties."""


class Collection:
    """Vectors of one profile: a manifest of one row, made with the first vectors, and a store in which the last vector of
    each key counts."""

    def __init__(self, spark: SparkSession, path: str, **asked) -> None:  # noqa: ANN003
        """asked: profile, collection, size, overlap, model, vector_size, as manifest_mismatches has them."""
        self.spark, self.path, self.asked = spark, path.rstrip("/"), asked
        self.store = Store(spark, f"{self.path}/vectors", VECTORS)

    def manifest(self) -> dict | None:
        try:
            row = self.spark.read.json(f"{self.path}/manifest").first()
        except AnalysisException:
            return None
        return row.asDict() if row else None

    def _checked(self) -> bool:
        """Whether the manifest is there; one that differs is an error, and nothing is written or read."""
        known = self.manifest()
        if known is not None and (wrong := manifest_mismatches(known, **self.asked)):
            raise MismatchError(", ".join(wrong))
        return known is not None

    def upsert(self, vectors: DataFrame) -> None:
        """vectors (key, vector); a vector of another length than the profile's is an error."""
        a = self.asked
        if not self._checked():
            row = {"profile": a["profile"], "collection": a["collection"], "chunk_size": a["size"], "chunk_overlap": a["overlap"], "embedding_model": a["model"], "vector_size": a["vector_size"]}
            self.spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest")
        size = F.size("vector")
        fits = F.when(size == a["vector_size"], F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("a vector of length "), size.cast("string"))))
        self.store.put(vectors.select("key", fits.alias("vector"), F.lit(a["model"]).alias("model"), F.current_timestamp().alias("created_at")))

    def vectors(self) -> DataFrame:
        self._checked()
        return latest(self.store.read()).select("key", "vector")
