"""Caches as tables: lookup, hit/miss split, upsert. A miss is never an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lexmill.storage import drop_path, written

RESPONSES = "key string, response string, model string, mode string, created_at timestamp"
VECTORS = "key string, vector array<double>, model string, created_at timestamp"


def latest(cache: DataFrame, key: str = "key", order: str = "created_at") -> DataFrame:
    """One row for each key, the last written; of rows of one time the largest by its values."""
    values = [c for c in cache.columns if c != key]
    return cache.groupBy(key).agg(F.max(F.struct(F.col(order).alias("__at"), F.struct(*values).alias("__row"))).alias("__last")).select(key, "__last.__row.*")


def lookup(requests: DataFrame, cache: DataFrame, key: str = "key", bypass: bool = False) -> DataFrame:
    """requests with the cache's columns and `hit`. Bypass skips reading; writing goes on as ever."""
    marked = latest(cache, key).withColumn("__found", F.lit(True))
    if bypass:
        marked = marked.limit(0)
    return requests.join(marked, key, "left").withColumn("hit", F.col("__found").isNotNull()).drop("__found")


def fill(requests: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "key", bypass: bool = False) -> tuple[DataFrame, DataFrame]:
    """(all requests answered, new cache rows). Only misses reach compute, each key once, and what it returns is written
    before it is used: answers and cache come from the same call. Empty answers are not kept."""
    found = written(lookup(requests.select(key).distinct(), cache, key, bypass), "cache-lookup")
    missing = requests.join(found.filter(~F.col("hit")).select(key), key, "left_semi").dropDuplicates([key])
    fresh = written(compute(missing).select(key, "response", F.current_timestamp().alias("created_at")), "cache-fresh")
    known = found.filter("hit").select(key, "response").unionByName(fresh.select(key, "response"))
    return requests.join(known, key, "left"), fresh.filter(F.length("response") > 0)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cache table, empty where there is none; files that cannot be read are misses."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


class Store:
    """A cache that stays: files of rows, of which the last of each key counts. Writing never changes a file."""

    def __init__(self, spark: SparkSession, path: str, schema: str = RESPONSES) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        return read(self.spark, self.path, self.schema)

    def put(self, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in self.schema.split(", ")]
        rows.select(*columns).write.mode("append").parquet(self.path)

    def count(self) -> int:
        return self.read().select("key").distinct().count()

    def clear(self) -> None:
        drop_path(self.spark, self.path)


def clear_all(*stores: Store) -> None:
    """What follows a change of the input folder or of the settings that texts depend on."""
    for store in stores:
        store.clear()


def remaining(inputs: DataFrame, completed: DataFrame, key: str = "path") -> DataFrame:
    """Resume: what is not completed yet."""
    return inputs.join(completed.select(key).distinct(), key, "left_anti")


def first_of_equal(docs: DataFrame, key: str, order: str) -> DataFrame:
    return docs.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)))
