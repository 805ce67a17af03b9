"""Model runs that can be stopped and taken up again, with bounded concurrency and progress.

A run asks its requests chunk by chunk. A chunk is one job under the run's tag, in as many tasks as may ask at a time, and
its answers are in the store when it is done: what is paid for is kept, whatever becomes of the rest. cancel() interrupts
the job that is going on; requests without an answer are marked. The same run over the same store asks only what is
missing. Progress is observed on the answers as they are written, so it costs no job of its own.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexmill.config import RunConfig
from lexmill.operators import cache
from lexmill.operators.models import CANCELLED, Chat, ask_model
from lexmill.storage import drop_path, written_at

SCHEMA = "key string, response string, error string"
CHUNK_ROWS = 10_000


class ModelRun:
    """told(done, total, failed) hears of each chunk that is stored."""

    def __init__(self, spark: SparkSession, store: str, config: RunConfig | None = None, chunk_rows: int = CHUNK_ROWS, told: Callable[[int, int, int], None] | None = None) -> None:
        self.spark, self.store, self.config, self.chunk_rows, self.told = spark, store, config or RunConfig(), chunk_rows, told
        self.tag, self.cancelled = f"model-run-{uuid.uuid4().hex}", False

    def cancel(self) -> None:
        """May be called from any thread."""
        self.cancelled = True
        self.spark.interruptTag(self.tag)

    def answers(self) -> DataFrame:
        return cache.read(self.spark, self.store, SCHEMA)

    def _chunk(self, rows: DataFrame, make_chat: Callable[[], Chat], system: str) -> tuple[int, int]:
        watched = Observation()
        asked = ask_model(rows.select("key", "user"), "user", make_chat, system, concurrency=self.config.concurrency, pause_s=self.config.throttle_ms / 1000)
        answers = asked.select("key", "response", "error").observe(watched, F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("failed"))
        answers.write.mode("append").parquet(self.store)
        return watched.get["n"], watched.get["failed"]

    def ask(self, requests: DataFrame, make_chat: Callable[[], Chat], system: str = "") -> DataFrame:
        """requests (key, user, ...) with response and error. Each key is asked once; a key whose answer is stored, also
        as an error, is not asked again. Requests that the run was stopped before have the error CANCELLED."""
        once = requests.groupBy("key").agg(F.min("user").alias("user"))
        waiting, path = written_at(cache.remaining(once, self.answers(), "key"), "run-waiting")
        total, done, failed = waiting.count(), 0, 0
        chunks = math.ceil(total / self.chunk_rows)
        self.spark.addTag(self.tag)
        try:
            for number in range(chunks):
                if self.cancelled:
                    break
                n, errors = self._chunk(waiting.filter(F.pmod(F.xxhash64("key"), F.lit(chunks)) == number), make_chat, system)
                done, failed = done + n, failed + errors
                if self.told:
                    self.told(done, total, failed)
        except Exception:
            # The interrupted job ends in an error; its chunk is not in the store.
            if not self.cancelled:
                raise
        finally:
            self.spark.removeTag(self.tag)
        drop_path(self.spark, path)
        found = requests.join(self.answers().dropDuplicates(["key"]).withColumn("__stored", F.lit(True)), "key", "left")
        return found.withColumn("error", F.when(F.col("__stored"), F.col("error")).otherwise(F.lit(CANCELLED))).drop("__stored")
