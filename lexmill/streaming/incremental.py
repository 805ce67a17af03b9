"""Incremental runs over a folder that grows, as structured streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from lexmill.operators.cache import read, remaining


def process_new(stream: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], store: str, schema: str, checkpoint: str) -> StreamingQuery:
    """Each batch's rows whose key the store does not have yet are worked on and appended; equal content is worked on
    once. A batch that is run again after a failure finds its keys in the store, so it adds nothing twice."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        new = remaining(rows.dropDuplicates([key]), read(spark, store, schema), key)
        work(new).write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parquet_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def sessions(events: DataFrame, run: str, ts: str, silence: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Stretches of a run without a silence, by event time: start, end, number of events. The watermark bounds the state."""
    bounded = events.withWatermark(ts, late)
    return bounded.groupBy(run, F.session_window(ts, silence).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(run, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class PausableRun:
    """An incremental run that can be stopped and taken up again; the checkpoint holds where it was, so no batch is lost
    or done twice."""

    def __init__(self, start: Callable[[], StreamingQuery]) -> None:
        self._start, self.query = start, None

    @property
    def running(self) -> bool:
        return self.query is not None and self.query.isActive

    def resume(self) -> StreamingQuery:
        if not self.running:
            self.query = self._start()
        return self.query

    def pause(self) -> None:
        if self.running:
            self.query.stop()


class Progress(StreamingQueryListener):
    """Tells of each finished batch: told(rows of the batch, rows so far)."""

    def __init__(self, told: Callable[[int, int], None]) -> None:
        self.told, self.total = told, 0

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.total = 0

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.total += event.progress.numInputRows
        self.told(event.progress.numInputRows, self.total)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass
