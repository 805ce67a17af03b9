"""Extraction memo: what is costly to extract is extracted once for each key, also by runs at the same time.

Keys (say path and resolution) are dealt into ranges by hash. A run claims a range before it extracts the range's missing
keys, by creating a file that must not exist yet, and publishes its rows by renaming a finished folder to one that must
not exist yet: readers see all rows of a commit or none, and the first writer wins. A range that another run has claimed is
left to it; its rows are waited for, and taken over when the claim is older than `lease_s`, as after a crash. The file
system has to create and rename atomically, as HDFS and local ones do.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.storage import drop_path

RANGES, LEASE_S, LOOK_S = 16, 3600.0, 0.5


class Memo:
    """A store of (keys..., values...) below a folder; schema is that of its rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], ranges: int = RANGES, lease_s: float = LEASE_S) -> None:
        self.spark, self.path, self.keys, self.ranges, self.lease_s = spark, path.rstrip("/"), keys, ranges, lease_s
        self.schema = T._parse_datatype_string(schema)
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _range(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.ranges)).cast("int")

    def _commits(self, number: int) -> list[str]:
        """The folders of a range's commits, the first first."""
        at = self._at(f"{self.path}/rows/{number}")
        if not self._files.exists(at):
            return []
        return sorted((s.getPath().toString() for s in self._files.listStatus(at)), key=lambda p: int(p.rsplit("/", 1)[1]))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of one range or of all."""
        numbers = range(self.ranges) if number is None else [number]
        paths = [p for n in numbers for p in self._commits(n)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _made(self, claim) -> bool:  # noqa: ANN001
        """Whether the file is this caller's: it must not exist yet. Hadoop's local file system looks and then creates, so
        on one machine the system's own exclusive creation is taken."""
        if self._files.getScheme() == "file":
            try:
                os.close(os.open(claim.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                return True
            except FileExistsError:
                return False
        try:
            self._files.create(claim, False).close()
            return True
        except Py4JJavaError:
            return False

    def _claimed(self, number: int) -> bool:
        claim = self._at(f"{self.path}/claims/{number}")
        self._files.mkdirs(claim.getParent())
        if self._made(claim):
            return True
        try:
            age = time.time() - self._files.getFileStatus(claim).getModificationTime() / 1000
        except Py4JJavaError:
            # The other run has just let it go.
            return False
        if age > self.lease_s:
            # Whoever removes an old claim first is the one that may make a new one.
            old = self._at(f"{self.path}/claims/{number}.old-{uuid.uuid4().hex}")
            if self._files.rename(claim, old):
                self._files.delete(old, False)
        return False

    def _publish(self, rows: DataFrame, number: int) -> None:
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        rows.select(*self.schema.fieldNames()).write.parquet(draft)
        taken = self._commits(number)
        target = self._at(f"{self.path}/rows/{number}/{len(taken)}")
        self._files.mkdirs(target.getParent())
        if self._files.exists(target) or not self._files.rename(self._at(draft), target):
            # Another writer was first; its rows are the memo's.
            drop_path(self.spark, draft)

    def fill(self, wanted: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """wanted (keys..., what extract needs) to the memo's rows of these keys. Each key that the memo lacks is
        extracted once; repeated keys are one."""
        once = wanted.dropDuplicates(self.keys).withColumn("__range", self._range()).persist()
        try:
            todo = {r[0] for r in once.select("__range").distinct().collect()}
            while todo:
                for number in sorted(todo):
                    here = once.filter(F.col("__range") == number).drop("__range")
                    if here.join(self.read(number).select(*self.keys), self.keys, "left_anti").isEmpty():
                        todo.discard(number)
                    elif self._claimed(number):
                        try:
                            # What was stored between the look and the claim is not extracted again.
                            self._publish(extract(here.join(self.read(number).select(*self.keys), self.keys, "left_anti")), number)
                        finally:
                            self._files.delete(self._at(f"{self.path}/claims/{number}"), False)
                        todo.discard(number)
                if todo:
                    time.sleep(LOOK_S)
            return self.read().join(once.select(*self.keys), self.keys, "left_semi")
        finally:
            once.unpersist()
