"""The end of log files, as a data source that reads no more than its byte ranges.

Each file is one partition with the range of its last `window` bytes. The first line of a range may be the end of a line. A
range that does not decode as UTF-8, as where it begins inside a character, gives nothing, and so does a file that is not
there. Only the path's names and sizes are looked at before. Paths are those of pyarrow's file systems (plain paths,
file://, hdfs://, s3://, gs://); a path may be a file or a folder, of which all files count, hidden ones left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WINDOW, LINES = 256 * 1024, 300
SCHEMA = "path string, line_no int, line string"


def _opened(path: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def last_lines(raw: bytes, lines: int) -> list[str]:
    """The last lines of a range; what follows the last line end is a line, too, be it empty."""
    try:
        return raw.decode("utf-8").split("\n")[-lines:] if lines > 0 else []
    except UnicodeDecodeError:
        return []


class TailReader(DataSourceReader):
    def __init__(self, path: str, window: int, lines: int) -> None:
        self.path, self.window, self.lines = path, window, lines

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, at = _opened(self.path)
        found = system.get_file_info(at)
        files = [found] if found.type == fs.FileType.File else []
        if found.type == fs.FileType.Directory:
            files = [f for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        scheme = self.path[: self.path.index(at)] if at in self.path else ""
        return [Range(scheme + f.path, max(0, f.size - self.window), f.size) for f in sorted(files, key=lambda f: f.path)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, at = _opened(partition.path)
        try:
            with system.open_input_file(at) as file:
                raw = file.read_at(partition.end - partition.start, partition.start)
        except FileNotFoundError:
            return
        found = last_lines(raw, self.lines)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(found)), pa.array(range(1, len(found) + 1), pa.int32()), pa.array(found)], names=["path", "line_no", "line"])


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TailReader:  # noqa: ANN001
        return TailReader(self.options["path"], int(self.options.get("window", WINDOW)), int(self.options.get("lines", LINES)))


def read_tail(spark: SparkSession, path: str, lines: int = LINES, window: int = WINDOW) -> DataFrame:
    """(path, line_no, line): the last lines of each file, numbered from 1."""
    spark.dataSource.register(LogTail)
    return spark.read.format("log_tail").option("window", window).option("lines", lines).load(path)
