"""Journals as a stream: lines appended to files, each read exactly once, also when the stream was stopped in between.

The offset of the source is the number of bytes read of each file, up to the end of its last whole line: a line that is still being
written waits until its end is there. With settle, what is new in a file is offered only when the file has kept its size between
two looks. Long files are read in ranges, a task for each. Files are only appended to; one that has become shorter is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.retrieval import scratch
from ..registry import registry
from ..views import table

QUERIES, SQL, query = registry()
NAME, SCHEMA = "marlstone_journal", "file string, at long, value string"
#: Bytes that a task reads, and that are read at once when the last line's end is looked for.
RANGE, STEP = 16 << 20, 1 << 16


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in [start, end)."""

    file: str
    start: int
    end: int


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("suffix", ".jsonl")
        self.settle = options.get("settle", "false").lower() == "true"
        self.range = int(options.get("range", RANGE))
        self.sizes: dict[str, int] = {}
        self.offered: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, base = _store(self.path)
        found = {i.path: i.size for i in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if i.is_file and i.path.endswith(self.pattern)}
        for file, size in sorted(found.items()):
            if not self.settle or self.sizes.get(file) == size:
                self.offered[file] = max(self.offered.get(file, 0), self._whole(store, file, size, self.offered.get(file, 0)))
        self.sizes = found
        return dict(sorted(self.offered.items()))

    @staticmethod
    def _whole(store, file: str, size: int, low: int) -> int:
        """The end of the last whole line behind low."""
        with store.open_input_file(file) as f:
            end = size
            while end > low:
                start = max(low, end - STEP)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return low

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for file, to in end.items():
            low = start.get(file, 0)
            if to < low:
                raise ValueError(f"{file} has become shorter")
            out += [Range(file, a, min(a + self.range, to)) for a in range(low, to, self.range)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.start >= partition.end:
            return
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as f:
            at = partition.start
            if at:  # a line that began before the range is that of the range before
                f.seek(at - 1)
                rest = b""
                while (k := rest.find(b"\n")) < 0:
                    more = f.read(STEP)
                    if not more:
                        return
                    rest += more
                at, rest = at - 1 + k + 1, rest[k + 1 :]
            else:
                rest = b""
            while at < partition.end:
                while (k := rest.find(b"\n")) < 0:
                    more = f.read(STEP)
                    if not more:
                        return
                    rest += more
                yield partition.file.rsplit("/", 1)[-1], at, rest[:k].decode("utf-8", "replace")
                at, rest = at + k + 1, rest[k + 1 :]

    def commit(self, end: dict) -> None:
        pass


class Journal(DataSource):
    """Options: path; suffix of the files; settle; range (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)


def lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of file, at (byte), value of the lines of the journals under path."""
    spark.dataSource.register(Journal)
    return spark.readStream.format(NAME).option("path", path).options(**options).load()


@query("s20_journal_stream", "SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, event_id) AS status, count(*) AS lines FROM events GROUP BY 1")
def s20_stream(spark, sf_dir):
    """The events as lines of journals, read as a stream and replayed: a later value over an earlier."""
    path = f"{scratch(spark)}/journal-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    e.select(F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("n")))).repartition(3).write.text(f"{path}/in")
    stream = lines(spark, f"{path}/in", suffix=".txt").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/out").select(F.from_json("value", "id string, status string, n long").alias("r")).select("r.*")
    return rows.groupBy("id").agg(F.max_by("status", "n").alias("status"), F.count("*").alias("lines"))
