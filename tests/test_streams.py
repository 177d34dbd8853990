"""Streams that are stopped and resumed: the journal source reads each line once, the worker's states are those of one batch."""

import tempfile
import time

import pytest
from pyspark.sql import functions as F

from marlstone.plans.projection import folded
from marlstone.sources.journal import Range, Reader, lines
from marlstone.streaming.worker import backoff, latest, session, sink, worked


def drained(stream, path):
    """Run over what is there, as the stream's next life, and give all lines written so far."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted((r["file"], r["at"], r["value"]) for r in stream.sparkSession.read.schema("file string, at long, value string").parquet(f"{path}/out").collect())


def test_journal_is_read_once_across_restarts(spark):
    src, out = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")

    def write(name, text, mode="a"):
        with open(f"{src}/{name}", mode + "b") as f:
            f.write(text.encode())

    write("a.jsonl", '{"k":1}\n{"k":2}\n{"k":')
    write("other.txt", "no\n")
    got = drained(lines(spark, src), out)
    assert got == [("a.jsonl", 0, '{"k":1}'), ("a.jsonl", 8, '{"k":2}')]  # the unfinished line waits
    write("a.jsonl", '3}\n')
    write("b.jsonl", "é\n\nlast\n")
    want = [("a.jsonl", 0, '{"k":1}'), ("a.jsonl", 8, '{"k":2}'), ("a.jsonl", 16, '{"k":3}'), ("b.jsonl", 0, "é"), ("b.jsonl", 3, ""), ("b.jsonl", 4, "last")]
    assert drained(lines(spark, src), out) == want
    assert drained(lines(spark, src), out) == want  # nothing new


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_ranges_share_the_lines(size):
    src = tempfile.mkdtemp(prefix="spark-")
    text = b"one\n\ntwo three\nfour\n" + b"x" * 50 + b"\nend\n"
    with open(f"{src}/a.jsonl", "wb") as f:
        f.write(text + b"unfinished")
    reader = Reader({"path": src, "range": str(size)})
    end = reader.latestOffset()
    assert list(end.values()) == [len(text)]
    parts = reader.partitions({}, end)
    assert [v for p in parts for _, _, v in reader.read(p)] == text.decode().split("\n")[:-1]
    assert list(reader.read(Range("", 0, 0))) == [] and reader.partitions(end, end) == [Range("", 0, 0)]


def test_files_settle():
    src = tempfile.mkdtemp(prefix="spark-")
    with open(f"{src}/a.jsonl", "w") as f:
        f.write("one\n")
    reader = Reader({"path": src, "settle": "true"})
    assert reader.latestOffset() == {}
    assert list(reader.latestOffset().values()) == [4]
    with open(f"{src}/a.jsonl", "a") as f:
        f.write("two\n")
    assert list(reader.latestOffset().values()) == [4] and list(reader.latestOffset().values()) == [8]


def test_backoff():
    assert [backoff(n) for n in (1, 2, 3, 4, 5, 6)] == [30_000, 60_000, 120_000, 240_000, 300_000, 300_000]


def test_worker_resumed_gives_the_batch_result(spark):
    """Killed after some batches and resumed from its checkpoint: states, attempts and soundness are those of one fold over all events."""
    path, own = tempfile.mkdtemp(prefix="spark-"), session(spark)
    steps = ["processing", "staged", "pending_index", "complete", "processing", "pending_service", "processing", "failed", "complete"]
    rows = [(k, s, steps[s] if k != 3 or s != 1 else "complete", 1_700_000_000 + 40 * s) for s in range(9) for k in range(12) if s <= k]
    schema = "key long, seq int, state string, at long"
    for s in range(9):
        part = spark.createDataFrame([r for r in rows if r[1] == s], schema).withColumn("at", F.timestamp_seconds("at"))
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    events = lambda: own.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    first = sink(worked(events()), path).start()
    until = time.time() + 90
    while time.time() < until and sum(p["numInputRows"] > 0 for p in first.recentProgress) < 3:
        time.sleep(0.2)
    first.stop()
    sink(worked(events()), path).trigger(availableNow=True).start().awaitTermination()
    got = {r["key"]: (r["state"], r["attempts"], r["sound"]) for r in latest(spark, path).collect()}
    want = {r["key"]: (r["state"], r["attempts"], r["sound"]) for r in folded(spark.createDataFrame(rows, schema)).collect()}
    assert got == want
    due = {r["key"] for r in latest(spark, path).where("due").collect()}
    assert due == {5}  # it waits since 200 s, twice tried, so from 260 s on; the last events are of 320 s
