"""The worker keeps the states of many documents as one value: asking the store for each document took nearly all of its time."""

import json
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from marlstone.streaming.worker import FIRST, FORGET, Work, latest, session, sink, worked


def test_values_follow_the_buckets_not_the_documents(spark):
    path, own, n = tempfile.mkdtemp(prefix="spark-"), session(spark), 6000
    rows = spark.range(n).select(F.col("id").alias("key"), F.lit(0).alias("seq"), F.lit("processing").alias("state"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("at"))
    rows = rows.union(rows.limit(1).withColumn("key", F.lit(None).cast("long")))  # a key that is null is one document
    rows.coalesce(1).write.parquet(f"{path}/in")
    query = sink(worked(own.readStream.schema(rows.schema).parquet(f"{path}/in")), path).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(o["numRowsUpdated"] for p in query.recentProgress for o in p["stateOperators"]) <= 2048
    found = latest(spark, path)
    assert found.where("state = 'processing' and attempts = 1 and sound and not due").count() == n + 1
    assert found.where("key is null").count() == 1 and found.select("key").distinct().count() == n + 1


class Held:
    """A handle and its one value, without a stream."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, *_):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def getExpiryTimeInMs(self):
        return self.at

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    update = lambda self, value: setattr(self, "value", value)
    clear = lambda self: setattr(self, "value", None)


def test_timers_of_a_bucket():
    """Two documents of one bucket wait until the same time, are told once each, and go on apart; what is complete is forgotten."""
    held, work = Held(), Work()
    work.init(held)

    def put(*events):
        rows = pd.DataFrame(events, columns=["key", "seq", "state", "at_ms"])
        return [r for part in work.handleInputRows((0,), iter([rows]), None) for r in part.to_dict("records")]

    def late(at):
        held.at = at
        return [(r["key"], r["kind"]) for part in work.handleExpiredTimer((0,), None, held) for r in part.to_dict("records")]

    put(("1", 0, "processing", 0), ("1", 1, "pending_service", 10), ("2", 1, "pending_service", 10), ("2", 0, "processing", 0))
    assert held.timers == [10 + FIRST]
    assert late(10 + FIRST) == [(1, "due"), (2, "due")] and late(10 + FIRST) == []
    again = put(("2", 2, "processing", 50), ("2", 1, "failed", 60), ("3", 0, "complete", 70))
    assert [(r["key"], r["seq"], r["attempts"], r["sound"]) for r in again] == [(2, 2, 2, True), (3, 0, 0, False)]
    assert late(10 + FIRST) == [] and late(70 + FORGET) == []
    assert [k for k, *_ in json.loads(held.value[0])] == ["1", "2"]
