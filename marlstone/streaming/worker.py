"""The work on documents as a stateful stream: a state for each document, with timers for retries and for forgetting what is done.

Events (key, seq, state, at) say what a worker did. The state holds the last state, how often the document was tried, and whether
each step was allowed. When work waits for a service, a timer is set for its next attempt, later after each failure; when it goes
off and the work still waits, the document is told to be due. What is complete is forgotten after a while. Times are those of the
events, so that a stream that was stopped and resumed says what one run over all events says; each batch is written to a folder of
its own, and written again after a failure.

The documents are dealt to a fixed number of buckets, and Spark keeps one value for each bucket: asking it for each document, one by
one, took far more time than the work. A batch reads and writes the buckets that it has events for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.retrieval import scratch
from ..plans.projection import NEXT
from ..registry import registry
from ..views import table

QUERIES, SQL, query = registry()
#: The first delay in milliseconds, which doubles with each attempt up to the fifth, and the longest.
FIRST, LONGEST = 30_000, 300_000
#: Milliseconds after which completed work is forgotten.
FORGET = 7 * 24 * 3_600_000
OUT = "key long, seq long, state string, attempts long, sound boolean, retry_at long, kind string"
#: Buckets of documents. A checkpoint holds its own number: other buckets need another checkpoint.
BUCKETS = 2048
#: Partitions of the state for each core, at most: each costs its part of every batch, whatever it holds.
EACH = 4
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def backoff(attempts: int) -> int:
    return min(LONGEST, FIRST * 2 ** min(4, max(0, attempts - 1)))


class Work(StatefulProcessor):
    """The states of one bucket's documents: seq, state, attempts, sound, retry_at, forget_at and whether it was told to be due, by key."""

    def __init__(self, forget: int = FORGET):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.work = handle.getValueState("work", "states string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        states, events = self._states(), {}
        for part in rows:
            for k, s, t, a in zip(part["key"], part["seq"], part["state"], part["at_ms"]):
                events.setdefault(k, []).append((int(s), t, int(a)))
        told, timers = [], set()
        for k, own in events.items():
            seq, state, attempts, sound, retry, forget, due = states.get(k, (-1, None, 0, True, None, None, False))
            for s, now, at in sorted(own):
                if s <= seq:  # seen already
                    continue
                sound = sound and now in NEXT.get(state, [])
                attempts += now == "processing"
                retry = at + backoff(attempts) if now == "pending_service" else None
                forget = at + self.forget if now == "complete" else None
                seq, state, due = s, now, False
            if state is not None:
                states[k] = seq, state, attempts, sound, retry, forget, due
                timers |= {retry, forget} - {None}
                told.append(k)
        for timer in timers:  # those that a later event has outdated find no document when they go off
            self.handle.registerTimer(timer)
        if told:
            self._keep(states)
            yield self._rows(states, told, "step")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        states, gone = self._states(), expiredTimerInfo.getExpiryTimeInMs()
        due = [k for k, (_, state, _, _, retry, _, told) in states.items() if state == "pending_service" and retry == gone and not told]
        done = [k for k, (_, state, _, _, _, forget, _) in states.items() if state == "complete" and forget == gone]
        if due:
            yield self._rows(states, due, "due")
        for k in due:
            states[k] = (*states[k][:6], True)
        for k in done:
            del states[k]
        if due or done:
            self._keep(states)

    def _states(self) -> dict[str | None, tuple]:
        return {k: tuple(rest) for k, *rest in json.loads(self.work.get()[0])} if self.work.exists() else {}

    def _keep(self, states: dict[str | None, tuple]) -> None:
        if states:
            self.work.update((json.dumps([(k, *rest) for k, rest in states.items()], separators=(",", ":")),))
        else:
            self.work.clear()

    def _rows(self, states: dict[str | None, tuple], keys: list[str | None], kind: str) -> pd.DataFrame:
        seq, state, attempts, sound, retry, *_ = zip(*[states[k] for k in keys])
        number = pd.array([None if k is None else int(k) for k in keys], "Int64")
        return pd.DataFrame({"key": number, "seq": seq, "state": state, "attempts": attempts, "sound": sound, "retry_at": pd.array(retry, "Int64"), "kind": kind})

    def close(self) -> None:
        pass


def worked(events: DataFrame, forget: int = FORGET, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """A stream of states from a stream of events (key, seq, state, at timestamp). Events later than the watermark are left out."""
    timed = events.select(F.col("key").cast("long").cast("string").alias("key"), F.col("seq").cast("long"), "state", F.col("at").cast("timestamp").alias("at"), F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    return timed.withWatermark("at", late).withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(Work(forget), OUT, "update", "eventtime")


def session(spark: SparkSession) -> SparkSession:
    """A session with the state store that such processors need, and no more partitions of it than the cores can use; that of the
    caller keeps its own settings."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), EACH * spark.sparkContext.defaultParallelism)))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return own


def sink(states: DataFrame, path: str):
    """A writer of each batch to its own folder (a batch that runs again replaces what it wrote)."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    return states.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(put)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each document that a stream has written, and whether its retry has come due since."""
    rows = spark.read.schema(OUT + ", batch int").parquet(f"{path}/out")
    last = rows.where("kind = 'step'").groupBy("key").agg(F.max_by(F.struct("state", "attempts", "sound", "seq", "retry_at"), "seq").alias("s")).select("key", "s.*")
    due = rows.where("kind = 'due'").select("key", "seq").distinct().withColumn("due", F.lit(True))
    return last.join(due, ["key", "seq"], "left").select("key", "state", "attempts", "sound", "retry_at", F.coalesce("due", F.lit(False)).alias("due"))


def journal(spark, sf_dir) -> DataFrame:
    """Work on every document, by its number: done, waiting for a service a second time, or a log that skips a step; half a minute
    between steps, and a last event an hour later, by which earlier retries are due."""
    paths = [["processing", "staged", "pending_index", "complete"], ["processing", "pending_service", "processing", "pending_service"], ["processing", "complete"]]
    log = F.get(F.array(*[F.array(*[F.lit(s) for s in p]) for p in paths]), (F.col("doc_id") % 3).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.posexplode(log).alias("seq", "state"))
    rows = rows.withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("seq") * 30))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("key"), F.lit(0).alias("seq"), F.lit("processing").alias("state"), F.timestamp_seconds(F.lit(1_700_003_600)).alias("at"))
    return rows.unionByName(end)


@query("i5_stream_states", "SELECT doc_id AS key, CASE doc_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'pending_service' ELSE 'complete' END AS state, CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 1 END AS attempts, doc_id % 3 <> 2 AS sound, CASE WHEN doc_id % 3 = 1 THEN 1700000090000 + 60000 END AS retry_at, doc_id % 3 = 1 AS due FROM documents")
def i5_stream(spark, sf_dir):
    """The journal as a stream of several files, in order of time: states, attempts, next retries, and which of these are due."""
    path, own = f"{scratch(spark)}/worker-{uuid.uuid4().hex}", session(spark)
    rows = journal(spark, sf_dir)
    for step in range(4):  # a file for each step, so that time goes on from batch to batch
        rows.where((F.col("seq") == step) & (F.col("key") >= 0)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    rows.where("key < 0").coalesce(1).write.mode("append").parquet(f"{path}/in")
    events = own.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    sink(worked(events), path).trigger(availableNow=True).start().awaitTermination()
    return latest(spark, path).where("key >= 0")
