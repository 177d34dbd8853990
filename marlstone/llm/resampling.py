"""Quality by importance resampling: each document weighs the ratio of its likelihood under two bag models of hashed
words and word pairs, one of target text (documents labelled good), one of all raw text; a Gumbel top-k on the log weights
draws without replacement.

Counts of the raw model cover every document; those of the target model a bounded sample of labelled ones (``sample``).
Both are vectors of ``buckets`` numbers, added per task and then over tasks. The Gumbel noise comes from a hash of
doc_id, so reruns agree. The cut is found by a distributed sort of the noisy weights.

Defined cases: null and empty texts have log weight 0 (no evidence); very long texts count whole; without a good label all
weights are 0, and without a share none is kept unless there is no label at all (then all are); ties go to the smaller doc_id
(null first); repeated rows are drawn each on their own, with equal keys; an empty table gives an empty result; columns
beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, buffers, chunks, cut, mix, numbered, smallest, words_of

BUCKETS, SAMPLE, SEED = 1 << 14, 6000, 11


def features(data: np.ndarray, bounds: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word and every pair of neighbours."""
    word, row = words_of(data, bounds, lower=False)
    pair = mix(word[:-1] * U(0x9E3779B97F4A7C15) + word[1:])
    inside = row[:-1] == row[1:]
    return (np.concatenate([word, pair[inside]]) % U(buckets)).astype(np.int64), np.concatenate([row, row[:-1][inside]])


def _counted(target: frozenset, buckets: int):
    def run(batches):
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for i, j in chunks(offsets):
                bucket, row = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)
                raw += np.bincount(bucket, minlength=buckets)
                known = np.array([x in target for x in ids[i:j]], bool)
                if known.any():
                    good += np.bincount(bucket[known[row]], minlength=buckets)
        keep = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(raw[keep]), pa.array(good[keep])], ["bucket", "raw", "good"])

    return run


def _weighed(ratio: np.ndarray):
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            n, total = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for i, j in chunks(offsets):
                bucket, row = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], len(ratio))
                n[i:j] = np.bincount(row, minlength=j - i)
                total[i:j] = np.bincount(row, ratio[bucket], j - i)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(total)], ["doc_id", "n_features", "log_weight"])

    return run


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = BUCKETS, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, log_weight, noisy_weight, place, kept of every row of docs.

    kept marks the ceil(share * rows) largest noisy weights; place counts them from 0. Without share, it is the share of
    good labels among all.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    if share is None:
        share = marked.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        share = 1.0 if share is None else share
    good = smallest(marked.where("quality = 1"), F.xxhash64("doc_id"), sample).select("doc_id").collect()
    target = frozenset(r["doc_id"] for r in good)
    counts = docs.mapInArrow(_counted(target, buckets), "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, fine = np.ones(buckets), np.ones(buckets)
    for r in counts.collect():  # one row per bucket of the models
        raw[r["bucket"]] += r["raw"]
        fine[r["bucket"]] += r["good"]
    ratio = np.log(fine / fine.sum()) - np.log(raw / raw.sum()) if target else np.zeros(buckets)
    weighed = docs.mapInArrow(_weighed(ratio), "doc_id long, n_features long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    noisy = weighed.withColumn("noisy_weight", F.col("log_weight") - F.log(-F.log(uniform)))
    placed = numbered(cut(noisy, "weighed"), [F.desc("noisy_weight"), "doc_id"], "place")
    rows = placed.count()
    return placed.withColumn("kept", F.col("place") < int(np.ceil(share * rows - 1e-9)))
