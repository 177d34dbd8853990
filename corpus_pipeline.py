"""A training corpus from raw documents: toxic documents out, one of each group of near copies, repeated passages out,
sources mixed to target weights, and the rest encoded.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that is written
as Parquet and read again; all but the last return the columns of docs, whatever further columns there are. An empty table
stays empty; very long texts are worked on whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, minhash, mixing, passages, toxicity
from marlstone.llm.common import cut, numbered, shared_dir
from marlstone.llm.queries import tokenizer_file


def _whole(docs: DataFrame) -> Column:
    """All columns of a document as one, so that no name of theirs meets one of an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine does not call toxic (score below 0.7). Null and empty texts score as clean and
    stay; repeated rows and rows without a doc_id are scored each."""
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select("text", _whole(docs)), model).where(F.col("score") < 0.7).select("_doc.*")


def _keyed(docs: DataFrame, first: Column) -> tuple[DataFrame, bool]:
    """Documents (_doc) with a key _row of its own for each row, and if any doc_id is null or repeated: without that _row is
    the doc_id; else rows are numbered in order of doc_id (first: its order with nulls placed), text and the other columns."""
    rows = docs.select(_whole(docs))
    if not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count():
        return rows.withColumn("_row", F.col("_doc.doc_id").cast("long")), False
    rest = [F.col("_doc").getField(c) for c in docs.columns if c not in ("doc_id", "text")]
    return numbered(rows, [first, F.col("_doc.text"), *rest], "_row"), True


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near copies: five-word shingles, similarity 0.8 or more.

    Rows of one doc_id are one document: the first in order of text (null first) and the other columns stands for it.
    Rows without a doc_id are documents of their own, after all others: of near copies one with a doc_id stays. Texts
    without words are like none and stay."""
    rows, mended = _keyed(docs, F.col("_doc.doc_id").asc_nulls_last())
    if mended:
        doc_id = F.col("_doc.doc_id")
        own = F.when(doc_id.isNull(), F.col("_row"))
        rows = cut(rows.join(rows.groupBy(doc_id, own).agg(F.min("_row").alias("_row")).select("_row"), "_row", "left_semi"), "distinct")
    near = minhash.near(rows.select(F.col("_row").alias("doc_id"), "_doc.text"), width=5, percent=80)
    return rows.join(near.where("not kept").select(F.col("doc_id").alias("_row")), "_row", "left_anti").select("_doc.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes or more that a document with a smaller doc_id has. A character that lost some of
    its bytes goes as a whole. Untouched texts (null too) stay as they are; n_chars follows the text. Rows of one doc_id lose
    nothing to each other; rows without one are documents of their own before all others, in order of text and the other columns."""
    rows, mended = _keyed(docs, F.col("_doc.doc_id").asc_nulls_first())
    shift = 0
    if mended:
        rest = [F.col("_doc").getField(c) for c in docs.columns if c != "doc_id"]
        again, shift = passages.rows_of_documents(rows.select(F.col("_doc.doc_id").cast("long").alias("doc_id"), "_doc"), rest)
        rows = cut(again.select("_doc", F.col("id").alias("_row")), "rows")
    found = passages.remove_repeats(rows.select(F.col("_row").alias("doc_id"), "_doc.text"), text=True, shift=shift)
    left = found.where("n_removed > 0").select(F.col("doc_id").alias("_id"), "kept")
    joined = rows.join(left, F.col("_row") == F.col("_id"), "left")
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    columns = []
    for c in docs.columns:
        was = F.col("_doc").getField(c)
        columns.append((F.when(F.col("_id").isNull(), was).otherwise(changed[c]) if c in changed else was).alias(c))
    return joined.select(*columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them, whole documents each time. Documents without words stay once;
    a null source is a source; repeated rows are taken each."""
    found = mixing.mix(docs.select("doc_id", "text", "source", _whole(docs)), keep=("_doc",))
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return found.where("copies > 0").select("_doc", times).select("_doc.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit words), their digest and decoded text of every document of the mix. Null and
    empty texts have no tokens; a null doc_id stays null; repeated rows each get their row."""
    return bpe.encode(docs, tokenizer_file()).select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), "decoded")


STAGES = [("toxicity", clean), ("minhash near-dedup", distinct), ("suffix-array dedup", without_repeats), ("mixing to target weights", mixed), ("bpe encoding and decoding", encoded)]

#: Learnt models, signatures and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds run() and each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/marlstone/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
