"""Incremental maintenance: change sets by signature, soft deletes, immutable snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import registry
from ..views import table

QUERIES, SQL, query = registry()


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and change (added, changed, removed) between tables of key and signature."""
    a, b = old.select(key, F.col("signature").alias("_old")), new.select(key, F.col("signature").alias("_new"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return a.join(b, key, "full").select(key, kind.alias("change")).where("change is not null")


def upsert(current: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The next snapshot: fresh rows, and current rows that fresh does not have, marked deleted."""
    gone = current.join(fresh.select(key), key, "left_anti").withColumn("deleted", F.lit(True))
    return fresh.withColumn("deleted", F.lit(False)).unionByName(gone)


def publish(snapshot: DataFrame, base: str, generation: int) -> str:
    """Write a generation; readers find it by name, so earlier ones stay whole."""
    path = f"{base}/snapshot_id={generation}"
    snapshot.write.mode("errorifexists").parquet(path)
    return path


_OLD = "SELECT doc_id, sha256(CASE WHEN doc_id % 9 = 0 THEN text || 'x' ELSE text END) AS signature FROM documents WHERE doc_id % 8 <> 0"
_NEW = "SELECT doc_id, sha256(text) AS signature FROM documents WHERE doc_id % 7 <> 0"


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return docs.where("doc_id % 8 <> 0").select("doc_id", F.sha2(text, 256).alias("signature")), docs.where("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("signature"))


@query("i1_change_set", f"SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ({_OLD}) a FULL JOIN ({_NEW}) b ON a.doc_id = b.doc_id WHERE a.signature IS DISTINCT FROM b.signature")
def i1(spark, sf_dir):
    return changes(*_sides(spark, sf_dir), "doc_id")


@query("k1_upsert", f"SELECT doc_id, signature, false AS deleted FROM ({_NEW}) UNION ALL SELECT doc_id, signature, true FROM ({_OLD}) o WHERE NOT EXISTS (SELECT 1 FROM ({_NEW}) n WHERE n.doc_id = o.doc_id)")
def k1(spark, sf_dir):
    return upsert(*_sides(spark, sf_dir), "doc_id")


@query("i4_queue", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def i4(spark, sf_dir):
    """Documents whose enrichment is not finished."""
    done = table(spark, sf_dir, "labels").where("quality = 1")
    return table(spark, sf_dir, "documents").join(done, "doc_id", "left_anti").select("doc_id")


@query("k13_dedup_decision", "WITH d AS (SELECT doc_id, sha256(text) AS h, length(text) AS n FROM documents), f AS (SELECT h, n, min(doc_id) AS keep FROM d GROUP BY 1, 2) SELECT doc_id, CASE WHEN doc_id = keep THEN 'kept' ELSE 'linked' END AS decision FROM d JOIN f USING (h, n)")
def k13(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.char_length("text").alias("n"))
    first = d.groupBy("h", "n").agg(F.min("doc_id").alias("keep"))
    return d.join(first, ["h", "n"]).select("doc_id", F.when(F.col("doc_id") == F.col("keep"), "kept").otherwise("linked").alias("decision"))
