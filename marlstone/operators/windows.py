"""Windows: top rows per group, latest per key, totals beside pages, trailing intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import registry
from ..views import DOCS, documents, table

QUERIES, SQL, query = registry()


def first_per(df: DataFrame, keys: list[str], order: list, k: int = 1) -> DataFrame:
    """The first k rows of each group in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


@query("w1_top_passages", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n <= 3")
def w1(spark, sf_dir):
    return first_per(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"], 3).select("l_orderkey", "l_linenumber")


@query("w3_matched_total", f"{DOCS}, hit AS (SELECT * FROM docs WHERE contains(lower(text), 'the ')) SELECT document_id, (SELECT count(*) FROM hit) AS matched_documents FROM hit ORDER BY n_chars DESC, document_id LIMIT 20")
def w3(spark, sf_dir):
    """Top rows with the count before the limit, from an aggregate of its own."""
    hit = documents(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("the ")))
    total = hit.agg(F.count("*").alias("matched_documents"))
    return hit.orderBy(F.desc("n_chars"), "document_id").limit(20).select("document_id").join(F.broadcast(total))


@query("w6_latest_per_key", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def w6(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@query("w8_distinct_on_family", f"{DOCS} SELECT family_id, arg_min(document_id, doc_id) AS document_id FROM docs GROUP BY 1")
def w8(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("family_id").agg(F.min_by("document_id", "doc_id").alias("document_id"))


@query("w10_rank_fusion", "WITH a AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS n FROM part ORDER BY n LIMIT 120), b AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS n FROM part ORDER BY n LIMIT 120) SELECT k, round(sum(1.0 / (60 + n)), 12) AS score, count(*) AS channels FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k")
def w10(spark, sf_dir):
    """Reciprocal-rank fusion of two bounded channels."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_retailprice", "p_size")
    channels = None
    for c in ("p_retailprice", "p_size"):
        top = part.orderBy(F.desc(c), "k").limit(120)  # bounded, so one window over all of it is small
        ranked = top.select("k", F.row_number().over(Window.orderBy(F.desc(c), "k")).alias("n"))
        channels = ranked if channels is None else channels.unionByName(ranked)
    return channels.groupBy("k").agg(F.round(F.sum(1.0 / (60 + F.col("n"))), 12).alias("score"), F.count("*").alias("channels"))


@query("w12_trailing", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND CURRENT ROW) AS n FROM events")
def w12(spark, sf_dir):
    """Events of the same type in the trailing five minutes. A window partition is five minutes of a type: each row stands in its own and,
    as one that is only counted, in the next."""
    width = 300_000_000
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    placed = rows.withColumn("slot", F.floor(F.col("us") / width)).withColumn("ahead", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("slot", F.col("slot") + F.col("ahead"))
    w = Window.partitionBy("event_type", "slot").orderBy("us").rangeBetween(-width, 0)
    return placed.withColumn("n", F.count("*").over(w)).where("ahead = 0").select("event_id", "n")
