"""Aggregates, rankings and quality measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import registry
from ..views import DOCS, MEMBERS, documents, memberships, table

QUERIES, SQL, query = registry()


@query("a4_overview", MEMBERS + "SELECT entity_id, count(DISTINCT document_id) AS documents, count(DISTINCT o_custkey) AS families FROM members JOIN orders ON o_orderkey = document_id GROUP BY 1")
def a4(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), "o_custkey")
    return memberships(spark, sf_dir).join(orders, "document_id").groupBy("entity_id").agg(F.count("*").alias("documents"), F.countDistinct("o_custkey").alias("families"))


@query("a5_category_default", f"{DOCS} SELECT coalesce(institution, 'unknown') AS category, count(*) AS n FROM docs GROUP BY 1")
def a5(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(F.coalesce("institution", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


@query("a7_ordered_ids", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS entity_ids FROM lineitem GROUP BY 1")
def a7(spark, sf_dir):
    ids = F.array_join(F.sort_array(F.collect_set("l_partkey")).cast("array<string>"), ",")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(ids.alias("entity_ids"))


@query("a11_score_sum", "SELECT k, sum(s) AS score FROM (SELECT l_partkey AS k, 1 AS s FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT p_partkey, 4 FROM part WHERE p_size > 40) GROUP BY k")
def a11(spark, sf_dir):
    body = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"), F.lit(1).alias("s"))
    head = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("k"), F.lit(4).alias("s"))
    return body.unionByName(head).groupBy("k").agg(F.sum("s").alias("score"))


@query("a16_zero_filled", "SELECT n_name AS type, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def a16(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    return table(spark, sf_dir, "nation").join(rich, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("type")).agg(F.count("s_suppkey").alias("n"))


@query("a18_cross_tab", f"{DOCS} SELECT lang AS category, tag, count(*) AS weight FROM (SELECT lang, unnest(tags) AS tag FROM docs WHERE NOT deleted) GROUP BY 1, 2")
def a18(spark, sf_dir):
    tags = documents(spark, sf_dir).where(~F.col("deleted")).select(F.col("lang").alias("category"), F.explode(F.array_distinct("tags")).alias("tag"))
    return tags.groupBy("category", "tag").agg(F.count("*").alias("weight"))


@query("a19_group_top6", f"{DOCS} SELECT category, value, n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, value) AS place FROM (SELECT split_part(tag, ':', 1) AS category, split_part(tag, ':', 2) AS value, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM docs) GROUP BY 1, 2) WHERE n >= 2) WHERE place <= 6")
def a19(spark, sf_dir):
    tags = documents(spark, sf_dir).select(F.explode("tags").alias("tag")).withColumn("t", F.split("tag", ":")).groupBy(F.col("t")[0].alias("category"), F.col("t")[1].alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("category").orderBy(F.desc("n"), "value")
    return tags.where("n >= 2").withColumn("place", F.row_number().over(w)).where("place <= 6").drop("place")


@query("a22_degree", "SELECT node, count(*) AS degree FROM (SELECT 's' || l_suppkey AS node FROM lineitem UNION ALL SELECT 'p' || l_partkey FROM lineitem) GROUP BY 1")
def a22(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    ends = line.select(F.explode(F.array(F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey"))).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


@query("a23_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def a23(spark, sf_dir):
    """Nearest-rank percentiles."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@query("a24_majority", "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS k FROM c) SELECT a.o_custkey, CASE WHEN b.n IS NULL OR a.n > b.n THEN a.o_orderpriority ELSE 'source' END AS winner FROM r a LEFT JOIN r b ON a.o_custkey = b.o_custkey AND b.k = 2 WHERE a.k = 1")
def a24(spark, sf_dir):
    """The value most often given, if it has no equal; else 'source'."""
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    best = counted.groupBy("o_custkey").agg(F.max("n").alias("most"))
    top = counted.join(best, "o_custkey").where("n = most").groupBy("o_custkey").agg(F.count("*").alias("ties"), F.min("o_orderpriority").alias("first"))
    return top.select("o_custkey", F.when(F.col("ties") == 1, F.col("first")).otherwise("source").alias("winner"))


@query("a25_retrieval_quality", "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS place, role = 'user' AS relevant FROM conversations) SELECT conv_id, round(sum(CASE WHEN relevant AND place <= 10 THEN 1 / log2(place + 1) ELSE 0 END), 9) AS dcg, round(coalesce(1.0 / min(place) FILTER (WHERE relevant), 0), 9) AS rr FROM r GROUP BY 1")
def a25(spark, sf_dir):
    """Discounted gain at ten and reciprocal rank of the first relevant row."""
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn")
    ranked = table(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(w).alias("place"), (F.col("role") == "user").alias("relevant"))
    gain = F.when(F.col("relevant") & (F.col("place") <= 10), 1 / F.log2(F.col("place") + 1)).otherwise(0.0)
    first = F.min(F.when(F.col("relevant"), F.col("place")))
    return ranked.groupBy("conv_id").agg(F.round(F.sum(gain), 9).alias("dcg"), F.round(F.coalesce(1.0 / first, F.lit(0.0)), 9).alias("rr"))


@query("a26_precision", "SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS both, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS clean, count(*) FILTER (WHERE quality = 0) AS poor, round(avg(CAST(quality = 1 AS INTEGER)), 9) AS share FROM labels")
def a26(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("both"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"), F.count_if(F.col("quality") == 0).alias("poor"), F.round(F.avg((F.col("quality") == 1).cast("int")), 9).alias("share"))


@query("a27_vector_complete", "SELECT label, count(*) AS chunks, count(embedding) AS embedded, min(len(embedding)) AS dims FROM embeddings GROUP BY 1")
def a27(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"), F.min(F.size("embedding")).cast("long").alias("dims"))


@query("a30_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1")
def a30(spark, sf_dir):
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).count()
    return wide.select("o_orderpriority", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))
