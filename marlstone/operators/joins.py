"""Joins of the corpus model: semi, anti, division, lateral top-k, as-of, null-safe change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import registry
from ..views import DOCS, MEMBERS, documents, memberships, table

QUERIES, SQL, query = registry()


@query("j1_composite", "SELECT a.l_returnflag, b.l_linestatus, count(*) AS n FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem WHERE l_quantity > 25) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1, 2")
def j1(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    large = lines.where("l_quantity > 25").select("l_orderkey", "l_linenumber", "l_linestatus")
    return lines.select("l_orderkey", "l_linenumber", "l_returnflag").join(large, ["l_orderkey", "l_linenumber"]).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def latest_change(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of new whose value differs, null-safely, from the old one (or that are new)."""
    joined = new.select(key, F.col(value).alias("_new")).join(old.select(key, F.col(value).alias("_old")), key, "left")
    return joined.where(~F.col("_new").eqNullSafe(F.col("_old"))).select(key)


@query("j3_distinct_from", f"{DOCS} SELECT a.doc_id FROM docs a LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN published_at END AS published_at FROM docs WHERE doc_id % 10 <> 0) b ON a.doc_id = b.doc_id WHERE a.published_at IS DISTINCT FROM b.published_at")
def j3(spark, sf_dir):
    docs = documents(spark, sf_dir)
    old = docs.where("doc_id % 10 <> 0").withColumn("published_at", F.when(F.col("doc_id") % 3 == 0, F.col("published_at")))
    return latest_change(old, docs, "doc_id", "published_at")


@query("j4_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def j4(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j5_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def j5(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 150000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def divide(members: DataFrame, wanted: list[int]) -> DataFrame:
    """Documents that have every wanted entity."""
    hit = members.where(F.col("entity_id").isin(wanted)).groupBy("document_id").agg(F.countDistinct("entity_id").alias("n"))
    return hit.where(F.col("n") == len(set(wanted))).select("document_id")


@query("j6_division", "SELECT l_orderkey AS document_id FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2")
def j6(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("entity_id")).distinct()
    return divide(flags, ["A", "N"])


@query("j7_lateral_top3", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def j7(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).where("n <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("j9_unnest", f"{DOCS} SELECT document_id, unnest(tags) AS tag FROM docs")
def j9(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", F.explode("tags").alias("tag"))


@query("j10_latest_review", "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j10(spark, sf_dir):
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_orderstatus", "o_orderkey").alias("o_orderstatus"))
    return table(spark, sf_dir, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderstatus")


@query("j11_filter_in_on", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 100000")
def j11(spark, sf_dir):
    """The filter stands in the join, so customers without such an order stay."""
    some = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 100000")
    return table(spark, sf_dir, "customer").join(some, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("j14_self_family", f"{DOCS} SELECT a.document_id, b.document_id AS original_id FROM docs a JOIN (SELECT family_id, min(doc_id) AS doc_id FROM docs GROUP BY 1) f USING (family_id) JOIN docs b ON b.doc_id = f.doc_id WHERE a.doc_id <> b.doc_id")
def j14(spark, sf_dir):
    """Each later member of a family with the family's first document."""
    docs = documents(spark, sf_dir)
    first = docs.groupBy("family_id").agg(F.min(F.struct("doc_id", "document_id")).alias("f"))
    joined = docs.join(first, "family_id").where(F.col("doc_id") != F.col("f.doc_id"))
    return joined.select("document_id", F.col("f.document_id").alias("original_id"))


@query("j15_two_ends", "SELECT s_suppkey, a.n_name AS nation, r_name AS region FROM supplier JOIN nation a ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j15(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


VALID = "WITH rel AS (SELECT l_suppkey AS source_id, l_partkey AS target_id, CAST(min(l_shipdate) AS DATE) AS valid_from, CASE WHEN l_partkey % 3 <> 0 THEN CAST(max(l_shipdate) AS DATE) END AS valid_to FROM lineitem GROUP BY 1, 2) "


def relations(spark, sf_dir) -> DataFrame:
    """Supplier to part with the days of its first and last shipment; open-ended for some."""
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id")).agg(F.min("l_shipdate").cast("date").alias("valid_from"), F.max("l_shipdate").cast("date").alias("last"))
    return grouped.select("source_id", "target_id", "valid_from", F.when(F.col("target_id") % 3 != 0, F.col("last")).alias("valid_to"))


def valid_on(day: str) -> F.Column:
    at = F.lit(day).cast("date")
    return F.coalesce((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at)), F.lit(False))


@query("j18_as_of", VALID + "SELECT source_id, target_id FROM rel WHERE valid_from <= DATE '1996-06-30' AND (valid_to IS NULL OR valid_to >= DATE '1996-06-30')")
def j18(spark, sf_dir):
    return relations(spark, sf_dir).where(valid_on("1996-06-30")).select("source_id", "target_id")


@query("j20_backlinks", "SELECT p_partkey, coalesce(n, 0) AS backlinks FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def j20(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n"))
    return table(spark, sf_dir, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("backlinks"))


@query("j22_both_sides", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS on_disk, b.doc_id IS NOT NULL AS indexed FROM (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0) a FULL JOIN (SELECT doc_id FROM labels) b ON a.doc_id = b.doc_id")
def j22(spark, sf_dir):
    files = table(spark, sf_dir, "documents").where("doc_id % 4 <> 0").select("doc_id", F.lit(True).alias("on_disk"))
    rows = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("indexed"))
    false = F.lit(False)
    return files.join(rows, "doc_id", "full").select("doc_id", F.coalesce("on_disk", false).alias("on_disk"), F.coalesce("indexed", false).alias("indexed"))


@query("u1_union_distinct", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT o_orderpriority FROM orders")
def u1(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("orders", "o_orderpriority"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("u6_replace_tags", f"{DOCS} SELECT document_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(tags, lambda t: t <> 'lang:en'), ['lang:english']))), '|') AS tags FROM docs")
def u6(spark, sf_dir):
    """Tags without the entity's previous ones, with its present ones."""
    now = F.array_union(F.array_except("tags", F.array(F.lit("lang:en"))), F.array(F.lit("lang:english")))
    return documents(spark, sf_dir).select("document_id", F.array_join(F.array_sort(now), "|").alias("tags"))


@query("u8_link_diff", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'create' ELSE 'remove' END AS change FROM (SELECT p_partkey AS k FROM part WHERE p_size > 20) a FULL JOIN (SELECT p_partkey AS k FROM part WHERE p_retailprice > 1200) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def u8(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size", "p_retailprice")
    wanted, had = part.where("p_size > 20"), part.where("p_retailprice > 1200")
    create = wanted.join(had, "k", "left_anti").select("k", F.lit("create").alias("change"))
    return create.union(had.join(wanted, "k", "left_anti").select("k", F.lit("remove").alias("change")))


@query("g4_intersection", MEMBERS + "SELECT document_id FROM members WHERE entity_id IN (SELECT p_partkey FROM part WHERE p_size = 10) INTERSECT SELECT document_id FROM members WHERE entity_id IN (SELECT p_partkey FROM part WHERE p_size = 20)")
def g4(spark, sf_dir):
    """Documents that have a member of each of two seed sets: chained semi joins."""
    members, part = memberships(spark, sf_dir), table(spark, sf_dir, "part")
    out = members.select("document_id").distinct()
    for size in (10, 20):
        seeds = part.where(F.col("p_size") == size)
        out = out.join(members.join(seeds, F.col("entity_id") == F.col("p_partkey"), "left_semi"), "document_id", "left_semi")
    return out
