"""The corpus model over the supplied tables, in Spark and as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rows of the corpus: identity, family, tags, publication date (missing for some), text."""
    n = F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 365).cast("int")), "yyyy-MM-dd")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc:"), n).alias("document_id"),
        "doc_id",
        F.concat(F.lit("Report "), n, F.lit(" from "), "source").alias("title"),
        F.sha2("text", 256).alias("family_id"),
        F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("src:"), "source")).alias("tags"),
        F.when(n % 7 != 0, day).alias("published_at"),
        F.when(n % 5 != 0, F.col("source")).alias("institution"),
        (n % 11 == 0).alias("deleted"),
        "text",
        "lang",
        "source",
        "n_chars",
    )


#: The same, for DuckDB; to be followed by a SELECT.
DOCS = """WITH docs AS (
  SELECT 'doc:' || doc_id AS document_id, doc_id, 'Report ' || doc_id || ' from ' || source AS title,
    sha256(text) AS family_id, ['lang:' || lang, 'src:' || source] AS tags,
    CASE WHEN doc_id % 7 <> 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') END AS published_at,
    CASE WHEN doc_id % 5 <> 0 THEN source END AS institution, doc_id % 11 = 0 AS deleted, text, lang, source, n_chars
  FROM documents) """


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order as document, part as entity."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("entity_id")).distinct()


MEMBERS = "WITH members AS (SELECT DISTINCT l_orderkey AS document_id, l_partkey AS entity_id FROM lineitem) "
