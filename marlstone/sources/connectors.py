"""Sources and sinks: Markdown with front matter, JSON manifests, day-partitioned logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import registry
from ..views import table

QUERIES, SQL, query = registry()


def markdown(spark: SparkSession, root: str, names: str = "*.md") -> DataFrame:
    """path, length, modified, front_matter, body of every Markdown file under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    front = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n", 1)
    body = F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "")
    return files.select("path", "length", F.col("modificationTime").alias("modified"), front.alias("front_matter"), body.alias("body"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a JSON manifest {documents: {id: record}}."""
    raw = spark.read.option("wholetext", True).text(path)
    docs = F.from_json("value", "documents map<string, struct<slug:string, status:string, pages:string, sha256:string>>")
    return raw.select(F.explode(docs["documents"]).alias("id", "r")).select("id", "r.*")


def write_log(rows: DataFrame, path: str) -> None:
    """Append a request log, one folder per UTC day."""
    rows.withColumn("utc_date", F.to_date("ts")).write.mode("append").partitionBy("utc_date").json(path)


@query("s18_discovery", "SELECT family_id, doc_id FROM (SELECT sha256(text) AS family_id, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY CASE source WHEN 'src1' THEN 0 ELSE 1 END, doc_id) AS n FROM documents) WHERE n = 1 AND family_id NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 20 = 0)")
def s18(spark, sf_dir):
    """New files: one of each content by source priority, without contents already known."""
    files = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("family_id"), "doc_id", F.when(F.col("source") == "src1", 0).otherwise(1).alias("priority"))
    best = files.groupBy("family_id").agg(F.min(F.struct("priority", "doc_id")).alias("b"))
    known = files.where("doc_id % 20 = 0").select("family_id")
    return best.join(known, "family_id", "left_anti").select("family_id", F.col("b.doc_id").alias("doc_id"))


@query("s20_journal_fold", "SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS last_event FROM events GROUP BY 1")
def s20(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("last_event"))
