"""Batch maintenance as table transformations: plans, resumable work, merge patches, clean-up reports, integrity diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import registry
from ..views import DOCS, documents, table

QUERIES, SQL, query = registry()


@query("b1_naming_plan", f"{DOCS} SELECT CASE WHEN published_at IS NULL THEN 'no_date' WHEN institution IS NULL THEN 'no_publisher' ELSE 'planned' END AS outcome, count(*) AS n FROM docs GROUP BY 1")
def b1(spark, sf_dir):
    outcome = F.when(F.col("published_at").isNull(), "no_date").when(F.col("institution").isNull(), "no_publisher").otherwise("planned")
    return documents(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def remaining(plan: DataFrame, journal: DataFrame, key: str) -> DataFrame:
    """Rows of a plan to do: those whose last entry in the journal (key, seq, state) is not ``complete``.

    ``resume`` tells of work that was begun and not ended.
    """
    last = journal.groupBy(key).agg(F.max_by("state", "seq").alias("_state"))
    left = plan.join(last, key, "left").where("_state is null or _state <> 'complete'")
    return left.withColumn("resume", F.col("_state").isNotNull()).drop("_state")


@query(
    "b3_resume",
    """WITH last AS (SELECT user_id AS k, arg_max(CASE event_type WHEN 'purchase' THEN 'complete' ELSE 'intent' END, event_id) AS state FROM events GROUP BY 1)
    SELECT c_custkey, state IS NOT NULL AS resume FROM customer LEFT JOIN last ON c_custkey = k WHERE state IS NULL OR state <> 'complete'""",
)
def b3(spark, sf_dir):
    state = F.when(F.col("event_type") == "purchase", "complete").otherwise("intent")
    journal = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_id").alias("seq"), state.alias("state"))
    return remaining(table(spark, sf_dir, "customer").select("c_custkey"), journal, "c_custkey")


def merge_patch(pages: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """pages (key, fields map) with the fields of patches (key, fields map) put over theirs; pages without one stay."""
    new = patches.select(key, F.col("fields").alias("_patch"))
    mine = F.coalesce("fields", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    kept = F.map_filter(mine, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys("_patch"), k), F.lit(False)))
    return pages.join(new, key, "left").withColumn("fields", F.when(F.col("_patch").isNull(), F.col("fields")).otherwise(F.map_concat(kept, "_patch"))).drop("_patch")


@query("b4_merge_patch", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'patched' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN 'yes' END AS reviewed, c_name AS name FROM customer")
def b4(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    pages = customers.select("c_custkey", F.create_map(F.lit("segment"), "c_mktsegment", F.lit("name"), "c_name").alias("fields"))
    patches = customers.where("c_custkey % 3 = 0").select("c_custkey", F.create_map(F.lit("segment"), F.lit("patched"), F.lit("reviewed"), F.lit("yes")).alias("fields"))
    f = F.col("fields")
    return merge_patch(pages, patches, "c_custkey").select("c_custkey", f["segment"].alias("segment"), f["reviewed"].alias("reviewed"), f["name"].alias("name"))


def without_notices(body: Column, strong: str, weak: str) -> Column:
    """Body without notice lines: strong ones always, weak ones only where the page has two strong ones or more."""
    lines = F.split(body, "\n")
    busy = F.size(F.filter(lines, lambda x: x.rlike(strong))) >= 2
    return F.array_join(F.filter(lines, lambda x: ~(x.rlike(strong) | (busy & x.rlike(weak)))), "\n")


_STRONG, _WEAK = "^(Licensed under|All rights reserved)", "^(Copyright|Subscribe)"
CLEAN = f"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, len(list_filter(lines, lambda x: regexp_matches(x, '{_STRONG}'))) >= 2 AS busy FROM l),
cleaned AS (SELECT doc_id, text, array_to_string(list_filter(lines, lambda x: NOT (regexp_matches(x, '{_STRONG}') OR (busy AND regexp_matches(x, '{_WEAK}')))), chr(10)) AS body FROM s) """


def _cleaned(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", without_notices(F.col("text"), _STRONG, _WEAK).alias("body"))


@query("b5_cleanup_report", f"{CLEAN} SELECT body <> text AS changed, count(*) AS documents, CAST(sum(length(text) - length(body)) AS BIGINT) AS removed, count(*) FILTER (WHERE regexp_matches(body, '(?i)licen[cs]ed under')) AS residual FROM cleaned GROUP BY 1")
def b5(spark, sf_dir):
    """What a clean-up of the whole library would do, and where traces remain."""
    removed = F.sum(F.char_length("text") - F.char_length("body"))
    return _cleaned(spark, sf_dir).groupBy((F.col("body") != F.col("text")).alias("changed")).agg(F.count("*").alias("documents"), removed.alias("removed"), F.count_if(F.col("body").rlike("(?i)licen[cs]ed under")).alias("residual"))


@query("b6_chunk_projection", f"{CLEAN} SELECT doc_id, CASE WHEN trim(body, ' ' || chr(9) || chr(10)) = '' THEN 'deleted' WHEN body = text THEN 'unchanged' ELSE 'updated' END AS action FROM cleaned")
def b6(spark, sf_dir):
    """What becomes of a stored chunk: a chunk that changes loses its vector, an empty one goes."""
    empty = F.regexp_replace("body", "[ \\t\\n]", "") == ""
    return _cleaned(spark, sf_dir).select("doc_id", F.when(empty, "deleted").when(F.col("body") == F.col("text"), "unchanged").otherwise("updated").alias("action"))


@query("b14_cleanup_audit", f"{CLEAN} SELECT doc_id, sha256(text) AS before, sha256(body) AS after FROM cleaned WHERE body <> text")
def b14(spark, sf_dir):
    return _cleaned(spark, sf_dir).where("body <> text").select("doc_id", F.sha2("text", 256).alias("before"), F.sha2("body", 256).alias("after"))


@query("b8_stale_vectors", "SELECT vec_id, embedding IS NULL OR len(embedding) <> 64 OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR vec_id % 10 = 0 AS stale FROM embeddings")
def b8(spark, sf_dir):
    """Vectors to be made again: missing, of another length, with values that are not finite, or of a changed text."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = F.coalesce((F.size("embedding") == 64) & finite, F.lit(False))
    return table(spark, sf_dir, "embeddings").select("vec_id", (~sound | (F.col("vec_id") % 10 == 0)).alias("stale"))


@query("b9_marker_refresh", "SELECT page_id, regexp_replace('## Page ' || page_id || chr(10) || url, '(?m)^## Page ([0-9]+)$', '## PDF 第 \\1 页', 'g') AS body FROM pages")
def b9(spark, sf_dir):
    raw = F.concat(F.lit("## Page "), "page_id", F.lit("\n"), "url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(raw, r"(?m)^## Page (\d+)$", "## PDF 第 $1 页").alias("body"))


@query("b10_card_merge", f"{DOCS} SELECT d.document_id AS duplicate, 'doc:' || k.keeper AS redirect FROM docs d JOIN (SELECT family_id, min(doc_id) AS keeper FROM docs GROUP BY 1) k USING (family_id) WHERE d.doc_id <> k.keeper")
def b10(spark, sf_dir):
    """Redirects from cards to the one of exactly the same content that stays."""
    docs = documents(spark, sf_dir).select("document_id", "doc_id", "family_id")
    keeper = docs.groupBy("family_id").agg(F.min("doc_id").alias("keeper"))
    return docs.join(keeper, "family_id").where("doc_id <> keeper").select(F.col("document_id").alias("duplicate"), F.concat(F.lit("doc:"), "keeper").alias("redirect"))


def integrity(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change of every source that appeared, went, or differs in a field between two listings."""
    old, new = (df.select(key, F.struct(*fields).alias(name)) for df, name in ((before, "_old"), (after, "_new")))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return old.join(new, key, "full").where(~F.col("_old").eqNullSafe(F.col("_new"))).select(key, change.alias("change"))


@query(
    "b12_integrity_diff",
    """WITH a AS (SELECT doc_id, n_chars, lang FROM documents WHERE doc_id % 9 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, lang FROM documents WHERE doc_id % 10 <> 0)
    SELECT doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (doc_id)
    WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.n_chars IS DISTINCT FROM b.n_chars OR a.lang IS DISTINCT FROM b.lang""",
)
def b12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    later = docs.where("doc_id % 10 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 4 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return integrity(docs.where("doc_id % 9 <> 0"), later, "doc_id", ["n_chars", "lang"])


