"""The catalogue: order with missing values last in both directions, keyset pages, facets, groups, budgets."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import MODEL, entities, pages
from ..registry import registry
from ..views import DOCS, documents
from .filters import FIELDS, InvalidArgument, apply_filter, compile_filter

QUERIES, SQL, query = registry()


def ordering(key: str, descending: bool) -> list[Column]:
    """key with missing values last whichever the direction; ties by document_id, upwards."""
    return [F.desc_nulls_last(key) if descending else F.asc_nulls_last(key), F.asc("document_id")]


def after(key: str, descending: bool, value: str | None, document_id: str) -> Column:
    """Rows that follow the row (value, document_id) in that order."""
    same = F.col(key).eqNullSafe(F.lit(value)) & (F.col("document_id") > document_id)
    if value is None:
        return same
    beyond = F.col(key) < value if descending else F.col(key) > value
    return same | F.coalesce(beyond, F.lit(False)) | F.col(key).isNull()


def token(request: dict, row: dict, key: str) -> str:
    """A stateless cursor: where the page ended and a hash of what was asked."""
    body = {"h": _hash(request), "v": row[key], "id": row["document_id"]}
    return base64.urlsafe_b64encode(json.dumps(body).encode()).decode()


def _hash(request: dict) -> str:
    return hashlib.sha256(json.dumps(request, sort_keys=True).encode()).hexdigest()[:16]


def opened(cursor: str, request: dict) -> tuple[str | None, str]:
    """The place a cursor points to; it must belong to this request."""
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor))
        place = body["v"], body["id"]
    except Exception as error:
        raise InvalidArgument("INVALID_CURSOR") from error
    if body.get("h") != _hash(request):
        raise InvalidArgument("CURSOR_MISMATCH")
    return place


def page(docs: DataFrame, filters: dict | None = None, sort: str = "published_at", descending: bool = True, limit: int = 20, cursor: str | None = None) -> DataFrame:
    """One row more than limit if there are more; a bounded top-k on each task, no global sort."""
    if not 1 <= limit <= 100:
        raise InvalidArgument("limit must be from 1 to 100")
    found = apply_filter(docs.where(~F.col("deleted")), filters)
    if cursor is not None:
        request = {"filters": filters, "sort": sort, "descending": descending}
        found = found.where(after(sort, descending, *opened(cursor, request)))
    return found.orderBy(*ordering(sort, descending)).limit(limit + 1)


@query("p_catalog_page", f"{DOCS} SELECT document_id, title, published_at FROM docs WHERE NOT deleted AND coalesce(published_at >= '2024-03-01', false) AND list_has_any(tags, ['lang:en', 'lang:de']) ORDER BY published_at DESC NULLS LAST, document_id LIMIT 21")
def catalog_page(spark, sf_dir):
    filters = {"all": [{"field": "published_at", "op": "gte", "value": "2024-03-01"}, {"field": "tags", "op": "contains_any", "value": ["lang:en", "lang:de"]}]}
    return page(documents(spark, sf_dir), filters).select("document_id", "title", "published_at")


@query("o1_nulls_last", f"{DOCS} SELECT document_id, published_at FROM docs WHERE NOT deleted AND lang = 'es' AND source = 'src3' ORDER BY published_at ASC NULLS LAST, document_id LIMIT 101")
def o1(spark, sf_dir):
    return page(documents(spark, sf_dir).where("lang = 'es' and source = 'src3'"), descending=False, limit=100).select("document_id", "published_at")


@query("o2_keyset_next", f"{DOCS} SELECT document_id, published_at FROM docs WHERE NOT deleted AND (published_at < '2024-06-10' OR (published_at = '2024-06-10' AND document_id > 'doc:161') OR published_at IS NULL) ORDER BY published_at DESC NULLS LAST, document_id LIMIT 51")
def o2(spark, sf_dir):
    request = {"filters": None, "sort": "published_at", "descending": True}
    cursor = token(request, {"published_at": "2024-06-10", "document_id": "doc:161"}, "published_at")
    return page(documents(spark, sf_dir), limit=50, cursor=cursor).select("document_id", "published_at")


@query("o2_keyset_null_phase", f"{DOCS} SELECT document_id, published_at FROM docs WHERE NOT deleted AND published_at IS NULL AND document_id > 'doc:3' ORDER BY document_id LIMIT 31")
def o2_null(spark, sf_dir):
    request = {"filters": None, "sort": "published_at", "descending": True}
    return page(documents(spark, sf_dir), limit=30, cursor=token(request, {"published_at": None, "document_id": "doc:3"}, "published_at")).select("document_id", "published_at")


@query("o4_budget", f"{DOCS} SELECT document_id, used FROM (SELECT document_id, row_number() OVER w AS n, CAST(sum(length(title) + length(document_id)) OVER w AS BIGINT) AS used FROM (SELECT * FROM docs WHERE NOT deleted ORDER BY document_id LIMIT 100) WINDOW w AS (ORDER BY document_id ROWS UNBOUNDED PRECEDING)) WHERE used <= 1000")
def o4(spark, sf_dir, budget: int = 1000):
    """Rows in order while their text fits the response budget; a first row that does not fit is refused by the service."""
    first = documents(spark, sf_dir).where(~F.col("deleted")).orderBy("document_id").limit(100)
    w = Window.orderBy("document_id").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length("title") + F.length("document_id")).over(w).cast("long")
    return first.select("document_id", F.row_number().over(Window.orderBy("document_id")).alias("n"), used.alias("used")).where(F.col("used") <= budget).select("document_id", "used")


@query("o8_exact_first", f"{DOCS} SELECT document_id, title, lower(title) = 'report 12 from src12' AS exact FROM docs WHERE contains(lower(title), 'report 12') ORDER BY exact DESC, title, document_id LIMIT 20")
def o8(spark, sf_dir):
    docs = documents(spark, sf_dir).where(F.contains(F.lower("title"), F.lit("report 12")))
    return docs.select("document_id", "title", (F.lower("title") == "report 12 from src12").alias("exact")).orderBy(F.desc("exact"), "title", "document_id").limit(20)


@query("o9_lookup_relevance", f"{DOCS} SELECT document_id, CASE WHEN lower(title) = 'report 2 from src2' THEN 3 WHEN starts_with(lower(title), 'report 2') THEN 2 WHEN contains(lower(title), 'src2') THEN 1 ELSE 0 END AS relevance FROM docs ORDER BY relevance DESC, published_at DESC NULLS LAST, document_id LIMIT 40")
def o9(spark, sf_dir):
    t = F.lower("title")
    score = F.when(t == "report 2 from src2", 3).when(F.startswith(t, F.lit("report 2")), 2).when(F.contains(t, F.lit("src2")), 1).otherwise(0)
    return documents(spark, sf_dir).withColumn("relevance", score).orderBy(F.desc("relevance"), F.desc_nulls_last("published_at"), "document_id").limit(40).select("document_id", "relevance")


@query("o10_offset_page", f"{DOCS}, c AS (SELECT count(*) AS total FROM docs WHERE NOT deleted) SELECT document_id, total FROM docs, c WHERE NOT deleted ORDER BY document_id LIMIT 25 OFFSET 50")
def o10(spark, sf_dir):
    """A page by offset with the total, counted apart so that no task sees all rows."""
    live = documents(spark, sf_dir).where(~F.col("deleted"))
    total = live.agg(F.count("*").alias("total"))
    return live.orderBy("document_id").offset(50).limit(25).join(F.broadcast(total)).select("document_id", "total")


def group_counts(docs: DataFrame, field: str, array: bool) -> DataFrame:
    """Documents per value: a missing scalar is a group, an empty list is in none."""
    value = F.explode(F.array_distinct(field)) if array else F.col(field)
    return docs.select("document_id", value.alias("value")).groupBy("value").agg(F.countDistinct("document_id").alias("n"))


@query("a3_group_array", f"{DOCS} SELECT value, count(DISTINCT document_id) AS n FROM (SELECT document_id, unnest(tags) AS value FROM docs WHERE NOT deleted) GROUP BY value")
def a3_array(spark, sf_dir):
    return group_counts(documents(spark, sf_dir).where(~F.col("deleted")), "tags", True)


@query("a3_group_scalar", f"{DOCS} SELECT institution AS value, count(DISTINCT document_id) AS n FROM docs WHERE NOT deleted GROUP BY institution")
def a3_scalar(spark, sf_dir):
    return group_counts(documents(spark, sf_dir).where(~F.col("deleted")), "institution", False)


@query("a1_coverage", f"{DOCS} SELECT count(*) AS documents, count(*) FILTER (WHERE NOT deleted) AS live, count(*) FILTER (WHERE published_at IS NULL) AS undated, count(*) FILTER (WHERE institution IS NULL) AS unnamed, count(*) FILTER (WHERE n_chars < 200) AS short FROM docs")
def a1(spark, sf_dir):
    """Coverage in one pass."""
    return documents(spark, sf_dir).agg(
        F.count("*").alias("documents"), F.count_if(~F.col("deleted")).alias("live"), F.count_if(F.col("published_at").isNull()).alias("undated"), F.count_if(F.col("institution").isNull()).alias("unnamed"), F.count_if(F.col("n_chars") < 200).alias("short")
    )


@query("a2_tag_dictionary", f"{DOCS} SELECT tag, 'tag:' || substr(sha256(tag), 1, 24) AS tag_id, split_part(tag, ':', 1) AS category, count(DISTINCT document_id) AS n FROM (SELECT document_id, unnest(tags) AS tag FROM docs WHERE NOT deleted) GROUP BY tag")
def a2(spark, sf_dir):
    tags = documents(spark, sf_dir).where(~F.col("deleted")).select("document_id", F.explode("tags").alias("tag"))
    counted = tags.groupBy("tag").agg(F.countDistinct("document_id").alias("n"))
    return counted.select("tag", F.concat(F.lit("tag:"), F.substring(F.sha2("tag", 256), 1, 24)).alias("tag_id"), F.split("tag", ":")[0].alias("category"), "n")


@query(
    "x_describe",
    MODEL + """SELECT f.field, f.kind, CAST(CASE f.field WHEN 'entity_ids' THEN (SELECT count(DISTINCT document_id) FROM resolved_ SEMI JOIN (SELECT document_id FROM pages_ WHERE NOT deleted) USING (document_id) WHERE entity_id IS NOT NULL) ELSE (SELECT count(*) FROM pages_ WHERE NOT deleted AND CASE f.field
      WHEN 'tickers' THEN doc_id % 4 = 0 WHEN 'markets' THEN doc_id % 4 = 0 WHEN 'companies' THEN doc_id % 6 < 4 WHEN 'industries' THEN doc_id % 5 = 1 WHEN 'institutions' THEN doc_id % 5 <> 0 WHEN 'institution' THEN doc_id % 5 <> 0
      WHEN 'authors' THEN doc_id % 3 <> 0 WHEN 'research_category' THEN doc_id % 8 <> 0 WHEN 'research_stage' THEN doc_id % 4 <> 3 WHEN 'review_status' THEN doc_id % 2 = 0 WHEN 'published_at' THEN doc_id % 7 <> 0 WHEN 'data_as_of' THEN doc_id % 3 = 0
      ELSE f.field IN ('tags', 'page_type', 'language', 'lang', 'ingested_at', 'updated_at', 'title', 'document_id') END) END AS BIGINT) AS documents FROM (SELECT unnest("""
    + f"{list(FIELDS)}) AS field, unnest({list(FIELDS.values())}) AS kind) f",
)
def describe(spark, sf_dir):
    """The fields that may be filtered, their kinds, and how many live documents have each."""
    from ..plans.service import metadata
    from .mentions import mentions, resolved
    from .pages import frozen

    docs = pages(spark, sf_dir)
    members = resolved(mentions(docs), entities(spark, sf_dir)).where("entity_id is not null").select("document_id", "entity_id").distinct()
    rows = frozen(metadata(docs.where(~F.col("deleted")).drop("text")), members)
    there = [F.count_if(compile_filter({"field": f, "op": "exists", "value": True})).alias(f) if f in rows.columns else F.lit(0).cast("long").alias(f) for f in FIELDS]
    found = rows.agg(*there)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(kind).alias("kind"), F.col(f).alias("documents")) for f, kind in FIELDS.items()])
    return found.select(F.explode(pairs).alias("x")).select("x.*")
