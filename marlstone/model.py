"""The wider corpus model over the supplied tables: pages with metadata, blocks, a registry of entities, mentions.

Each view has its SQL beside it, as common table expressions for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import split_blocks
from .views import table

#: Tags that carry entities begin with one of these and a colon. Fixed values.
PREFIXES = {"公司": "company", "行业": "industry", "领域": "subfield", "主题": "topic", "代码": "security"}


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each document: slug, title, type, category (missing for some), tags, entity fields, dates, stage, relations."""
    n, ninth = F.col("doc_id"), F.expr("doc_id div 9")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 365).cast("int")), "yyyy-MM-dd")
    company = F.when(n % 6 == 0, F.concat(F.lit("Supplier#"), F.lpad((n % 10 + 1).cast("string"), 9, "0")))
    company = company.when(n % 6 == 1, F.concat(F.lit("Acme "), n % 7)).when(n % 6 == 2, F.concat(F.lit("Unknown  Co "), n % 9))
    company = company.when(n % 6 == 3, F.concat(F.lit("Supplier#"), F.lpad((n % 10 + 1).cast("string"), 9, "0"), F.lit(" (HK:"), F.lpad((n % 10 + 1).cast("string"), 5, "0"), F.lit(")")))
    ticker = F.when(n % 4 == 0, F.concat(F.lit("HK:"), F.lpad((n % 25 + 1).cast("string"), 5, "0")))
    tag = F.when(n % 5 == 0, F.concat(F.lit("公司: Acme "), n % 7)).when(n % 5 == 1, F.concat(F.lit("行业:"), "source"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc:"), n).alias("document_id"),
        "doc_id",
        F.concat(F.when(n % 3 == 0, "sources/").when(n % 3 == 1, "notes/").otherwise("wiki/"), F.lit("p-"), n).alias("slug"),
        F.concat(F.lit("Report "), n, F.lit(" from "), "source").alias("title"),
        F.sha2("text", 256).alias("family_id"),
        F.sha2(F.concat_ws("\n", F.concat(F.lit("Report "), n), "text"), 256).alias("revision_id"),
        F.when(n % 8 != 0, F.concat(F.lit("cat"), n % 5)).alias("category"),
        F.array_compact(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("src:"), "source"), tag)).alias("tags"),
        F.array_compact(F.array(company)).alias("companies"),
        F.array_compact(F.array(ticker)).alias("tickers"),
        F.when(n % 7 != 0, day).alias("published_at"),
        F.when(n % 5 != 0, F.col("source")).alias("institution"),
        F.when(n % 4 == 0, "archived").when(n % 4 == 1, "draft").when(n % 4 == 2, "active").alias("stage"),
        day.alias("updated_at"),
        F.when(n % 9 == 0, F.concat(F.when(ninth % 3 == 0, "sources/").when(ninth % 3 == 1, "notes/").otherwise("wiki/"), F.lit("p-"), ninth)).alias("supported_by"),
        (n % 11 == 0).alias("deleted"),
        "text",
        "lang",
        "source",
        "n_chars",
    )


#: pages, for DuckDB.
PAGES = """pages_ AS (SELECT 'doc:' || doc_id AS document_id, doc_id,
    CASE doc_id % 3 WHEN 0 THEN 'sources/' WHEN 1 THEN 'notes/' ELSE 'wiki/' END || 'p-' || doc_id AS slug,
    'Report ' || doc_id || ' from ' || source AS title, sha256(text) AS family_id, sha256(concat_ws(chr(10), 'Report ' || doc_id, text)) AS revision_id,
    CASE WHEN doc_id % 8 <> 0 THEN 'cat' || (doc_id % 5) END AS category,
    list_filter(['lang:' || lang, 'src:' || source, CASE WHEN doc_id % 5 = 0 THEN '公司: Acme ' || (doc_id % 7) WHEN doc_id % 5 = 1 THEN '行业:' || source END], lambda x: x IS NOT NULL) AS tags,
    list_filter([CASE doc_id % 6 WHEN 0 THEN 'Supplier#' || lpad(CAST(doc_id % 10 + 1 AS VARCHAR), 9, '0') WHEN 1 THEN 'Acme ' || (doc_id % 7) WHEN 2 THEN 'Unknown  Co ' || (doc_id % 9)
      WHEN 3 THEN 'Supplier#' || lpad(CAST(doc_id % 10 + 1 AS VARCHAR), 9, '0') || ' (HK:' || lpad(CAST(doc_id % 10 + 1 AS VARCHAR), 5, '0') || ')' END], lambda x: x IS NOT NULL) AS companies,
    list_filter([CASE WHEN doc_id % 4 = 0 THEN 'HK:' || lpad(CAST(doc_id % 25 + 1 AS VARCHAR), 5, '0') END], lambda x: x IS NOT NULL) AS tickers,
    CASE WHEN doc_id % 7 <> 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') END AS published_at,
    CASE WHEN doc_id % 5 <> 0 THEN source END AS institution,
    CASE doc_id % 4 WHEN 0 THEN 'archived' WHEN 1 THEN 'draft' WHEN 2 THEN 'active' END AS stage,
    strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS updated_at,
    CASE WHEN doc_id % 9 = 0 THEN CASE (doc_id // 9) % 3 WHEN 0 THEN 'sources/' WHEN 1 THEN 'notes/' ELSE 'wiki/' END || 'p-' || (doc_id // 9) END AS supported_by,
    doc_id % 11 = 0 AS deleted, text, lang, source, n_chars FROM documents)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every page: document_id, revision_id, block_id, ordinal, offsets, pdf_page, section, text."""
    split = pages(spark, sf_dir).select("document_id", "doc_id", "revision_id", "deleted", F.posexplode(split_blocks(F.coalesce("text", F.lit("")))).alias("ordinal", "b"))
    return split.select("document_id", "doc_id", "revision_id", "deleted", F.concat("revision_id", F.lit(":"), "ordinal").alias("block_id"), "ordinal", "b.*")


#: blocks, for DuckDB: the supplied texts have no page markers, headings or blank lines, so a block is a slice.
BLOCKS = """blocks_ AS (SELECT document_id, doc_id, revision_id, deleted, revision_id || ':' || k AS block_id, CAST(k AS INTEGER) AS ordinal, CAST(1800 * k AS INTEGER) AS start_offset,
    CAST(least(1800 * (k + 1), length(text)) AS INTEGER) AS end_offset, substr(text, CAST(1800 * k + 1 AS BIGINT), 1800) AS text
  FROM (SELECT *, unnest(range(CAST(ceil(length(text) / 1800.0) AS BIGINT))) AS k FROM pages_ WHERE text <> ''))"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry: suppliers are companies, each with an alias that some share, and issuers of one security in Hong Kong;
    regions are topics."""
    s = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier")
    code = F.lpad(s.cast("string"), 5, "0")
    company = suppliers.select(
        F.concat(F.lit("entity:company:"), s).alias("entity_id"), F.lit("company").alias("type"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("Acme "), s % 20)).alias("aliases"),
        F.lit(None).cast("string").alias("market"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("issuer_id"),
    )
    security = suppliers.select(
        F.concat(F.lit("entity:security:"), s), F.lit("security"), F.concat("s_name", F.lit(" Ord")), F.array(F.concat(F.lit("HK:"), code), F.concat(code, F.lit(".HK"))), F.lit("HK"), code, F.concat(F.lit("entity:company:"), s),
    )
    topic = table(spark, sf_dir, "region").select(
        F.concat(F.lit("entity:topic:"), "r_regionkey"), F.lit("topic"), "r_name", F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"),
    )
    return company.union(security).union(topic)


#: entities, for DuckDB.
ENTITIES = """entities_ AS (
  SELECT 'entity:company:' || s_suppkey AS entity_id, 'company' AS type, s_name AS name, ['Acme ' || (s_suppkey % 20)] AS aliases, CAST(NULL AS VARCHAR) AS market, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS issuer_id FROM supplier
  UNION ALL SELECT 'entity:security:' || s_suppkey, 'security', s_name || ' Ord', ['HK:' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0'), lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || '.HK'], 'HK', lpad(CAST(s_suppkey AS VARCHAR), 5, '0'), 'entity:company:' || s_suppkey FROM supplier
  UNION ALL SELECT 'entity:topic:' || r_regionkey, 'topic', r_name, [], NULL, NULL, NULL FROM region),
alias_ AS (SELECT type, norm, list_sort(list(DISTINCT entity_id)) AS ids FROM (SELECT type, entity_id, lower(trim(regexp_replace(unnest(list_concat([name], aliases)), '\\s+', ' ', 'g'))) AS norm FROM entities_) GROUP BY 1, 2)"""


def normal(name: Column) -> Column:
    """Names as they are compared, for names without wide forms: white space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


#: Mentions of pages, for DuckDB: from fields, and from tags with a known prefix.
MENTIONS = """mentions_ AS (SELECT DISTINCT document_id, type, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS norm, trim(name) AS name, field, raw FROM (
  SELECT document_id, 'company' AS type, unnest(companies) AS name, 'companies' AS field, unnest(companies) AS raw FROM pages_
  UNION ALL SELECT document_id, 'security', unnest(tickers), 'tickers', unnest(tickers) FROM pages_
  UNION ALL SELECT document_id, CASE split_part(tag, ':', 1) WHEN '公司' THEN 'company' WHEN '行业' THEN 'industry' WHEN '领域' THEN 'subfield' WHEN '主题' THEN 'topic' WHEN '代码' THEN 'security' END,
    substr(tag, strpos(tag, ':') + 1), 'tags', tag FROM (SELECT document_id, unnest(tags) AS tag FROM pages_) WHERE split_part(tag, ':', 1) IN ('公司', '行业', '领域', '主题', '代码')) WHERE trim(name) <> ''),
resolved_ AS (SELECT m.*, a.ids, CASE WHEN len(a.ids) > 1 THEN 'ambiguous' WHEN len(a.ids) = 1 THEN 'curated'
    WHEN p.entity_id IS NOT NULL THEN 'curated' ELSE 'observed' END AS status,
  CASE WHEN len(a.ids) = 1 THEN a.ids[1] WHEN len(a.ids) > 1 THEN NULL WHEN p.entity_id IS NOT NULL THEN p.entity_id
    ELSE 'entity:observed:' || substr(sha256(m.type || ':' || m.norm), 1, 24) END AS entity_id
  FROM mentions_ m LEFT JOIN alias_ a ON a.type = m.type AND a.norm = m.norm
  LEFT JOIN (SELECT norm, min(id) AS entity_id FROM (SELECT DISTINCT q.norm, e.issuer_id AS id
      FROM (SELECT DISTINCT norm, trim(regexp_extract(norm, '^(.+?)\\s*\\(([^()]+)\\)$', 1)) AS base, trim(regexp_extract(norm, '^(.+?)\\s*\\(([^()]+)\\)$', 2)) AS code FROM mentions_ WHERE type = 'company' AND regexp_matches(norm, '^(.+?)\\s*\\(([^()]+)\\)$')) q
      JOIN alias_ s ON s.type = 'security' AND s.norm = q.code JOIN entities_ e ON list_contains(s.ids, e.entity_id)
      JOIN alias_ n ON n.type = 'company' AND n.norm = q.base AND list_contains(n.ids, e.issuer_id)) GROUP BY 1 HAVING count(*) = 1) p ON m.type = 'company' AND p.norm = m.norm)"""

MODEL = f"WITH {PAGES}, {ENTITIES}, {MENTIONS} "
