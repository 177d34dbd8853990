"""Scalar functions of the reference as expressions, with queries that apply each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import registry
from ..views import DOCS, documents, table
from .text import excerpt, normalize, query_terms, split_blocks, terms

QUERIES, SQL, query = registry()


@query("f1_normalize", "SELECT p_partkey, lower(trim(regexp_replace(p_name || '  ' || p_type, '\\s+', ' ', 'g'))) AS name FROM part")
def f1(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("raw", F.concat("p_name", F.lit("  "), "p_type")).select("p_partkey", normalize("raw").alias("name"))


_TERM_SQL = "'\\p{Nd}+(?:[.,]\\p{Nd}+)+|[\\p{L}\\p{M}\\p{N}_]+(?:[''’][\\p{L}\\p{M}\\p{N}_]+)*'"


@query("f2_words", f"SELECT doc_id, len(regexp_extract_all(lower(text), {_TERM_SQL})) AS n, sha256(array_to_string(regexp_extract_all(lower(text), {_TERM_SQL}), ' ')) AS hash FROM documents")
def f2(spark, sf_dir):
    """Words of every text; letters of any script, in-word apostrophes and numbers kept whole."""
    found = table(spark, sf_dir, "documents").select("doc_id", terms(F.coalesce("text", F.lit(""))).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("hash"))


@query("f3_query_terms", "SELECT item_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:80], ' ') AS units FROM (SELECT item_id, regexp_extract_all(lower(text), '\\p{Nd}+(?:[.,]\\p{Nd}+)+|[\\p{L}\\p{M}\\p{N}_]+(?:[''’][\\p{L}\\p{M}\\p{N}_]+)*') AS w FROM benchmark)")
def f3(spark, sf_dir):
    """Texts as queries: their units, each once and in order, eighty at most."""
    units = F.pandas_udf(lambda s: s.map(lambda q: " ".join("+".join(u) for u in query_terms(q or ""))), "string")
    return table(spark, sf_dir, "benchmark").select("item_id", units("text").alias("units"))


@query("f7_type_from_slug", "SELECT url, CASE WHEN contains(url, '/en/') THEN 'en' WHEN contains(url, '/fr/') THEN 'fr' WHEN contains(url, '/de/') THEN 'de' WHEN contains(url, '/es/') THEN 'es' ELSE 'note' END AS type FROM pages")
def f7(spark, sf_dir):
    kind = F.regexp_extract("url", "/(en|fr|de|es)/", 1)
    return table(spark, sf_dir, "pages").select("url", F.when(kind == "", "note").otherwise(kind).alias("type"))


@query("f13_tag_group", f"{DOCS} SELECT tag, split_part(tag, ':', 1) AS grp, substr(tag, strpos(tag, ':') + 1) AS value FROM (SELECT DISTINCT unnest(tags) AS tag FROM docs)")
def f13(spark, sf_dir):
    tags = documents(spark, sf_dir).select(F.explode("tags").alias("tag")).distinct()
    return tags.select("tag", F.regexp_extract("tag", "^([^:：]*)[:：]", 1).alias("grp"), F.regexp_extract("tag", "^[^:：]*[:：](.*)$", 1).alias("value"))


@query("f15_excerpt", "SELECT doc_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '(?m)^#+ .*$', ' ', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM documents)")
def f15(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", excerpt("text").alias("excerpt"))


@query("f20_hashes", "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents")
def f20(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"), F.md5("text").alias("md5"))


@query("f22_token_estimate", "SELECT doc_id, CAST(ceil(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / 3.0 + (strlen(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')))) AS BIGINT) AS tokens FROM documents")
def f22(spark, sf_dir):
    """A third of a token for each ASCII character, one for each other byte."""
    ascii_ = F.char_length(F.regexp_replace("text", "[^\\x00-\\x7F]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.ceil(ascii_ / 3.0 + (F.octet_length("text") - ascii_)).cast("long").alias("tokens"))


@query("f24_around_match", "SELECT doc_id, substr(text, greatest(1, strpos(text, 'with') - 200), 1800) AS around FROM documents WHERE contains(text, 'with')")
def f24(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("with")))
    return docs.select("doc_id", F.expr("substring(text, greatest(1, locate('with', text) - 200), 1800)").alias("around"))


@query("d1_real_dates", "SELECT d, try_cast(d AS DATE) IS NOT NULL AS ok FROM (SELECT '2026-02-' || lpad(CAST(n_nationkey + 8 AS VARCHAR), 2, '0') AS d FROM nation)")
def d1(spark, sf_dir):
    d = F.concat(F.lit("2026-02-"), F.lpad((F.col("n_nationkey") + 8).cast("string"), 2, "0"))
    days = table(spark, sf_dir, "nation").select(d.alias("d"))
    return days.select("d", (F.col("d").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date("d", "yyyy-MM-dd").isNotNull()).alias("ok"))


@query("d8_backoff", "SELECT turn, min(least(300000, 30000 * CAST(pow(2, least(4, greatest(turn, 1) - 1)) AS BIGINT))) AS delay FROM conversations GROUP BY turn")
def d8(spark, sf_dir):
    delay = F.least(F.lit(300000), 30000 * F.pow(F.lit(2.0), F.least(F.lit(4), F.greatest("turn", F.lit(1)) - 1)).cast("long"))
    return table(spark, sf_dir, "conversations").groupBy("turn").agg(F.min(delay).alias("delay"))


@query("n2_discriminability", "SELECT l_partkey, round(2 / log2(2 + count(*)), 9) AS weight FROM lineitem GROUP BY 1")
def n2(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(2 / F.log2(2 + F.count("*")), 9).alias("weight"))


@query("r4_json", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events")
def r4(spark, sf_dir):
    """The value under the first key of a JSON object."""
    key = F.json_object_keys("props")[0]
    as_map = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.element_at(as_map, key).alias("first_value"))


@query("t1_blocks", "SELECT doc_id, CAST(k AS INTEGER) AS ordinal, CAST(1800 * k AS INTEGER) AS start_offset, CAST(least(1800 * (k + 1), length(text)) AS INTEGER) AS end_offset, sha256(substr(text, CAST(1800 * k + 1 AS BIGINT), 1800)) AS hash FROM (SELECT *, unnest(range(CAST(ceil(length(text) / 1800.0) AS BIGINT))) AS k FROM documents WHERE text <> '')")
def t1(spark, sf_dir):
    """Blocks of every document. The supplied texts have no markers, headings or blank lines: these are in t1_marked and the tests."""
    split = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_blocks(F.coalesce("text", F.lit("")))).alias("ordinal", "b"))
    return split.select("doc_id", "ordinal", "b.start_offset", "b.end_offset", F.sha2("b.text", 256).alias("hash"))


@query("t1_marked", """SELECT doc_id, CAST(k - 1 AS INTEGER) AS ordinal, CASE WHEN k > 1 THEN CAST(least(k - 1, 2) AS INTEGER) END AS pdf_page,
  CASE WHEN k = 1 THEN 'A' WHEN k = 2 THEN 'A|C' WHEN doc_id % 2 = 0 THEN 'A|D' ELSE 'E' END AS section FROM documents, range(1, 5) t(k)""")
def t1_marked(spark, sf_dir):
    """Pages and headings: a deeper heading ends with the next of its level or above; a long page ends at a blank line."""
    last = F.when(F.col("doc_id") % 2 == 0, "### D").otherwise("# E")
    fill = F.repeat(F.lit("x"), 1000)
    body = F.concat(F.lit("# A\ntext\n## PDF 第 1 页 \n### C\n## PDF 第 2 页\n"), last, F.lit("\n"), fill, F.lit("\n\n"), fill)
    split = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_blocks(body)).alias("ordinal", "b"))
    return split.select("doc_id", "ordinal", "b.pdf_page", F.array_join("b.section", "|").alias("section"))
