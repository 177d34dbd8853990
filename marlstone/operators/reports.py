"""Report bibliography: rating stances, identity slugs, dictionaries, naming contract, body checks, forecast grounding."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import registry
from ..functions.strings import folded_key
from ..views import DOCS, documents, table
from .windows import first_per

QUERIES, SQL, query = registry()

# Rating labels of each stance, without spaces and hyphens.
STANCES = {
    "bullish": ("buy", "strongbuy", "overweight", "outperform", "accumulate", "positive", "买入", "增持", "跑赢大市", "优于大市", "推荐", "强烈推荐"),
    "neutral": ("hold", "neutral", "equalweight", "marketperform", "中性", "持有", "与大市同步"),
    "bearish": ("sell", "underweight", "underperform", "reduce", "negative", "卖出", "减持", "跑输大市", "弱于大市"),
    "not_rated": ("notrated", "unrated", "nr", "未评级", "无评级"),
}
# Topics that a report's file name may carry.
TOPICS = ("Semis", "Tech-Hardware", "Internet", "Software", "Telecom-Media", "Macro", "Rates-Credit", "FX", "Energy", "Metals-Mining", "Chemicals-Industrials", "Financials", "Cross-Asset", "Other", "Unknown")


def rating_stance(label: Column) -> Column:
    """Stance of a rating label; null for labels that are not known."""
    plain = F.regexp_replace(F.lower(label), r"[\s-]", "")
    return reduce(lambda rest, s: F.when(plain.isin(*STANCES[s]), s).otherwise(rest), STANCES, F.lit(None).cast("string"))


@query("t13_rating_stance", "SELECT label, CASE label WHEN 'Strong Buy' THEN 'bullish' WHEN 'Equal-Weight' THEN 'neutral' WHEN 'SELL' THEN 'bearish' WHEN 'Not Rated' THEN 'not_rated' END AS stance, count(*) AS n FROM (SELECT ['Strong Buy', 'Equal-Weight', 'SELL', 'Not Rated', 'Unclear'][doc_id % 5 + 1] AS label FROM documents) GROUP BY 1")
def t13(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("Strong Buy", "Equal-Weight", "SELL", "Not Rated", "Unclear")])
    labels = table(spark, sf_dir, "documents").select(F.get(names, (F.col("doc_id") % 5).cast("int")).alias("label"))
    return labels.groupBy("label").agg(F.count("*").alias("n")).withColumn("stance", rating_stance(F.col("label")))


def _unaccented(names: pd.Series) -> pd.Series:
    """Letters without their accents, wide forms as plain ones."""
    return names.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not "\u0300" <= c <= "\u036f"))


def analyst_id(name: Column) -> Column:
    """Slug of a person: first name and surname with its particles, degrees dropped; ``research`` if nothing is left."""
    name = F.coalesce(name, F.lit(""))
    ascii_ = name.rlike("^[\\x00-\\x7F]*$")  # these go to Python as nulls
    name = F.when(ascii_, name).otherwise(F.pandas_udf(_unaccented, "string")(F.when(~ascii_, name)))
    plain = F.split_part(name, F.lit(","), F.lit(1))
    plain = F.regexp_replace(plain, r"(?i)Ph\.\s*D\.?|\b(?:CFA|CPA|CAIA|Jr\.?|MD|AC)\b", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"\.", ""), r"\s+", " "))
    # Degrees (above) and particles of names. Names between the first and the surname go, particles right before the surname stay.
    short = F.regexp_replace(plain, r"(?i)^(\S+) (?:\S+ )*?((?:(?:von|van|der|den|de|da|di|du|del|della|le|la|bin|al|el) )*\S+)$", "$1-$2")
    slug = F.lower(F.regexp_replace(F.regexp_replace(short, " ", "-"), "[^A-Za-z0-9-]", ""))
    return F.when(slug == "", "research").otherwise(slug)


@query("t22_analyst_id", "SELECT s_suppkey, lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) || '-van-der-' || lower(r_name[1]) || s_suppkey AS analyst_id FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def t22(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    raw = F.concat(F.regexp_replace("n_name", "[^A-Za-z0-9]", ""), F.lit(" Q. Middle van der "), F.substring("r_name", 1, 1), "s_suppkey", F.lit(" CFA, Head of Research"))
    return rows.select("s_suppkey", analyst_id(raw).alias("analyst_id"))


def dictionary_key(value: str | Column) -> Column:
    """Comparison form of a name: compatibility form, lower case, without white space and punctuation."""
    return folded_key(F.col(value) if isinstance(value, str) else value)


def dictionary_match(values: DataFrame, entries: DataFrame) -> DataFrame:
    """values (value, scope, ...) with match: the id of the only entry (id, scope, alias) that the value names.

    An entry of another scope does not count; where the value or the entry has no scope, any does. Two entries are
    ambiguous and match nothing. Aggregated by value and scope, so that a frequent name is looked up once.
    """
    known = entries.select("id", F.col("scope").alias("entry_scope"), dictionary_key("alias").alias("key")).where("key <> ''").distinct()
    asked = values.select("value", "scope").distinct().withColumn("key", dictionary_key("value"))
    allowed = F.col("scope").isNull() | F.col("entry_scope").isNull() | (F.col("scope") == F.col("entry_scope"))
    found = asked.join(known, "key").where(allowed).groupBy("value", "scope").agg(F.countDistinct("id").alias("n"), F.min("id").alias("match")).where("n = 1")
    found = found.select(F.col("value").alias("_v"), F.col("scope").alias("_s"), "match")
    return values.join(found, F.col("value").eqNullSafe(F.col("_v")) & F.col("scope").eqNullSafe(F.col("_s")), "left").drop("_v", "_s")


def _people(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Suppliers as a dictionary of people, each with two aliases; customers as the names to look up."""
    supplier = table(spark, sf_dir, "supplier")
    both = F.explode(F.array(F.col("s_name"), F.concat(F.lit("S. "), F.col("s_suppkey") % 40)))
    entries = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("scope"), both.alias("alias"))
    name = F.concat(F.lit("s-"), F.col("c_custkey") % 60)
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("value"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("scope")), entries


PEOPLE = """WITH entries AS (SELECT s_suppkey AS id, s_nationkey AS scope, 's' || (s_suppkey % 40) AS key FROM supplier),
asked AS (SELECT c_custkey, 's-' || (c_custkey % 60) AS value, 's' || (c_custkey % 60) AS key, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS scope FROM customer),
matched AS (SELECT c_custkey, value, a.scope, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS match
  FROM asked a LEFT JOIN entries e ON a.key = e.key AND (a.scope IS NULL OR a.scope = e.scope) GROUP BY ALL) """


@query("t23_dictionary_match", f"{PEOPLE} SELECT * FROM matched")
def t23(spark, sf_dir):
    return dictionary_match(*_people(spark, sf_dir))


@query("t24_publisher", f"{PEOPLE} SELECT m.c_custkey, coalesce(v.s_name, s.s_name, n_name) AS publisher, CASE WHEN v.s_name IS NOT NULL THEN 'verified' WHEN s.s_name IS NOT NULL THEN 'dictionary' ELSE 'directory' END AS match_source FROM matched m JOIN customer c USING (c_custkey) JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier v ON v.s_suppkey = m.c_custkey LEFT JOIN supplier s ON s.s_suppkey = m.match")
def t24(spark, sf_dir):
    """The first that is known of a verified name, a dictionary entry and the folder."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    matched = dictionary_match(*_people(spark, sf_dir)).select("c_custkey", "match")
    folder = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = matched.join(folder, "c_custkey").join(names.select(F.col("k").alias("c_custkey"), F.col("s_name").alias("verified")), "c_custkey", "left")
    rows = rows.join(names.select(F.col("k").alias("match"), F.col("s_name").alias("known")), "match", "left")
    source = F.when(F.col("verified").isNotNull(), "verified").when(F.col("known").isNotNull(), "dictionary").otherwise("directory")
    return rows.select("c_custkey", F.coalesce("verified", "known", "n_name").alias("publisher"), source.alias("match_source"))


@query("t25_bibliography", f"{PEOPLE} SELECT c_nationkey, string_agg(DISTINCT name, '|' ORDER BY name) AS authors FROM (SELECT c_nationkey, coalesce(s_name, value) AS name FROM matched JOIN customer USING (c_custkey) LEFT JOIN supplier ON s_suppkey = match) GROUP BY 1")
def t25(spark, sf_dir):
    """Names of each group in their dictionary form, each once; unknown ones stay as they are."""
    home = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = dictionary_match(*_people(spark, sf_dir)).join(home, "c_custkey").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("match"), "s_name"), "match", "left")
    named = rows.select("c_nationkey", F.coalesce("s_name", "value").alias("name")).distinct()
    return named.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list("name")), "|").alias("authors"))


@query(
    "t26_author_bootstrap",
    """WITH seen AS (SELECT p_brand AS author, p_type AS name, p_partkey FROM part),
    names AS (SELECT author, name, count(*) AS n FROM seen GROUP BY 1, 2),
    best AS (SELECT author, arg_min(name, (-n, name)) AS name, count(*) AS aliases FROM names GROUP BY 1),
    proof AS (SELECT author, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY p_partkey) AS k FROM seen) WHERE k <= 3 GROUP BY 1)
    SELECT author, name, aliases, evidence FROM best JOIN proof USING (author)""",
)
def t26(spark, sf_dir):
    """Dictionary of authors from evidence: the commonest spelling, how many there are, and the first three proofs."""
    seen = table(spark, sf_dir, "part").select(F.col("p_brand").alias("author"), F.col("p_type").alias("name"), "p_partkey")
    names = seen.groupBy("author", "name").agg(F.count("*").alias("n"))
    best = names.groupBy("author").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("name"), F.count("*").alias("aliases"))
    # Three proofs of each author by rank, which keeps three rows of a partition before the shuffle.
    proof = first_per(seen, ["author"], ["p_partkey"], 3).groupBy("author").agg(F.sort_array(F.collect_list("p_partkey")).alias("e"))
    return best.join(proof, "author").select("author", "name", "aliases", F.array_join(F.transform("e", lambda x: x.cast("string")), ",").alias("evidence"))


# The parts of a file name by contract.
def file_name_ok(name: Column, brokers: list[str]) -> Column:
    """Whether a file name keeps the contract: date, broker, analyst, topic, tickers, title and pages in seven parts."""
    part = lambda k: F.split_part(F.regexp_replace(name, r"\.pdf$", ""), F.lit("_"), F.lit(k))
    shape = name.rlike(r"^[\x20-\x7e]+\.pdf$") & (F.char_length(name) <= 240) & (F.size(F.split(name, "_")) == 7)
    day = part(1).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(part(1), "yyyy-MM-dd").isNotNull()
    title = part(6).rlike("^[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*$") & (F.char_length(part(6)) <= 90)
    who = part(2).isin(brokers) & part(3).rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$") & part(4).isin(*TOPICS)
    return shape & day & who & part(5).rlike(r"^[A-Z0-9.]+(?:\+[A-Z0-9.]+){0,3}$") & title & part(7).rlike(r"^\d+p$")


@query("t21_file_name_contract", "SELECT o_orderkey, o_orderkey % 4 <> 3 AND o_orderkey % 5 <> 0 AS ok FROM orders")
def t21(spark, sf_dir):
    k = F.col("o_orderkey")
    day = F.when(k % 4 == 3, "2026-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    name = F.concat_ws("_", day, F.lit("GS"), F.concat(F.lit("a-b"), k), F.when(k % 5 == 0, "Weather").otherwise("Macro"), F.concat(F.lit("T"), k, F.lit("+X.Y")), F.lit("Some-Title"), F.concat(F.lit("7p"), F.lit(".pdf")))
    return table(spark, sf_dir, "orders").select("o_orderkey", file_name_ok(name, ["GS", "MS"]).alias("ok"))


@query(
    "t19_broker_check",
    """WITH c AS (SELECT doc_id, lang, len(regexp_extract_all(text, '(?i) (?:the|and) ')) AS en, len(regexp_extract_all(text, '(?i) (?:der|und) ')) AS de, len(regexp_extract_all(text, '(?i) (?:le|et) ')) AS fr, length(regexp_replace(text, '\\s', '', 'g')) AS ink FROM documents),
    m AS (SELECT *, greatest(en, de, fr) AS top FROM c)
    SELECT doc_id, CASE WHEN ink < 80 OR top = 0 THEN 'unchecked' WHEN (lang = 'en' AND en = top) OR (lang = 'de' AND de = top) OR (lang = 'fr' AND fr = top) THEN 'matched'
      WHEN (en = top)::INT + (de = top)::INT + (fr = top)::INT > 1 THEN 'ambiguous' ELSE 'mismatch' END AS status FROM m""",
)
def t19(spark, sf_dir):
    """Whether the body speaks for what was selected: most pattern hits; a tie that includes it is a match."""
    bodies = {"en": r"(?i) (?:the|and) ", "de": r"(?i) (?:der|und) ", "fr": r"(?i) (?:le|et) "}
    counted = table(spark, sf_dir, "documents").select("doc_id", "lang", F.char_length(F.regexp_replace("text", r"\s", "")).alias("ink"), *[F.regexp_count("text", F.lit(p)).alias(k) for k, p in bodies.items()])
    top = F.greatest(*bodies)
    tied = F.array_compact(F.array(*[F.when(F.col(k) == top, k) for k in bodies]))
    status = F.when((F.col("ink") < 80) | (top == 0), "unchecked").when(F.array_contains(tied, F.col("lang")), "matched").when(F.size(tied) > 1, "ambiguous").otherwise("mismatch")
    return counted.select("doc_id", status.alias("status"))


@query("t31_page_count", "SELECT doc_id, CAST(len(regexp_extract_all(body, '(?m)^## PDF 第 [0-9]+ 页$')) AS BIGINT) AS pages FROM (SELECT doc_id, '## PDF 第 1 页' || chr(10) || coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '## PDF 第 2 页' ELSE '' END AS body FROM documents)")
def t31(spark, sf_dir):
    body = F.concat(F.lit("## PDF 第 1 页\n"), F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, "\n## PDF 第 2 页").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(body, F.lit(r"(?m)^## PDF 第 \d+ 页$")).cast("long").alias("pages"))


@query("t14_group_merge", "SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS kinds, count(DISTINCT CAST(floor(value / 1000) AS BIGINT)) > 1 AS conflict, count(*) AS parts FROM events GROUP BY 1")
def t14(spark, sf_dir):
    """Field groups of one identity: lists are united, two different scalars are a conflict."""
    kinds = F.array_join(F.sort_array(F.collect_set("event_type")), "|")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(kinds.alias("kinds"), (F.countDistinct(F.floor(F.col("value") / 1000)) > 1).alias("conflict"), F.count("*").alias("parts"))


@query("t27_missing_targets", "SELECT l_orderkey, l_suppkey FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)")
def t27(spark, sf_dir):
    """Relations of a page whose target is not a page."""
    links = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    pages = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return links.join(pages, "l_suppkey", "left_anti").select("l_orderkey", "l_suppkey")


@query("t29_priority", f"{DOCS} SELECT document_id, row_number() OVER (PARTITION BY lang ORDER BY coalesce(published_at, '') DESC, (source = 'src1') DESC, doc_id) AS place FROM docs QUALIFY place <= 5")
def t29(spark, sf_dir):
    """The five documents of each language to do next: newest, preferred source first, then by id."""
    order = Window.partitionBy("lang").orderBy(F.coalesce("published_at", F.lit("")).desc(), (F.col("source") == "src1").desc(), "doc_id")
    return documents(spark, sf_dir).select("document_id", F.row_number().over(order).cast("long").alias("place")).where("place <= 5")
