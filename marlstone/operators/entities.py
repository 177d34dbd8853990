"""Entities: registry of aliases, mentions, resolution that never guesses, pending names, review application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import registry
from ..views import table

QUERIES, SQL, query = registry()

REG = "WITH reg AS (SELECT 'entity:' || s_suppkey AS entity_id, lower(s_name) AS norm FROM supplier UNION ALL SELECT 'entity:n' || n_nationkey, lower(n_name) FROM nation UNION ALL SELECT 'entity:' || s_suppkey, 'group ' || s_nationkey FROM supplier), inv AS (SELECT norm, list_sort(list(DISTINCT entity_id)) AS ids FROM reg GROUP BY 1) "


def aliases(spark, sf_dir) -> DataFrame:
    """Normalised alias and the sorted ids that go by it."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    own = F.concat(F.lit("entity:"), "s_suppkey").alias("entity_id")
    names = s.select(own, F.lower("s_name").alias("norm")).union(n.select(F.concat(F.lit("entity:n"), "n_nationkey"), F.lower("n_name"))).union(s.select(own, F.concat(F.lit("group "), "s_nationkey")))
    return names.groupBy("norm").agg(F.sort_array(F.collect_set("entity_id")).alias("ids"))


def resolve(mentions: DataFrame, inverted: DataFrame) -> DataFrame:
    """status and entity of each mention: none known -> observed, one -> curated, several -> ambiguous and no entity."""
    joined = mentions.join(inverted, "norm", "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    observed = F.concat(F.lit("entity:observed:"), F.substring(F.sha2(F.concat(F.lit("company:"), "norm"), 256), 1, 24))
    return joined.select(*mentions.columns, F.when(n > 1, "ambiguous").when(n == 1, "curated").otherwise("observed").alias("status"), F.when(n == 1, F.col("ids")[0]).when(F.coalesce(n, F.lit(0)) < 1, observed).alias("entity_id"))


@query("e1_registry", REG + "SELECT norm, array_to_string(ids, ',') AS ids FROM inv")
def e1(spark, sf_dir):
    return aliases(spark, sf_dir).select("norm", F.array_join("ids", ",").alias("ids"))


MENTION = REG + ", mention AS (SELECT c_custkey AS document_id, CASE WHEN c_custkey % 3 = 0 THEN 'group ' || c_nationkey WHEN c_custkey % 3 = 1 THEN lower(c_name) ELSE (SELECT lower(n_name) FROM nation WHERE n_nationkey = c_nationkey) END AS norm FROM customer) "


def mentions(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 3
    return c.select(F.col("c_custkey").alias("document_id"), F.when(k == 0, F.concat(F.lit("group "), "c_nationkey")).when(k == 1, F.lower("c_name")).otherwise(F.lower("n_name")).alias("norm"))


@query("e3_resolve", MENTION + "SELECT document_id, norm, CASE WHEN len(ids) > 1 THEN 'ambiguous' WHEN len(ids) = 1 THEN 'curated' ELSE 'observed' END AS status, CASE WHEN len(ids) = 1 THEN ids[1] WHEN len(ids) > 1 THEN NULL ELSE 'entity:observed:' || substr(sha256('company:' || norm), 1, 24) END AS entity_id FROM mention LEFT JOIN inv USING (norm)")
def e3(spark, sf_dir):
    return resolve(mentions(spark, sf_dir), aliases(spark, sf_dir))


@query("a14_pending_names", MENTION + "SELECT norm, count(DISTINCT document_id) AS documents, min(document_id) AS example FROM mention LEFT JOIN inv USING (norm) WHERE ids IS NULL OR len(ids) > 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def a14(spark, sf_dir):
    open_ = resolve(mentions(spark, sf_dir), aliases(spark, sf_dir)).where("status <> 'curated'")
    return open_.groupBy("norm").agg(F.countDistinct("document_id").alias("documents"), F.min("document_id").alias("example")).orderBy(F.desc("documents"), "norm").limit(200)


@query("e5_review", MENTION + "SELECT document_id, CASE document_id % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'deferred' ELSE CASE WHEN len(ids) > 1 THEN 'ambiguous' WHEN len(ids) = 1 THEN 'curated' ELSE 'observed' END END AS status FROM mention LEFT JOIN inv USING (norm)")
def e5(spark, sf_dir):
    """The latest decision on a mention stands above its automatic status."""
    found = resolve(mentions(spark, sf_dir), aliases(spark, sf_dir))
    k = F.col("document_id") % 5
    log = found.select("document_id", F.explode(F.array(F.struct(F.lit(1).alias("id"), F.lit("confirmed").alias("action")), F.struct(F.lit(2).alias("id"), F.when(k == 0, "rejected").when(k == 1, "deferred").otherwise("revoked").alias("action")))).alias("r"))
    latest = log.groupBy("document_id").agg(F.max_by("r.action", "r.id").alias("action"))
    joined = found.join(latest, "document_id", "left")
    return joined.select("document_id", F.when(F.col("action") != "revoked", F.col("action")).otherwise(F.col("status")).alias("status"))


@query(
    "e7_security_key",
    """SELECT p_partkey, CASE WHEN k IN (7, 8, 9) THEN NULL WHEN k = 3 THEN 'CN' WHEN k = 4 THEN 'SH' WHEN k = 5 THEN 'TW' WHEN k = 6 THEN 'US' WHEN k = 2 THEN 'US' ELSE 'HK' END AS market,
      CASE k WHEN 0 THEN lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') WHEN 1 THEN lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') WHEN 2 THEN 'A' || p_partkey WHEN 3 THEN lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0')
        WHEN 4 THEN lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0') WHEN 5 THEN lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') WHEN 6 THEN 'B' || p_partkey END AS code, CASE k WHEN 2 THEN 'Nasdaq' END AS exchange
    FROM (SELECT p_partkey, p_partkey % 10 AS k FROM part)""",
)
def e7(spark, sf_dir):
    """Codes with a market before or behind, of all markets and forms, and such as are none: wrong lengths, an unknown market."""
    n, k = F.col("p_partkey"), F.col("p_partkey") % 10
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    six, four = F.lpad((n % 1_000_000).cast("string"), 6, "0"), F.lpad((n % 10_000).cast("string"), 4, "0")
    raw = F.when(k == 0, say("hk:", (n % 100_000).cast("string"))).when(k == 1, say((n % 100_000).cast("string"), " HK")).when(k == 2, say("a", n, " OQ")).when(k == 3, say(six, ".CH")).when(k == 4, say(six, "-ss"))
    raw = raw.when(k == 5, say(" ", four, "  TT ")).when(k == 6, say("US:b", n)).when(k == 7, say("SH:", four)).when(k == 8, say(six, " HK")).otherwise(say(six, " ZZ"))
    return table(spark, sf_dir, "part").select("p_partkey", security_key(raw).alias("s")).select("p_partkey", "s.market", "s.code", "s.exchange")


def security_key(raw: Column) -> Column:
    """(market, code, exchange) of a code with a market before or after it; null where form or length is wrong.

    The name is trimmed, its white space collapsed and upper-cased; wide forms are not folded (no NFKC in SQL)."""
    name = F.upper(F.regexp_replace(F.trim(F.regexp_replace(raw, r"\s+", " ")), "^ | $", ""))

    def key(market, code, exchange=None):
        exchange = F.lit(None).cast("string") if exchange is None else exchange
        return F.struct(market.alias("market"), F.when(market == "HK", F.lpad(code, 5, "0")).otherwise(code).alias("code"), exchange.alias("exchange"))

    before, after, us = r"^(US|HK|SH|SZ|TW):([A-Z0-9.\-]+)$", r"^([0-9]{1,6})(?:[.\s\-]+)?(HK|SH|SS|SZ|TW|TT|CH)$", r"^([A-Z][A-Z0-9.\-]{0,12})[.\s\-]+(US|O|OQ|N)$"
    market, code = F.regexp_extract(name, before, 1), F.regexp_extract(name, before, 2)
    sound = F.when(market == "US", code.rlike("^[A-Z][A-Z0-9.\\-]{0,12}$")).when(market == "HK", code.rlike("^[0-9]{1,5}$")).when(market == "TW", code.rlike("^[0-9]{4}$")).otherwise(code.rlike("^[0-9]{6}$"))
    digits, end = F.regexp_extract(name, after, 1), F.regexp_extract(name, after, 2)
    place = F.when(end == "SS", "SH").when(end == "TT", "TW").when(end == "CH", "CN").otherwise(end)
    n = F.length(digits)
    fits = ((place == "HK") & (n <= 5)) | (place.isin("SH", "SZ", "CN") & (n == 6)) | ((place == "TW") & (n == 4))
    suffix = F.regexp_extract(name, us, 2)
    exchange = F.when(suffix.isin("O", "OQ"), "Nasdaq").when(suffix == "N", "NYSE")
    found = F.when(name.rlike(before), F.when(sound, key(market, code))).when(name.rlike(after), F.when(fits, key(place, digits)))
    return found.when(name.rlike(us), key(F.lit("US"), F.regexp_extract(name, us, 1), exchange))
