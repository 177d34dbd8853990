"""The entity pipeline: mentions from metadata, resolution (by name, by name and code, in context), reconciliation against
a master list, reviews, business relations. An identity is never guessed: what several entities share stays ambiguous."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BLOCKS, ENTITIES, MODEL, PAGES, PREFIXES, blocks, entities, normal, pages
from ..registry import registry
from ..views import table
from .entities import security_key
from .patterns import found_in
from .windows import first_per

QUERIES, SQL, query = registry()

#: Fields of metadata that name entities, and their types. Fixed values.
FIELDS = {"companies": "company", "industries": "industry", "subfields": "subfield", "tickers": "security"}
_PAIR = r"^(.+?)\s*\(([^()]+)\)$"


def mentions(docs: DataFrame) -> DataFrame:
    """document_id, type, norm, name, field, raw: from the entity fields, and from tags with a known prefix; each once."""
    arms = [docs.select("document_id", F.lit(kind).alias("type"), F.explode(field).alias("name"), F.lit(field).alias("field")).withColumn("raw", F.col("name")) for field, kind in FIELDS.items() if field in docs.columns]
    tags = docs.select("document_id", F.explode("tags").alias("raw")).withColumn("tag", F.translate("raw", "：", ":"))
    kinds = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    kind = F.element_at(kinds, F.trim(F.split_part("tag", F.lit(":"), F.lit(1))))
    tags = tags.where(F.contains("tag", F.lit(":"))).select("document_id", kind.alias("type"), F.expr("substring(tag, instr(tag, ':') + 1)").alias("name"), F.lit("tags").alias("field"), "raw")
    out = arms[0]
    for arm in [*arms[1:], tags.where("type is not null")]:
        out = out.unionByName(arm)
    named = out.where(F.trim("name") != "").select("document_id", "type", normal(F.col("name")).alias("norm"), F.trim("name").alias("name"), "field", "raw")
    return named.dropDuplicates(["document_id", "type", "norm", "field", "raw"])


def aliases(registry_: DataFrame) -> DataFrame:
    """type, norm, ids: the sorted ids that go by each normalised name or alias."""
    names = registry_.select("entity_id", "type", F.explode(F.concat(F.array("name"), "aliases")).alias("alias"))
    return names.groupBy("type", normal(F.col("alias")).alias("norm")).agg(F.sort_array(F.collect_set("entity_id")).alias("ids"))


def observed(kind: Column, norm: Column) -> Column:
    """The id of a name that no registry knows."""
    return F.concat(F.lit("entity:observed:"), F.substring(F.sha2(F.concat(kind, F.lit(":"), norm), 256), 1, 24))


def answers(asked: DataFrame, registry_: DataFrame) -> DataFrame:
    """type, norm, status, entity_id of each name asked (type, norm, each once). One id: curated; several: ambiguous and no entity;
    none: a company written "name (code)" is the issuer that both the name and the security's code lead to, if there is one; else
    observed. Of the ids that go by a name only their number and the smallest are kept: a shared alias may have thousands."""
    known = registry_.select("entity_id", "issuer_id", "type", F.explode(F.concat(F.array("name"), "aliases")).alias("alias")).select("entity_id", "issuer_id", "type", normal(F.col("alias")).alias("norm"))
    single = known.groupBy("type", "norm").agg(F.min("entity_id").alias("one"), (F.min("entity_id") < F.max("entity_id")).alias("several"))
    pairs = asked.where("type = 'company'").where(F.col("norm").rlike(_PAIR)).select("norm", F.trim(F.regexp_extract("norm", _PAIR, 1)).alias("base"), F.trim(F.regexp_extract("norm", _PAIR, 2)).alias("code"))
    issuers = known.where("type = 'security'").select(F.col("norm").alias("code"), "issuer_id").distinct()
    names = known.where("type = 'company'").select(F.col("norm").alias("base"), F.col("entity_id").alias("issuer_id")).distinct()
    agreed = pairs.join(issuers, "code").join(names, ["base", "issuer_id"]).groupBy("norm").agg(F.min("issuer_id").alias("pair"), F.max("issuer_id").alias("_last")).where("pair = _last")
    joined = asked.join(single, ["type", "norm"], "left").join(agreed.select(F.lit("company").alias("type"), "norm", "pair"), ["type", "norm"], "left")
    status = F.when(F.col("several"), "ambiguous").when(F.coalesce("one", "pair").isNotNull(), "curated").otherwise("observed")
    entity = F.when(F.col("several"), F.lit(None).cast("string")).otherwise(F.coalesce("one", "pair", observed(F.col("type"), F.col("norm"))))
    return joined.select("type", "norm", status.alias("status"), entity.alias("entity_id"))


def resolved(found: DataFrame, registry_: DataFrame) -> DataFrame:
    """found with status and entity_id. Each distinct name is resolved once and its answer, two short columns, joined to its mentions."""
    asked = found.select("type", "norm").distinct()
    return found.join(answers(asked, registry_), ["type", "norm"], "left")


def _resolved(spark, sf_dir) -> DataFrame:
    return resolved(mentions(pages(spark, sf_dir)), entities(spark, sf_dir))


@query("e2_mentions", MODEL + "SELECT * FROM mentions_")
def e2(spark, sf_dir):
    return mentions(pages(spark, sf_dir))


@query("e3_name_and_code", MODEL + "SELECT document_id, type, norm, field, raw, status, entity_id FROM resolved_")
def e3(spark, sf_dir):
    return _resolved(spark, sf_dir).select("document_id", "type", "norm", "field", "raw", "status", "entity_id")


@query("e1_market_aliases", MODEL + "SELECT type, norm, array_to_string(ids, ',') AS ids, len(ids) > 1 AS ambiguous FROM alias_")
def e1(spark, sf_dir):
    found = aliases(entities(spark, sf_dir))
    return found.select("type", "norm", F.array_join("ids", ",").alias("ids"), (F.size("ids") > 1).alias("ambiguous"))


def checked(registry_: DataFrame) -> DataFrame:
    """entity_id and problem of every entry of a registry that may not be used."""
    company = registry_.where("type = 'company'").select(F.col("entity_id").alias("issuer_id"), F.col("name").alias("_known"))
    twice = registry_.groupBy("entity_id").agg(F.count("*").alias("_n"))
    rows = registry_.join(company.distinct(), "issuer_id", "left").join(twice, "entity_id")
    problem = (
        F.when(~F.coalesce(F.col("entity_id").rlike("^entity:[a-z0-9:_-]{1,160}$"), F.lit(False)) | F.startswith("entity_id", F.lit("entity:observed:")), "bad_id")
        .when(~F.col("type").isin(*sorted(set(PREFIXES.values()))), "bad_type")
        .when(F.coalesce(F.trim("name"), F.lit("")) == "", "no_name")
        .when(F.exists("aliases", lambda a: F.coalesce(F.trim(a), F.lit("")) == ""), "empty_alias")
        .when(F.col("_n") > 1, "duplicate_id")
        .when((F.col("type") == "security") & (F.col("market").isNull() | F.col("code").isNull()), "no_market_or_code")
        .when(F.col("issuer_id").isNotNull() & F.col("_known").isNull(), "issuer_unknown")
    )
    return rows.select("entity_id", problem.alias("problem")).where("problem is not null").distinct()


@query(
    "e1_registry_problems",
    f"""WITH {ENTITIES}, bad AS (SELECT CASE WHEN s % 6 = 0 THEN 'Entity:' || s WHEN s % 6 = 1 THEN 'entity:x:1' ELSE entity_id END AS entity_id, CASE WHEN s % 6 = 2 THEN 'thing' ELSE type END AS type,
      CASE WHEN s % 6 = 3 THEN ' ' ELSE name END AS name, CASE WHEN s % 6 = 4 THEN CAST(NULL AS VARCHAR) ELSE market END AS market, code, CASE WHEN s % 6 = 5 THEN 'entity:company:none' ELSE issuer_id END AS issuer_id
      FROM (SELECT *, CAST(split_part(entity_id, ':', 3) AS INTEGER) AS s FROM entities_ WHERE type = 'security'))
    SELECT DISTINCT entity_id, CASE WHEN NOT regexp_matches(entity_id, '^entity:[a-z0-9:_-]+$') THEN 'bad_id' WHEN type = 'thing' THEN 'bad_type' WHEN trim(name) = '' THEN 'no_name'
      WHEN entity_id = 'entity:x:1' THEN 'duplicate_id' WHEN market IS NULL THEN 'no_market_or_code' WHEN issuer_id = 'entity:company:none' THEN 'issuer_unknown' END AS problem
    FROM bad WHERE problem IS NOT NULL""",
)
def e1_problems(spark, sf_dir):
    s = F.split_part("entity_id", F.lit(":"), F.lit(3)).cast("int")
    known = entities(spark, sf_dir)
    bad = known.where("type = 'security'").withColumn("s", s).select(
        F.when(F.col("s") % 6 == 0, F.concat(F.lit("Entity:"), "s")).when(F.col("s") % 6 == 1, "entity:x:1").otherwise(F.col("entity_id")).alias("entity_id"),
        F.when(F.col("s") % 6 == 2, "thing").otherwise(F.col("type")).alias("type"),
        F.when(F.col("s") % 6 == 3, " ").otherwise(F.col("name")).alias("name"),
        "aliases",
        F.when(F.col("s") % 6 != 4, F.col("market")).alias("market"),
        "code",
        F.when(F.col("s") % 6 == 5, "entity:company:none").otherwise(F.col("issuer_id")).alias("issuer_id"),
    )
    return checked(known.where("type = 'company'").unionByName(bad))


def in_context(found: DataFrame, rules: DataFrame, context: DataFrame, most_blocks: int = 128, most_chars: int = 262_144) -> DataFrame:
    """Mentions (document_id, type, norm, status, entity_id) that are not curated, in the light of rules (type, alias, entity_id,
    definition): curated where the document's blocks (document_id, text) define exactly one meaning, "full (alias)" or "alias
    (full)", and name no other. A document beyond the budget decides nothing. Adds context_status (null without a rule)."""
    size = context.groupBy("document_id").agg(F.count("*").alias("_b"), F.sum(F.char_length("text")).alias("_c"))
    complete = size.where((F.col("_b") <= most_blocks) & (F.col("_c") <= most_chars)).select("document_id", F.lit(True).alias("complete"))
    ruled = rules.select("type", normal(F.col("alias")).alias("norm"), F.col("entity_id").alias("meaning"), normal(F.col("definition")).alias("full"))
    open_ = found.where("status <> 'curated'").join(F.broadcast(ruled), ["type", "norm"])  # rules are written by hand
    quoted = lambda c: F.concat(F.lit("\\Q"), F.col(c), F.lit("\\E"))
    pattern = F.concat(quoted("full"), F.lit("\\s*\\(\\s*"), quoted("norm"), F.lit("s?\\s*\\)|(?<![a-z0-9])"), quoted("norm"), F.lit("\\s*\\(\\s*"), quoted("full"), F.lit("\\s*\\)"))
    read = context.join(complete, "document_id", "left_semi").select("document_id", normal(F.col("text")).alias("body")).withColumn("_at", F.xxhash64("body")).dropDuplicates(["document_id", "_at"])
    # One pass over each text finds the definitions that stand in it; the pattern is tried on these only.
    spots = found_in(read, ruled, ["document_id", "_at"], "body", "full").withColumnRenamed("pattern", "full")
    hits = open_.join(spots, ["document_id", "full"]).join(read, ["document_id", "_at"]).withColumn("defined", F.rlike(F.col("body"), pattern))
    keys = ["document_id", "type", "norm"]
    told = hits.groupBy(*keys).agg(F.countDistinct("meaning").alias("_possible"), F.countDistinct(F.when(F.col("defined"), F.col("meaning"))).alias("_matched"), F.min(F.when(F.col("defined"), F.col("meaning"))).alias("_meaning"))
    asked = open_.select(*keys).distinct().join(complete, "document_id", "left").join(told, keys, "left")
    sure = F.coalesce((F.col("_matched") == 1) & (F.col("_possible") == 1), F.lit(False))
    status = F.when(F.col("complete").isNull(), "context_budget_exceeded").when(sure, "document_definition").when(F.col("_possible") > 1, "multiple_meanings").otherwise("definition_not_found")
    asked = asked.select(*keys, status.alias("context_status"), F.when(sure, F.col("_meaning")).alias("_meaning"))
    joined = found.join(asked, keys, "left")
    mended = F.col("_meaning").isNotNull() & (F.col("status") != "curated")
    entity = F.when(mended, F.col("_meaning")).otherwise(F.col("entity_id"))
    return joined.withColumn("entity_id", entity).withColumn("status", F.when(mended, "curated").otherwise(F.col("status"))).drop("_meaning")


_K = "CAST(regexp_extract(norm, '([0-9]+)$', 1) AS INTEGER)"


@query(
    "e4_context",
    MODEL
    + f"""SELECT document_id, norm, CASE WHEN n % 5 = 4 THEN 'context_budget_exceeded' WHEN n % 5 IN (0, 1) THEN 'document_definition' WHEN n % 5 = 3 THEN 'multiple_meanings' ELSE 'definition_not_found' END AS context_status,
      CASE WHEN n % 5 IN (0, 1) THEN 'curated' ELSE status END AS status, CASE WHEN n % 5 IN (0, 1) THEN 'entity:company:' || ({_K} + 1) ELSE entity_id END AS entity_id
    FROM (SELECT *, CAST(substr(document_id, 5) AS BIGINT) AS n FROM resolved_ WHERE starts_with(norm, 'unknown co'))""",
)
def e4(spark, sf_dir):
    """Names that only their documents define."""
    found = _resolved(spark, sf_dir).where(F.startswith("norm", F.lit("unknown co")))
    k = F.explode(F.sequence(F.lit(0), F.lit(8)))
    rules = spark.range(1).select(k.alias("k")).select(
        F.lit("company").alias("type"),
        F.concat(F.lit("Unknown Co "), "k").alias("alias"),
        F.explode(F.array(F.struct(F.concat(F.lit("entity:company:"), F.col("k") + 1).alias("e"), F.concat(F.lit("Long Name "), "k").alias("d")), F.struct(F.concat(F.lit("entity:company:"), F.col("k") + 2).alias("e"), F.concat(F.lit("Other  Name "), "k").alias("d")))).alias("x"),
    ).select("type", "alias", F.col("x.e").alias("entity_id"), F.col("x.d").alias("definition"))
    n, j = F.col("doc_id"), F.col("doc_id") % 9
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    body = F.when(n % 5 == 0, say("Shares of Long  Name ", j, " ( Unknown Co ", j, "s ) rose")).when(n % 5 == 1, say("Then Unknown Co ", j, "(Long Name ", j, ") fell"))
    body = body.when(n % 5 == 2, say("Long Name ", j, " alone")).when(n % 5 == 3, say("Long Name ", j, " (Unknown Co ", j, ") and Other Name ", j)).otherwise(F.repeat(F.lit("x"), 262_200))
    context = pages(spark, sf_dir).where(n % 6 == 2).select("document_id", body.alias("text"))
    return in_context(found, rules, context).select("document_id", "norm", "context_status", "status", "entity_id")


def reviewed(found: DataFrame, reviews: DataFrame, registry_: DataFrame) -> DataFrame:
    """found after the latest review (document_id, type, norm, review_id, action, entity_ids) of each mention. confirm and split
    put the review's entities in place (a row for each, if all are known and of the type); reject takes its entities out; defer
    and revoke leave the automatic answer."""
    keys = ["document_id", "type", "norm"]
    latest = reviews.groupBy(*keys).agg(F.max_by(F.struct("action", "entity_ids"), "review_id").alias("_r"))
    known = registry_.select(F.col("entity_id").alias("_e"), F.col("type").alias("_t"))
    named = latest.where(F.col("_r.action").isin("confirm", "split")).select(*keys, F.explode("_r.entity_ids").alias("_e"), F.size("_r.entity_ids").alias("_n"))
    good = named.join(known, "_e").where("_t = type").groupBy(*keys).agg(F.count("*").alias("_good"), F.first("_n").alias("_n")).where("_good = _n").select(*keys, F.lit(True).alias("_usable"))
    joined = found.join(latest, keys, "left").join(good, keys, "left")
    action = F.col("_r.action")
    placed = action.isin("confirm", "split") & F.coalesce("_usable", F.lit(False))
    out = F.when(F.coalesce(placed, F.lit(False)), F.col("_r.entity_ids")).otherwise(F.array("entity_id"))
    rejected = F.coalesce((action == "reject") & F.array_contains("_r.entity_ids", F.col("entity_id")), F.lit(False))
    status = F.when(F.coalesce(placed, F.lit(False)), "curated").when(rejected, "ambiguous").otherwise(F.col("status"))
    note = F.when(action.isin("confirm", "split") & ~F.coalesce("_usable", F.lit(False)), "review_target_unavailable").when(action.isin("defer", "reject"), action)
    rows = joined.withColumn("status", status).withColumn("review_note", note).withColumn("_out", F.when(rejected, F.array(F.lit(None).cast("string"))).otherwise(out))
    return rows.withColumn("entity_id", F.explode("_out")).drop("_out", "_r", "_usable")


@query(
    "e5_review_actions",
    MODEL
    + """SELECT document_id, norm, status, review_note, unnest(out) AS entity_id FROM (SELECT document_id, norm,
      CASE WHEN a = 1 THEN 'curated' WHEN a = 2 THEN 'curated' WHEN a = 4 AND entity_id IS NOT NULL THEN 'ambiguous' ELSE status END AS status,
      CASE WHEN a = 3 THEN 'review_target_unavailable' WHEN a = 4 THEN 'reject' WHEN a = 5 THEN 'defer' END AS review_note,
      CASE WHEN a = 1 THEN ['entity:company:1'] WHEN a = 2 THEN ['entity:company:1', 'entity:company:2'] WHEN a = 4 AND entity_id IS NOT NULL THEN [CAST(NULL AS VARCHAR)] ELSE [entity_id] END AS out
    FROM (SELECT *, CAST(substr(document_id, 5) AS BIGINT) % 7 AS a FROM resolved_ WHERE type = 'company' AND field = 'companies'))""",
)
def e5(spark, sf_dir):
    """Decisions: confirm, split, a target that is not there, reject, defer, and a confirm that was revoked."""
    found = _resolved(spark, sf_dir).where("type = 'company' and field = 'companies'")
    a = F.substring("document_id", 5, 20).cast("long") % 7
    one, two = F.array(F.lit("entity:company:1")), F.array(F.lit("entity:company:1"), F.lit("entity:company:2"))
    decision = lambda i, action, ids: F.struct(F.lit(i).alias("review_id"), F.lit(action).alias("action"), ids.alias("entity_ids"))
    own = F.when(F.col("entity_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("entity_id"))
    last = F.when(a == 1, decision(2, "confirm", one)).when(a == 2, decision(2, "split", two)).when(a == 3, decision(2, "confirm", F.array(F.lit("entity:topic:0")))).when(a == 4, decision(2, "reject", own)).when(a == 5, decision(2, "defer", one)).when(a == 6, decision(2, "revoke", one))
    log = found.select("document_id", "type", "norm", F.explode(F.array_compact(F.array(decision(1, "confirm", two), last))).alias("r"), a.alias("a")).where("a > 0").select("document_id", "type", "norm", "r.*")
    return reviewed(found, log, entities(spark, sf_dir)).select("document_id", "norm", "status", "review_note", "entity_id")


def find(q: str, registry_: DataFrame, counts: DataFrame, rules: DataFrame, kind: str | None = None) -> DataFrame:
    """Entities whose name or alias (or context rule: type, alias, entity_id) is q; only if there is none, those that hold q.
    counts (entity_id, documents) tells how many documents have each; an entity counts if it is in the registry."""
    q = " ".join(q.split()).lower()
    names = registry_.select("entity_id", normal(F.col("name")).alias("norm"), F.lit(False).alias("ruled"))
    names = names.union(registry_.select("entity_id", F.explode("aliases").alias("a")).select("entity_id", normal(F.col("a")), F.lit(False)))
    names = names.union(rules.select("entity_id", normal(F.col("alias")), F.lit(True)))
    names = names.where(F.contains("norm", F.lit(q))).withColumn("exact", F.col("norm") == q)
    per = names.groupBy("entity_id").agg(F.max("exact").alias("exact"), F.max(F.col("exact") & ~F.col("ruled")).alias("plain"))
    any_exact = per.agg(F.coalesce(F.max("exact"), F.lit(False)).alias("_any"))
    hit = per.join(F.broadcast(any_exact)).where((F.col("exact")) | ~F.col("_any")).drop("_any")
    known = registry_ if kind is None else registry_.where(F.col("type") == kind)
    joined = hit.join(known, "entity_id").join(counts, "entity_id", "left")
    context = F.col("exact") & ~F.col("plain")
    return joined.select("entity_id", "type", "name", (F.col("exact") & ~context).alias("exact"), context.alias("requires_context"), F.coalesce("documents", F.lit(0)).alias("document_count")).orderBy(F.desc("exact"), F.desc("document_count"), "entity_id")


def _counts(spark, sf_dir) -> DataFrame:
    live = pages(spark, sf_dir).where("not deleted").select("document_id")
    return _resolved(spark, sf_dir).join(live, "document_id", "left_semi").where("entity_id is not null").groupBy("entity_id").agg(F.countDistinct("document_id").alias("documents"))


_COUNTS = "counts_ AS (SELECT entity_id, count(DISTINCT document_id) AS documents FROM resolved_ SEMI JOIN (SELECT document_id FROM pages_ WHERE NOT deleted) USING (document_id) WHERE entity_id IS NOT NULL GROUP BY 1)"


@query("e6_exact", f"{MODEL}, {_COUNTS} SELECT e.entity_id, type, name, list_contains(aliases, 'Acme 3') AS exact, false AS requires_context, coalesce(documents, 0) AS document_count FROM entities_ e LEFT JOIN counts_ USING (entity_id) WHERE list_contains(aliases, 'Acme 3')")
def e6_exact(spark, sf_dir):
    """An alias that several companies share: all are named, none is picked."""
    none = spark.createDataFrame([], "type string, alias string, entity_id string")
    return find("ACME  3", entities(spark, sf_dir), _counts(spark, sf_dir), none)


@query("e6_partial", f"{MODEL}, {_COUNTS} SELECT e.entity_id, type, name, false AS exact, false AS requires_context, coalesce(documents, 0) AS document_count FROM entities_ e LEFT JOIN counts_ USING (entity_id) WHERE type = 'company' AND contains(lower(name), 'plier#00000000')")
def e6_partial(spark, sf_dir):
    none = spark.createDataFrame([], "type string, alias string, entity_id string")
    return find("plier#00000000", entities(spark, sf_dir), _counts(spark, sf_dir), none, "company")


@query("e6_context", f"{MODEL}, {_COUNTS} SELECT e.entity_id, type, name, false AS exact, true AS requires_context, coalesce(documents, 0) AS document_count FROM entities_ e LEFT JOIN counts_ USING (entity_id) WHERE entity_id IN ('entity:company:1', 'entity:company:2')")
def e6_context(spark, sf_dir):
    """A name that only context rules know needs its context."""
    rules = spark.createDataFrame([("company", "ADC", "entity:company:1"), ("company", "adc", "entity:company:2")], "type string, alias string, entity_id string")
    return find("adc", entities(spark, sf_dir), _counts(spark, sf_dir), rules)


#: Endings of company names that alone do not tell companies apart.
ENDINGS = ("incorporated", "corporation", "companylimited", "company", "colimited", "coltd", "limited", "corp", "inc", "ltd", "plc")


def format_key(name: Column) -> Column:
    """A company's name without white space and stops: spellings of one name."""
    return F.regexp_replace(normal(name), r"[.,，。\s]", "")


def legal_stem(name: Column) -> Column:
    """Without endings like Inc or Ltd: only ever a candidate."""
    return F.regexp_replace(format_key(name), f"(?:{'|'.join(ENDINGS)})+$", "")


def reconcile(names: DataFrame, master: DataFrame, reviewed_names: DataFrame) -> DataFrame:
    """names (type, norm) with action, reason and candidates against master (entity_id, type, name, aliases, market, code, issuer_id).

    In order: the very name; a security's market and code; another spelling of a company's name; a company with its code in brackets,
    where both must lead to one issuer. One candidate is mapped, several are for review; an acronym of up to three letters
    needs a review (reviewed_names: type, norm). Without a candidate, stems without legal endings are proposed.
    """
    known = master.select("entity_id", "type", F.explode(F.concat(F.array("name"), "aliases")).alias("alias"))
    exact = known.groupBy("type", normal(F.col("alias")).alias("norm")).agg(F.sort_array(F.collect_set("entity_id")).alias("exact"))
    company = known.where("type = 'company'")
    formatted = company.groupBy(format_key(F.col("alias")).alias("fkey")).agg(F.sort_array(F.collect_set("entity_id")).alias("formatted"))
    weak = company.groupBy(legal_stem(F.col("alias")).alias("stem")).agg(F.sort_array(F.collect_set("entity_id")).alias("weak"))
    coded = master.where("type = 'security'").groupBy("market", "code").agg(F.sort_array(F.collect_set("entity_id")).alias("coded"), F.sort_array(F.collect_set("issuer_id")).alias("issuers"))
    empty = F.array().cast("array<string>")
    pair = F.col("norm").rlike(_PAIR) & (F.col("type") == "company")
    base, code = F.regexp_extract("norm", _PAIR, 1), F.regexp_extract("norm", _PAIR, 2)
    key = security_key(F.when(pair, code).otherwise(F.col("norm")))
    rows = names.withColumn("pair", pair).withColumn("k", key)
    rows = rows.withColumn("market", F.col("k.market")).withColumn("code", F.col("k.code")).withColumn("fkey", format_key(F.col("norm"))).withColumn("stem", legal_stem(F.col("norm")))
    rows = rows.withColumn("bfkey", F.when(pair, format_key(base))).withColumn("bstem", F.when(pair, legal_stem(base)))
    joined = (
        rows.join(exact, ["type", "norm"], "left")
        .join(coded, ["market", "code"], "left")
        .join(formatted, "fkey", "left")
        .join(weak, "stem", "left")
        .join(formatted.select(F.col("fkey").alias("bfkey"), F.col("formatted").alias("bformatted")), "bfkey", "left")
        .join(weak.select(F.col("stem").alias("bstem"), F.col("weak").alias("bweak")), "bstem", "left")
    )
    c = lambda x: F.coalesce(x, empty)
    based = F.when(F.size(c("bformatted")) > 0, F.col("bformatted")).otherwise(c("bweak"))
    both = F.array_intersect(based, c("issuers"))
    one = lambda why, ids: F.struct(F.lit(why).alias("reason"), ids.alias("ids"))
    is_company, is_security = F.col("type") == "company", F.col("type") == "security"
    found = (
        F.when(F.size(c("exact")) > 0, one("exact_official_or_reviewed_name", c("exact")))
        .when(is_security & (F.size(c("coded")) > 0), one("explicit_market_and_official_code", c("coded")))
        .when(is_company & (F.size(c("formatted")) > 0), one("typographic_variant", c("formatted")))
        .when(F.col("pair") & (F.size(both) > 0), one("issuer_name_and_market_code_agree", both))
        .when(F.col("pair") & (F.size(F.array_union(based, c("issuers"))) > 0), one("name_code_not_confirmed", F.array_sort(F.array_union(based, c("issuers")))))
    )
    marked = joined.withColumn("f", found).join(reviewed_names.select("type", "norm", F.lit(True).alias("seen")).distinct(), ["type", "norm"], "left")
    short = is_company & F.col("norm").rlike("^[a-z]{1,3}$") & F.col("seen").isNull()
    n, why = F.size(F.coalesce("f.ids", empty)), F.col("f.reason")
    mapped = (n == 1) & (why != "name_code_not_confirmed") & ~short
    reason = (
        F.when(why == "name_code_not_confirmed", why)
        .when((n == 1) & short, "short_acronym_requires_context")
        .when(n == 1, why)
        .when(n > 1, "multiple_identities")
        .when(is_company & (F.size(c("weak")) > 0), "possible_legal_suffix_variant")
        .when(is_security & F.col("k").isNull(), "market_missing_or_unsupported")
        .when(F.col("norm").rlike("[\\x{FFFD}\\x00-\\x1f]"), "damaged_text")
        .when(F.col("norm").rlike("[;/、]"), "compound_or_qualified_name")
        .otherwise("no_candidate")
    )
    candidates = F.when(n > 0, F.col("f.ids")).when(is_company, F.slice(c("weak"), 1, 10)).otherwise(empty)
    return marked.select("type", "norm", F.when(F.coalesce(mapped, F.lit(False)), "mapped").otherwise("review").alias("action"), reason.alias("reason"), candidates.alias("candidates"))


@query(
    "e8_reconcile",
    f"""WITH {ENTITIES}, asked AS (SELECT s_suppkey AS s, s_suppkey % 10 AS k, s_name AS name, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS code FROM supplier)
    SELECT CASE WHEN k IN (1, 6) THEN 'security' ELSE 'company' END AS type,
      CASE k WHEN 0 THEN lower(name) WHEN 1 THEN s || ' hk' WHEN 2 THEN lower('Supplier #' || substr(name, 10)) || '.' WHEN 3 THEN lower(name) || ' inc (hk:' || code || ')' WHEN 4 THEN lower(name) || ' (hk:99999)'
        WHEN 5 THEN lower(name) || ' co., ltd.' WHEN 6 THEN s || ' zz' WHEN 7 THEN 'acme ' || (s % 20) WHEN 8 THEN 'no ' || s || '; such' ELSE 'none ' || s END AS norm,
      CASE WHEN k IN (0, 1, 2, 3) THEN 'mapped' ELSE 'review' END AS action,
      CASE k WHEN 0 THEN 'exact_official_or_reviewed_name' WHEN 1 THEN 'explicit_market_and_official_code' WHEN 2 THEN 'typographic_variant' WHEN 3 THEN 'issuer_name_and_market_code_agree' WHEN 4 THEN 'name_code_not_confirmed'
        WHEN 5 THEN 'possible_legal_suffix_variant' WHEN 6 THEN 'market_missing_or_unsupported' WHEN 7 THEN 'multiple_identities' WHEN 8 THEN 'compound_or_qualified_name' ELSE 'no_candidate' END AS reason
    FROM asked WHERE k <> 7 OR (SELECT count(*) FROM supplier x WHERE x.s_suppkey % 20 = s % 20) > 1""",
)
def e8(spark, sf_dir):
    """Names of every kind against the registry."""
    master = entities(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), (F.col("s_suppkey") % 10).alias("k"), F.lower("s_name").alias("name"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("code"))
    k, say = F.col("k"), lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    norm = F.when(k == 0, F.col("name")).when(k == 1, say(F.col("s"), " hk")).when(k == 2, say("supplier #", F.substring("name", 10, 20), ".")).when(k == 3, say(F.col("name"), " inc (hk:", F.col("code"), ")"))
    norm = norm.when(k == 4, say(F.col("name"), " (hk:99999)")).when(k == 5, say(F.col("name"), " co., ltd.")).when(k == 6, say(F.col("s"), " zz")).when(k == 7, say("acme ", F.col("s") % 20)).when(k == 8, say("no ", F.col("s"), "; such")).otherwise(say("none ", F.col("s")))
    shared = s.groupBy((F.col("s") % 20).alias("m")).agg(F.count("*").alias("n")).where("n > 1")
    asked = s.join(shared, F.col("s") % 20 == F.col("m"), "left").where("k <> 7 or n is not null").select(F.when(k.isin(1, 6), "security").otherwise("company").alias("type"), norm.alias("norm"))
    found = reconcile(asked, master, spark.createDataFrame([], "type string, norm string"))
    return found.select("type", "norm", "action", "reason")


def queue(found: DataFrame, reviews: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Mentions to review: not curated, one of each (type, norm, document), with the latest review's action; a page of them."""
    latest = reviews.groupBy("document_id", "type", "norm").agg(F.max_by("action", "review_id").alias("action"))
    open_ = first_per(found.where("status <> 'curated'"), ["type", "norm", "document_id"], ["field", "raw"])
    return open_.join(latest, ["document_id", "type", "norm"], "left").orderBy("type", "norm", "document_id").offset(offset).limit(limit + 1)


def _log(spark, sf_dir, found: DataFrame) -> DataFrame:
    """Two reviews of every third document's mentions."""
    n = F.substring("document_id", 5, 20).cast("long")
    twice = F.explode(F.array(F.struct(F.lit(1).alias("id"), F.lit("defer").alias("action")), F.struct(F.lit(2).alias("id"), F.lit("reject").alias("action"))))
    return found.where(n % 3 == 0).select("document_id", "type", "norm", twice.alias("r")).distinct().select("document_id", "type", "norm", F.col("r.id").alias("review_id"), F.col("r.action").alias("action"))


@query("e9_queue", MODEL + "SELECT type, norm, document_id, CASE WHEN CAST(substr(document_id, 5) AS BIGINT) % 3 = 0 THEN 'reject' END AS action FROM (SELECT DISTINCT type, norm, document_id FROM resolved_ WHERE status <> 'curated') ORDER BY type, norm, document_id LIMIT 51 OFFSET 10")
def e9_queue(spark, sf_dir):
    found = _resolved(spark, sf_dir)
    return queue(found, _log(spark, sf_dir, found), offset=10).select("type", "norm", "document_id", "action")


def saved(asked: DataFrame, reviews: DataFrame, current: DataFrame, context: DataFrame, registry_: DataFrame) -> DataFrame:
    """What becomes of reviews to save (document_id, revision_id, type, norm, action, entity_ids, quote, expected_review_id): ok; stale,
    if the revision is not the current one (current: document_id, revision_id) or another review came first; or without evidence
    (the quote must stand in a block of that revision) or a known entity, where the action needs them."""
    keys = ["document_id", "type", "norm"]
    latest = reviews.groupBy(*keys).agg(F.max("review_id").alias("_last"))
    rows = asked.join(current.select("document_id", F.col("revision_id").alias("_now")), "document_id", "left").join(latest, keys, "left")
    proof = rows.join(context.select("document_id", "revision_id", "text"), ["document_id", "revision_id"]).where(F.contains("text", F.col("quote"))).select(*keys).distinct().withColumn("_proof", F.lit(True))
    named = rows.select(*keys, F.explode("entity_ids").alias("entity_id")).join(registry_.select("entity_id", F.col("type").alias("_t")), "entity_id", "left")
    unknown = named.where("_t is null or _t <> type").select(*keys).distinct().withColumn("_unknown", F.lit(True))
    rows = rows.join(proof, keys, "left").join(unknown, keys, "left")
    needs = F.col("action").isin("confirm", "split")
    status = (
        F.when(~F.col("revision_id").eqNullSafe(F.col("_now")) | ~F.col("_last").eqNullSafe(F.col("expected_review_id")), "STALE_REVIEW")
        .when(needs & (F.col("_unknown").isNotNull() | (F.size("entity_ids") == 0)), "INVALID_ARGUMENT")
        .when(needs & F.col("_proof").isNull(), "INVALID_EVIDENCE")
        .otherwise("saved")
    )
    return rows.select(*keys, status.alias("status"))


@query(
    "e9_save",
    MODEL
    + """SELECT document_id, type, norm, CASE WHEN n % 5 = 0 THEN 'STALE_REVIEW' WHEN n % 3 <> 0 AND n % 5 = 1 THEN 'STALE_REVIEW' WHEN n % 5 = 2 THEN 'INVALID_ARGUMENT' WHEN n % 5 = 3 THEN 'INVALID_EVIDENCE' ELSE 'saved' END AS status
    FROM (SELECT DISTINCT document_id, type, norm, CAST(substr(document_id, 5) AS BIGINT) AS n FROM resolved_ JOIN pages_ USING (document_id) WHERE type = 'company' AND field = 'companies' AND text <> '')""",
)
def e9_save(spark, sf_dir):
    """Reviews that are stale, unknown, without evidence, and sound."""
    docs = pages(spark, sf_dir)
    found = _resolved(spark, sf_dir).where("type = 'company' and field = 'companies'")
    log = _log(spark, sf_dir, found)
    n = F.col("doc_id")
    whole = docs.where("text <> ''").select("document_id", "doc_id", "revision_id", F.substring("text", 1, 5).alias("head"))
    asked = found.select("document_id", "type", "norm").distinct().join(whole, "document_id").select(
        "document_id",
        F.when(n % 5 == 0, "old").otherwise(F.col("revision_id")).alias("revision_id"),
        "type",
        "norm",
        F.lit("confirm").alias("action"),
        F.array(F.when(n % 5 == 2, "entity:topic:0").otherwise(F.lit("entity:company:1"))).alias("entity_ids"),
        F.when(n % 5 == 3, "no such words anywhere").otherwise(F.col("head")).alias("quote"),
        F.when((n % 5 == 1) | (n % 3 == 0), 2).alias("expected_review_id"),
    )
    return saved(asked, log, docs, blocks(spark, sf_dir), entities(spark, sf_dir))


RELATIONS = {"issued_by": ("security", "company"), "subsidiary_of": ("company", "company"), "product_of": ("topic", "company"), "supplies_to": ("company", "company")}


def business_relations(registry_: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts (source_id, target_id, relation_type, source, observed_at, valid_from, valid_to, quote) with a relation_id and the first
    problem of each (null for sound ones). No date is made up: validity stays unknown where it is not given."""
    kind = registry_.select("entity_id", "type")
    rows = facts.join(kind.toDF("source_id", "_from"), "source_id", "left").join(kind.toDF("target_id", "_to"), "target_id", "left")
    fits = F.lit(False)
    for name, (a, b) in RELATIONS.items():
        first = F.col("_from").isin("topic", "subfield") if name == "product_of" else F.col("_from") == a
        fits = fits | ((F.col("relation_type") == name) & first & (F.col("_to") == b))
    day = lambda c: F.try_to_date(c, "yyyy-MM-dd").isNotNull() & F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$")
    problem = (
        F.when(~F.col("relation_type").isin(*RELATIONS), "unknown_relation")
        .when(F.col("_from").isNull() | F.col("_to").isNull() | (F.col("source_id") == F.col("target_id")), "unknown_entity")
        .when(~F.coalesce(F.col("source").rlike("^https?://"), F.lit(False)), "bad_source")
        .when(~F.coalesce(day("observed_at"), F.lit(False)), "bad_date")
        .when(F.coalesce(F.trim("quote"), F.lit("")) == "", "no_quote")
        .when(F.col("valid_to").isNotNull() & (F.col("valid_from").isNull() | (F.col("valid_to") < F.col("valid_from"))), "bad_validity")
        .when(~fits, "types_do_not_fit")
    )
    parts = F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in ("source_id", "target_id", "relation_type", "source", "observed_at", "valid_from", "valid_to")]))
    return rows.withColumn("problem", problem).withColumn("relation_id", F.concat(F.lit("relation:"), F.substring(F.sha2(parts, 256), 1, 32))).drop("_from", "_to")


@query(
    "e10_business_relations",
    f"""WITH {ENTITIES} SELECT s AS source_id, CASE WHEN k % 8 = 1 THEN 'entity:company:none' ELSE 'entity:company:' || k END AS target_id, CASE k % 8 WHEN 0 THEN 'unknown_relation' WHEN 1 THEN 'unknown_entity' WHEN 2 THEN 'bad_source' WHEN 3 THEN 'bad_date'
      WHEN 4 THEN 'no_quote' WHEN 5 THEN 'bad_validity' WHEN 6 THEN 'types_do_not_fit' END AS problem,
      'relation:' || substr(sha256('["' || array_to_string([s, CASE WHEN k % 8 = 1 THEN 'entity:company:none' ELSE 'entity:company:' || k END, CASE k % 8 WHEN 0 THEN 'owns' WHEN 6 THEN 'supplies_to' ELSE 'issued_by' END,
        CASE WHEN k % 8 = 2 THEN 'ftp://x' ELSE 'https://x.org/' || k END, CASE WHEN k % 8 = 3 THEN '2024-02-30' ELSE '2024-02-28' END, CASE WHEN k % 8 = 7 THEN '' ELSE '2024-01-02' END, CASE WHEN k % 8 = 5 THEN '2024-01-01' ELSE '' END], '","') || '"]'), 1, 32) AS relation_id
    FROM (SELECT entity_id AS s, CAST(code AS INTEGER) AS k FROM entities_ WHERE type = 'security')""",
)
def e10(spark, sf_dir):
    """Issuers of securities as reviewed facts, sound and unsound."""
    known = entities(spark, sf_dir)
    k = F.col("code").cast("int")
    facts = known.where("type = 'security'").select(
        F.col("entity_id").alias("source_id"),
        F.when(k % 8 == 1, "entity:company:none").otherwise(F.concat(F.lit("entity:company:"), k)).alias("target_id"),
        F.when(k % 8 == 0, "owns").when(k % 8 == 6, "supplies_to").otherwise("issued_by").alias("relation_type"),
        F.when(k % 8 == 2, "ftp://x").otherwise(F.concat(F.lit("https://x.org/"), k)).alias("source"),
        F.when(k % 8 == 3, "2024-02-30").otherwise("2024-02-28").alias("observed_at"),
        F.when(k % 8 != 7, "2024-01-02").alias("valid_from"),
        F.when(k % 8 == 5, "2024-01-01").alias("valid_to"),
        F.when(k % 8 != 4, "quoted").alias("quote"),
    )
    return business_relations(known, facts).select("source_id", "target_id", "problem", "relation_id")


def packets(found: DataFrame, docs: DataFrame, context: DataFrame, names: int = 3, most: int = 40, chars: int = 700) -> DataFrame:
    """For each open name, up to three documents (one of each family, smallest first) and the blocks of these that hold it or
    stand first, each cut around the name. Aggregated by window, no query per name. The sample is written first, so that Spark
    knows its size and meets it with the documents before their texts are split: other texts are neither split nor moved."""
    from .retrieval import scratch

    open_ = found.where("status <> 'curated'").select("type", "norm", "document_id").distinct().join(docs.select("document_id", "doc_id", "family_id"), "document_id")
    sample = first_per(first_per(open_, ["type", "norm", "family_id"], ["doc_id"]), ["type", "norm"], ["doc_id"], names)
    path = f"{scratch(found.sparkSession)}/packets-{uuid.uuid4().hex}"
    sample.write.parquet(path)
    sample = found.sparkSession.read.schema(sample.schema).parquet(path)
    texts = context.join(sample.select("document_id").distinct(), "document_id", "left_semi").select("document_id", "ordinal", "text")
    held = sample.join(texts, "document_id").withColumn("at", F.expr("locate(norm, lower(text))"))
    kept = first_per(held, ["type", "norm", "document_id"], [F.desc(F.col("at") > 0), "ordinal"], most)
    return kept.select("type", "norm", "document_id", "ordinal", F.expr(f"substring(text, greatest(1, at - 200), {chars})").alias("excerpt"))


@query(
    "e11_packets",
    f"""WITH {PAGES}, {ENTITIES}, {BLOCKS}, """
    + MODEL.split(ENTITIES + ", ")[1].rstrip()
    + """, open_ AS (SELECT DISTINCT type, norm, document_id, doc_id, family_id FROM resolved_ JOIN pages_ USING (document_id) WHERE status <> 'curated'),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type, norm, family_id ORDER BY doc_id) AS f FROM open_) WHERE f = 1),
    three AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type, norm ORDER BY doc_id) AS n FROM one) WHERE n <= 3)
    SELECT type, norm, document_id, ordinal, substr(text, greatest(1, strpos(lower(text), norm) - 200), 700) AS excerpt FROM
      (SELECT t.type, t.norm, t.document_id, b.ordinal, b.text, row_number() OVER (PARTITION BY t.type, t.norm, t.document_id ORDER BY strpos(lower(b.text), t.norm) > 0 DESC, b.ordinal) AS k FROM three t JOIN blocks_ b ON b.document_id = t.document_id) WHERE k <= 40""",
)
def e11(spark, sf_dir):
    return packets(_resolved(spark, sf_dir), pages(spark, sf_dir), blocks(spark, sf_dir))


@query("a6_document_counts", f"{MODEL}, {_COUNTS} SELECT entity_id, name, coalesce(documents, 0) AS document_count FROM entities_ LEFT JOIN counts_ USING (entity_id)")
def a6(spark, sf_dir):
    """Documents of each entity, none included: aggregated first, joined after."""
    return entities(spark, sf_dir).join(_counts(spark, sf_dir), "entity_id", "left").select("entity_id", "name", F.coalesce("documents", F.lit(0)).alias("document_count"))


@query("a13_mention_audit", MODEL + "SELECT type, status, count(DISTINCT norm) AS names, count(DISTINCT document_id) AS documents FROM resolved_ GROUP BY 1, 2")
def a13(spark, sf_dir):
    return _resolved(spark, sf_dir).groupBy("type", "status").agg(F.countDistinct("norm").alias("names"), F.countDistinct("document_id").alias("documents"))


@query("a15_name_frequency", MODEL + "SELECT type, norm, count(DISTINCT document_id) AS documents FROM mentions_ GROUP BY 1, 2")
def a15(spark, sf_dir):
    return mentions(pages(spark, sf_dir)).groupBy("type", "norm").agg(F.countDistinct("document_id").alias("documents"))


@query("j23_pending_examples", MODEL + "SELECT type, norm, document_id FROM (SELECT *, row_number() OVER (PARTITION BY type, norm ORDER BY document_id) AS n FROM (SELECT DISTINCT type, norm, document_id FROM resolved_ WHERE status <> 'curated')) WHERE n <= 3")
def j23(spark, sf_dir):
    """Up to three documents of every open name in one query."""
    open_ = _resolved(spark, sf_dir).where("status <> 'curated'").select("type", "norm", "document_id").distinct()
    return first_per(open_, ["type", "norm"], ["document_id"], 3)


@query("j24_family_sample", MODEL + "SELECT type, norm, document_id FROM (SELECT *, row_number() OVER (PARTITION BY type, norm ORDER BY doc_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY type, norm, family_id ORDER BY doc_id) AS f FROM (SELECT DISTINCT type, norm, document_id, doc_id, family_id FROM resolved_ JOIN pages_ USING (document_id))) WHERE f = 1) WHERE n <= 3")
def j24(spark, sf_dir):
    """Up to three documents of every name, each of another family."""
    rows = _resolved(spark, sf_dir).select("type", "norm", "document_id").distinct().join(pages(spark, sf_dir).select("document_id", "doc_id", "family_id"), "document_id")
    return first_per(first_per(rows, ["type", "norm", "family_id"], ["doc_id"]), ["type", "norm"], ["doc_id"], 3).select("type", "norm", "document_id")


@query("w7_queue_once", MODEL + "SELECT type, norm, document_id, min(field || '|' || raw) AS first FROM resolved_ WHERE status <> 'curated' GROUP BY 1, 2, 3 ORDER BY 1, 2, 3 LIMIT 51")
def w7(spark, sf_dir):
    """One row of each (type, name, document), a page of 50 and one more."""
    open_ = _resolved(spark, sf_dir).where("status <> 'curated'").withColumn("first", F.concat_ws("|", "field", "raw"))
    return first_per(open_, ["type", "norm", "document_id"], ["first"]).orderBy("type", "norm", "document_id").limit(51).select("type", "norm", "document_id", "first")
