"""Versioned projections: revisions, families, generations, replace by key, guarded writes, exports, queues of work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_blocks
from ..model import MODEL, PAGES, entities, pages
from ..operators.mentions import mentions, resolved
from ..operators.retrieval import scratch
from ..operators.windows import first_per
from ..registry import registry
from ..views import table
from .incremental import changes

QUERIES, SQL, query = registry()
P = f"WITH {PAGES} "


def upserted(current: DataFrame, fresh: DataFrame, revisions: DataFrame) -> dict[str, DataFrame]:
    """Tables after a scan: documents (rows that were not seen stay, deleted), revisions (new ones appended, old ones as they are),
    blocks of the new revisions only. Rows are documents (document_id, revision_id, text)."""
    gone = current.join(fresh.select("document_id"), "document_id", "left_anti").withColumn("deleted", F.lit(True))
    documents = fresh.withColumn("deleted", F.lit(False)).unionByName(gone)
    new = fresh.select("document_id", "revision_id", "text").join(revisions.select("document_id", "revision_id"), ["document_id", "revision_id"], "left_anti")
    blocks = new.select("document_id", "revision_id", F.posexplode(split_blocks(F.coalesce("text", F.lit("")))).alias("ordinal", "b")).select("document_id", "revision_id", "ordinal", "b.*")
    return {"documents": documents, "revisions": revisions.unionByName(new.select("document_id", "revision_id")), "blocks": blocks}


def _scan(spark, sf_dir) -> dict[str, DataFrame]:
    docs = pages(spark, sf_dir).select("doc_id", "document_id", "revision_id", "text")
    old = docs.where("doc_id % 5 <> 0").withColumn("revision_id", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("revision_id"))).drop("doc_id")
    return upserted(old, docs.where("doc_id % 7 <> 0").drop("doc_id"), old.select("document_id", "revision_id"))


@query("k1_revisions", f"{P}, o AS (SELECT document_id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE revision_id END AS revision_id FROM pages_ WHERE doc_id % 5 <> 0) SELECT document_id, revision_id FROM o UNION SELECT document_id, revision_id FROM pages_ WHERE doc_id % 7 <> 0")
def k1_revisions(spark, sf_dir):
    """All revisions ever seen; a new one is appended, none is changed."""
    return _scan(spark, sf_dir)["revisions"]


@query("k1_new_blocks", f"{P} SELECT document_id, CAST(ceil(length(text) / 1800.0) AS BIGINT) AS blocks FROM pages_ WHERE doc_id % 7 <> 0 AND (doc_id % 5 = 0 OR doc_id % 3 = 0) AND text <> ''")
def k1_blocks(spark, sf_dir):
    """Blocks are made for new revisions only."""
    return _scan(spark, sf_dir)["blocks"].groupBy("document_id").agg(F.count("*").alias("blocks"))


@query("k2_soft_delete", f"{P} SELECT document_id, doc_id % 7 = 0 AS deleted FROM pages_ WHERE doc_id % 7 <> 0 OR doc_id % 5 <> 0")
def k2(spark, sf_dir):
    return _scan(spark, sf_dir)["documents"].select("document_id", "deleted")


@query("k3_family_of_original", f"{P} SELECT a.document_id, coalesce(b.family_id, a.family_id) AS family_id FROM pages_ a LEFT JOIN pages_ b ON b.slug = a.supported_by AND b.document_id <> a.document_id")
def k3(spark, sf_dir):
    """A translation takes its original's family."""
    docs = pages(spark, sf_dir)
    original = docs.select(F.col("slug").alias("supported_by"), F.col("family_id").alias("_family"), F.col("document_id").alias("_own"))
    joined = docs.join(original, "supported_by", "left")
    return joined.select("document_id", F.coalesce(F.when(F.col("_own") != F.col("document_id"), F.col("_family")), "family_id").alias("family_id"))


def generation(snapshot: DataFrame, base: str, number: int, keep: int = 2) -> list[int]:
    """Write a generation of a catalogue as a partition of its own and tell which ones readers may still use: the newest keep. Old
    partitions are named, not removed, while a cursor may point to them."""
    snapshot.write.mode("errorifexists").parquet(f"{base}/snapshot_id={number}")
    have = snapshot.sparkSession.read.parquet(base).select("snapshot_id").distinct().orderBy(F.desc("snapshot_id")).limit(keep + 1).collect()
    return [r["snapshot_id"] for r in have[:keep]]


@query("k4_generations", f"{P} SELECT CAST(g AS INTEGER) AS snapshot_id, count(*) AS entries FROM pages_, range(2, 4) t(g) WHERE doc_id % g = 0 GROUP BY 1")
def k4(spark, sf_dir):
    """Three generations, of which the two newest stay in use."""
    base, docs, live = f"{scratch(spark)}/catalogue-{uuid.uuid4().hex}", pages(spark, sf_dir).select("document_id", "doc_id", "title"), []
    for number in (1, 2, 3):
        live = generation(docs.where(F.col("doc_id") % number == 0), base, number)
    return spark.read.parquet(base).where(F.col("snapshot_id").isin(live)).groupBy("snapshot_id").agg(F.count("*").alias("entries"))


@query("k5_insert_once", f"{P} SELECT document_id, tag FROM (SELECT document_id, unnest(tags) AS tag FROM pages_)")
def k5(spark, sf_dir):
    """Rows put in twice stand once (conflicts do nothing)."""
    rows = pages(spark, sf_dir).select("document_id", F.explode("tags").alias("tag"))
    return rows.union(rows.where("document_id > 'doc:5'")).dropDuplicates(["document_id", "tag"])


def replaced(kept: DataFrame, fresh: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """A projection in which the rows of changed keys are those of fresh; keys without a fresh row have none left."""
    return kept.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh.join(changed.select(key).distinct(), key, "left_semi"))


@query("k6_replaced", f"{P} SELECT document_id, tag FROM (SELECT document_id, doc_id, unnest(tags) AS tag FROM pages_) WHERE doc_id % 4 <> 1 AND NOT (doc_id % 4 = 0 AND tag LIKE 'lang:%') AND doc_id % 4 <> 3 UNION ALL SELECT document_id, 'old' FROM pages_ WHERE doc_id % 4 = 3")
def k6(spark, sf_dir):
    """Tags of changed documents made anew: some lost one, some are gone, those of the others stay as they were."""
    docs = pages(spark, sf_dir)
    n = F.col("doc_id") % 4
    tags = docs.select("document_id", n.alias("n"), F.explode("tags").alias("tag"))
    kept = tags.where("n = 2").drop("n").unionByName(docs.where(n != 2).select("document_id", F.lit("old").alias("tag")))
    fresh = tags.where("n <> 1").where("not (n = 0 and tag like 'lang:%')").drop("n")
    return replaced(kept, fresh, docs.where(n.isin(0, 1)).select("document_id"), "document_id")


def written(asked: DataFrame, current: DataFrame) -> DataFrame:
    """Writes (slug, base_hash, text) against the current pages (slug, hash): written where the base is what stands there (or both are
    new), conflict where another version came first, unchanged where the text is the same."""
    joined = asked.join(current.select("slug", "hash"), "slug", "left")
    new = F.sha2("text", 256)
    outcome = F.when(~F.col("base_hash").eqNullSafe(F.col("hash")), "conflict").when(new.eqNullSafe(F.col("hash")), "unchanged").otherwise("written")
    return joined.select("slug", outcome.alias("outcome"), new.alias("new_hash"))


@query("k10_guarded_write", f"{P} SELECT slug, CASE WHEN doc_id % 4 = 0 THEN 'conflict' WHEN doc_id % 4 = 1 THEN 'unchanged' ELSE 'written' END AS outcome FROM pages_ WHERE text IS NOT NULL")
def k10(spark, sf_dir):
    docs = pages(spark, sf_dir).where("text is not null")
    n = F.col("doc_id") % 4
    current = docs.where(n != 3).select("slug", F.col("family_id").alias("hash"))
    base = F.when(n == 0, "stale").when(n == 3, None).otherwise(F.col("family_id"))
    asked = docs.select("slug", base.alias("base_hash"), F.when(n == 1, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("text"))
    return written(asked, current).select("slug", "outcome")


def history(versions: DataFrame, most: int = 20) -> DataFrame:
    """The last versions (key, version) of each key."""
    return first_per(versions, ["key"], [F.desc("version")], most)


@query("k10_history", "SELECT key, version FROM (SELECT user_id AS key, event_id AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 20")
def k10_history(spark, sf_dir):
    return history(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version")))


@query("k11_review_log", "SELECT conv_id, count(*) AS reviews, max(turn) AS latest, max(turn) > 2 AS stale_base FROM conversations GROUP BY 1")
def k11(spark, sf_dir):
    """Reviews are appended; one that was based on review 2 is stale if a later one came."""
    log = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("reviews"), F.max("turn").alias("latest"))
    return log.withColumn("stale_base", F.col("latest") > 2)


def exported(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contents once (sha256, source) and references (path, sha256) of files to export."""
    return files.groupBy("sha256").agg(F.min("path").alias("source")), files.select("path", "sha256")


@query("k12_export", f"{P} SELECT family_id AS sha256, min(slug) AS source, count(*) AS refs FROM pages_ GROUP BY 1")
def k12(spark, sf_dir):
    files = pages(spark, sf_dir).select(F.col("slug").alias("path"), F.col("family_id").alias("sha256"))
    contents, references = exported(files)
    return contents.join(references.groupBy("sha256").agg(F.count("*").alias("refs")), "sha256")


def dedup_decision(files: DataFrame, keepers: DataFrame) -> DataFrame:
    """Each file (path, sha256, size, volume, inode) against the keeper of its target (keepers: path, keeper): already one with it,
    another content, another volume, or to be linked."""
    own = files.select(F.col("path").alias("keeper"), F.struct("sha256", "size", "volume", "inode").alias("k"))
    joined = files.join(keepers, "path").join(own, "keeper")
    outcome = F.when(F.col("inode") == F.col("k.inode"), "already_linked").when((F.col("sha256") != F.col("k.sha256")) | (F.col("size") != F.col("k.size")), "different_content").when(F.col("volume") != F.col("k.volume"), "different_volume").otherwise("linked")
    return joined.select("path", outcome.alias("outcome"))


@query("k13_four_outcomes", "SELECT doc_id AS path, CASE doc_id % 4 WHEN 0 THEN 'already_linked' WHEN 1 THEN 'different_content' WHEN 2 THEN 'different_volume' ELSE 'linked' END AS outcome FROM documents WHERE doc_id > 0")
def k13(spark, sf_dir):
    """All outcomes: every file against file 0."""
    n = F.col("doc_id")
    k = F.when(n == 0, 4).otherwise(n % 4)
    files = table(spark, sf_dir, "documents").select(n.alias("path"), F.when(k == 1, "b").otherwise("a").alias("sha256"), F.lit(5).alias("size"), F.when(k == 2, "v2").otherwise("v1").alias("volume"), F.when(k == 0, 0).otherwise(n).alias("inode"))
    return dedup_decision(files, files.where("path > 0").select("path", F.lit(0).cast("long").alias("keeper")))


@query("k14_daily_log", "SELECT strftime(ts, '%Y-%m-%d') AS utc_date, count(*) AS n FROM events GROUP BY 1")
def k14(spark, sf_dir):
    """A request log in folders of UTC days, written and read again."""
    from ..sources.connectors import write_log

    path = f"{scratch(spark)}/log-{uuid.uuid4().hex}"
    write_log(table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), path)
    back = spark.read.schema("event_id long, ts timestamp, utc_date date").json(path)
    return back.groupBy(F.date_format("utc_date", "yyyy-MM-dd").alias("utc_date")).agg(F.count("*").alias("n"))


@query("k15_audit", MODEL + "SELECT '| ' || type || ' | ' || status || ' | ' || count(DISTINCT norm) || ' |' AS line FROM resolved_ GROUP BY type, status")
def k15(spark, sf_dir):
    """The lines of an audit report."""
    rows = resolved(mentions(pages(spark, sf_dir)), entities(spark, sf_dir)).groupBy("type", "status").agg(F.countDistinct("norm").alias("n"))
    return rows.select(F.concat(F.lit("| "), "type", F.lit(" | "), "status", F.lit(" | "), "n", F.lit(" |")).alias("line"))


def scanned(known: DataFrame, files: DataFrame) -> DataFrame:
    """What a scan finds (key, signature, inode): unchanged, changed, added, removed, and renamed, where a key that went and one that
    came have one inode."""
    both = changes(known.select("key", "signature"), files.select("key", "signature"), "key")
    gone = both.where("change = 'removed'").join(known.select("key", "inode"), "key").select(F.col("key").alias("old"), "inode")
    came = both.where("change = 'added'").join(files.select("key", "inode"), "key").select(F.col("key").alias("new"), "inode")
    moved = gone.join(came, "inode").select("old", "new")
    rest = both.join(moved.select(F.col("old").alias("key")), "key", "left_anti").join(moved.select(F.col("new").alias("key")), "key", "left_anti")
    return rest.select("key", F.lit(None).cast("string").alias("was"), "change").unionByName(moved.select(F.col("new").alias("key"), F.col("old").alias("was"), F.lit("renamed").alias("change")))


@query("i1_renamed", f"{P} SELECT CASE WHEN doc_id % 6 = 1 THEN slug || '-new' ELSE slug END AS key, CASE WHEN doc_id % 6 = 1 THEN slug END AS was, CASE doc_id % 6 WHEN 0 THEN 'changed' WHEN 1 THEN 'renamed' WHEN 2 THEN 'removed' ELSE 'added' END AS change FROM pages_ WHERE doc_id % 6 < 4")
def i1(spark, sf_dir):
    rows = pages(spark, sf_dir).select("doc_id", F.col("slug").alias("key"), F.col("family_id").alias("signature"), F.col("doc_id").alias("inode"))
    n = F.col("doc_id") % 6
    files = rows.where(n != 2).withColumn("signature", F.when(n == 0, "x").otherwise(F.col("signature"))).withColumn("key", F.when(n == 1, F.concat("key", F.lit("-new"))).otherwise(F.col("key")))
    return scanned(rows.where(n != 3), files)


def to_refresh(docs: DataFrame, done: DataFrame, found: DataFrame, affected: DataFrame, registry_changed: bool) -> DataFrame:
    """Documents whose graph rows are made anew: of a new revision; with a mention (type, norm) whose meaning changed; and, if the
    registry changed, those that name a company with brackets, which may be a name and a code. Three semi joins."""
    kept = done.select("document_id", F.col("revision_id").alias("_r"))
    new = docs.join(kept, "document_id", "left").where(~F.col("revision_id").eqNullSafe(F.col("_r"))).select("document_id", F.lit("revision").alias("why"))
    named = found.join(affected, ["type", "norm"], "left_semi").select("document_id", F.lit("alias").alias("why"))
    out = new.union(named)
    if registry_changed:
        out = out.union(found.where("type = 'company' and contains(norm, '(')").select("document_id", F.lit("name_and_code").alias("why")))
    return out.distinct().groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_set("why")), ",").alias("why"))


@query("i2_refresh", MODEL + ", a AS (SELECT document_id, 'revision' AS why FROM pages_ WHERE doc_id % 10 = 0 UNION SELECT document_id, 'alias' FROM mentions_ WHERE type = 'company' AND norm = 'acme 3' UNION SELECT document_id, 'name_and_code' FROM mentions_ WHERE type = 'company' AND contains(norm, '(')) SELECT document_id, string_agg(why, ',' ORDER BY why) AS why FROM a GROUP BY 1")
def i2(spark, sf_dir):
    docs = pages(spark, sf_dir)
    done = docs.select("document_id", F.when(F.col("doc_id") % 10 == 0, "old").otherwise(F.col("revision_id")).alias("revision_id"))
    return to_refresh(docs, done, mentions(docs), spark.createDataFrame([("company", "acme 3")], "type string, norm string"), True)


def queue(docs: DataFrame, states: DataFrame, version: str, now: int) -> DataFrame:
    """Documents to work on with why: never tried, tried with another version, or a service failure whose time has come. A failure of this
    version, and what is complete with it, is not tried again; a service failure that is not due yet waits."""
    joined = docs.select("document_id").join(states.select("document_id", "state", "version", "retry_at"), "document_id", "left")
    same = F.coalesce(F.col("version") == version, F.lit(False))
    status = F.when(F.col("state").isNull(), "new").when(~same, "new version").when((F.col("state") == "pending_service") & (F.col("retry_at") <= now), "retry").when(F.col("state") == "pending_service", "waiting")
    return joined.withColumn("why", status).where("why is not null").select("document_id", "why", F.when(F.col("why") == "waiting", F.col("retry_at")).alias("next_retry"))


@query("i4_retries", f"{P} SELECT document_id, CASE doc_id % 6 WHEN 0 THEN 'new' WHEN 1 THEN 'new version' WHEN 2 THEN 'retry' ELSE 'waiting' END AS why, CASE WHEN doc_id % 6 = 3 THEN 200 END AS next_retry FROM pages_ WHERE doc_id % 6 < 4")
def i4(spark, sf_dir):
    docs, n = pages(spark, sf_dir), F.col("doc_id") % 6
    states = docs.where(n != 0).select("document_id", F.when(n.isin(2, 3), "pending_service").when(n == 4, "failed").otherwise("complete").alias("state"), F.when(n == 1, "v1").otherwise("v2").alias("version"), F.when(n == 3, 200).otherwise(100).alias("retry_at"))
    return queue(docs, states, "v2", 150)


#: Which states may follow a state of a document's work.
NEXT = {None: ["processing"], "processing": ["staged", "pending_service", "failed"], "staged": ["pending_index", "failed"], "pending_index": ["complete", "failed"], "pending_service": ["processing"], "failed": ["processing"], "complete": ["processing"]}


def folded(events: DataFrame) -> DataFrame:
    """The state of each key after its events (key, seq, state), how often it was tried, and whether each step was allowed."""
    from pyspark.sql import Window

    before = F.lag("state").over(Window.partitionBy("key").orderBy("seq"))
    allowed = F.create_map(*[x for s, ts in NEXT.items() for x in (F.lit(s or ""), F.array(*[F.lit(t) for t in ts]))])
    rows = events.withColumn("ok", F.array_contains(F.element_at(allowed, F.coalesce(before, F.lit(""))), F.col("state")))
    return rows.groupBy("key").agg(F.max_by("state", "seq").alias("state"), F.count_if(F.col("state") == "processing").alias("attempts"), F.every("ok").alias("sound"))


@query("i5_states", "SELECT doc_id AS key, CASE doc_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'pending_service' ELSE 'complete' END AS state, CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 1 END AS attempts, doc_id % 3 <> 2 AS sound FROM documents")
def i5(spark, sf_dir):
    """Work that went well, that waits for a service a second time, and whose log skips a step."""
    paths = [["processing", "staged", "pending_index", "complete"], ["processing", "pending_service", "processing", "pending_service"], ["processing", "complete"]]
    log = F.get(F.array(*[F.array(*[F.lit(s) for s in p]) for p in paths]), (F.col("doc_id") % 3).cast("int"))
    return folded(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.posexplode(log).alias("seq", "state")))


def coalesced(jobs: DataFrame, cap: int = 20) -> DataFrame:
    """Jobs (key, seq, payload) as a queue: one of each key, at the place of its first and with its last payload; beyond the cap refused."""
    one = jobs.groupBy("key").agg(F.min("seq").alias("first"), F.max_by("payload", "seq").alias("payload"))
    taken = one.orderBy("first").limit(cap).select("key", F.lit(True).alias("taken"))
    return one.join(taken, "key", "left").select("key", "payload", F.coalesce("taken", F.lit(False)).alias("taken"))


@query("i6_job_queue", "WITH o AS (SELECT event_type || (user_id % 5) AS key, min(event_id) AS first, max(event_id) AS payload FROM events GROUP BY 1) SELECT key, payload, row_number() OVER (ORDER BY first) <= 20 AS taken FROM o")
def i6(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select(F.concat("event_type", F.col("user_id") % 5).alias("key"), F.col("event_id").alias("seq"), F.col("event_id").alias("payload"))
    return coalesced(jobs)


@query("i9_newest_first", f"{P} SELECT document_id FROM pages_ WHERE doc_id % 3 = 0 AND (coalesce(published_at, ''), -doc_id) > (SELECT max((coalesce(published_at, ''), -doc_id)) FROM pages_ WHERE doc_id = 1)")
def i9(spark, sf_dir):
    """Documents not parsed yet that rank before the one that would be next."""
    docs = pages(spark, sf_dir).select("document_id", "doc_id", F.struct(F.coalesce("published_at", F.lit("")).alias("d"), (-F.col("doc_id")).alias("i")).alias("rank"))
    following = docs.where("doc_id = 1").select(F.col("rank").alias("next"))
    return docs.where("doc_id % 3 = 0").join(F.broadcast(following)).where(F.col("rank") > F.col("next")).select("document_id")
