"""Graphs of pages, tags and entities: seeds, typed edges with provenance, budgeted walks, link neighbourhoods, the page-graph
index and its neighbourhood, bipartite and overview graphs, incremental inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import MODEL, PAGES, entities, pages
from ..registry import registry
from ..views import table
from .filters import InvalidArgument
from .graph import traverse
from .mentions import mentions, resolved
from .windows import first_per

QUERIES, SQL, query = registry()
P = f"WITH {PAGES} "
#: Tags that say how a page came here and join nothing.
GENERIC = ("local", "pdf", "web", "report")
_SHA = lambda c: F.concat(F.lit("tag:"), F.substring(F.sha2(c, 256), 1, 24))


def seed(docs: DataFrame, registry_: DataFrame, kind: str, id_: str) -> dict:
    """The node of a seed: a document by id or slug, an entity, a tag by its id. SEED_NOT_FOUND, AMBIGUOUS_SEED."""
    if kind == "document":
        rows = docs.where((F.col("document_id") == id_) | (F.col("slug") == id_)).select(F.col("document_id").alias("id"), F.col("title").alias("label"))
    elif kind == "entity":
        rows = registry_.where(F.col("entity_id") == id_).select(F.col("entity_id").alias("id"), F.col("name").alias("label"))
    elif kind == "tag":
        rows = docs.select(F.explode("tags").alias("label")).distinct().select(_SHA("label").alias("id"), "label").where(F.col("id") == id_)
    else:
        raise InvalidArgument("INVALID_ARGUMENT")
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise InvalidArgument("AMBIGUOUS_SEED" if found else "SEED_NOT_FOUND")
    return {"id": found[0]["id"], "kind": kind, "label": found[0]["label"]}


@query("g1_seeds", f"{P} SELECT unnest(['document', 'slug', 'entity', 'tag', 'none', 'two']) AS name, unnest(['doc:4', (SELECT document_id FROM pages_ WHERE doc_id = 5), 'entity:topic:1', 'tag:' || substr(sha256('lang:en'), 1, 24), 'SEED_NOT_FOUND', 'AMBIGUOUS_SEED']) AS answer")
def g1(spark, sf_dir):
    docs, known, out = pages(spark, sf_dir), entities(spark, sf_dir), []
    slug = docs.where("doc_id = 5").first()["slug"]
    two = docs.withColumn("slug", F.lit("same"))
    tag = spark.range(1).select(_SHA(F.lit("lang:en")).alias("t")).first()["t"]
    for name, rows, kind, id_ in (("document", docs, "document", "doc:4"), ("slug", docs, "document", slug), ("entity", docs, "entity", "entity:topic:1"), ("tag", docs, "tag", tag), ("none", docs, "entity", "entity:x"), ("two", two, "document", "same")):
        try:
            out.append((name, seed(rows, known, kind, id_)["id"]))
        except InvalidArgument as problem:
            out.append((name, str(problem)))
    return spark.createDataFrame(out, "name string, answer string")


def edges(docs: DataFrame, found: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """source, target, type, provenance: documents and their entities, tags and typed relations (by slug), and relations between
    entities (source_id, target_id, relation_type, relation_id). Of live documents only."""
    live = docs.where(~F.col("deleted"))
    known = found.where("entity_id is not null").join(live.select("document_id"), "document_id", "left_semi")
    arms = [
        known.groupBy("document_id", "entity_id").agg(F.array_join(F.sort_array(F.collect_set("raw")), "|").alias("raw")).select(F.col("document_id").alias("source"), F.col("entity_id").alias("target"), F.lit("has_entity").alias("type"), F.concat(F.lit("metadata:"), "raw").alias("provenance")),
        live.select(F.col("document_id").alias("source"), F.explode(F.array_distinct("tags")).alias("tag")).select("source", _SHA("tag").alias("target"), F.lit("has_tag").alias("type"), F.concat(F.lit("tags:"), "tag").alias("provenance")),
        live.where("supported_by is not null").select(F.col("document_id").alias("source"), F.col("supported_by").alias("slug")).join(live.select("slug", F.col("document_id").alias("target")), "slug").select("source", "target", F.lit("supported_by").alias("type"), F.lit("frontmatter:supported_by").alias("provenance")),
    ]
    if relations is not None:
        arms.append(relations.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation_type").alias("type"), F.concat(F.lit("registry:"), "relation_id").alias("provenance")))
    out = arms[0]
    for arm in arms[1:]:
        out = out.unionByName(arm)
    return out


def adjacent(graph: DataFrame, ids: list[str], direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """All edges at ids by direction and type, in order, however many; the ends are two branches, each with its own filter."""
    rows = graph if not types else graph.where(F.col("type").isin(types))
    sides = {"outgoing": ["source"], "incoming": ["target"], "both": ["source", "target"]}[direction]
    parts = [rows.where(F.col(s).isin(ids)) for s in sides]
    found = parts[0] if len(parts) == 1 else parts[0].union(parts[1]).distinct()
    return found.orderBy("source", "target", "type", "provenance")


def _graph(spark, sf_dir) -> DataFrame:
    known = entities(spark, sf_dir)
    issued = known.where("issuer_id is not null").select(F.col("entity_id").alias("source_id"), F.col("issuer_id").alias("target_id"), F.lit("issued_by").alias("relation_type"), F.concat(F.lit("r:"), "entity_id").alias("relation_id"))
    return edges(pages(spark, sf_dir), resolved(mentions(pages(spark, sf_dir)), known), issued)


_EDGES = MODEL + """, edges_ AS (
  SELECT document_id AS source, entity_id AS target, 'has_entity' AS type, 'metadata:' || string_agg(DISTINCT raw, '|' ORDER BY raw) AS provenance FROM resolved_ SEMI JOIN (SELECT document_id FROM pages_ WHERE NOT deleted) USING (document_id) WHERE entity_id IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT document_id, 'tag:' || substr(sha256(tag), 1, 24), 'has_tag', 'tags:' || tag FROM (SELECT document_id, unnest(tags) AS tag FROM pages_ WHERE NOT deleted)
  UNION ALL SELECT a.document_id, b.document_id, 'supported_by', 'frontmatter:supported_by' FROM pages_ a JOIN pages_ b ON b.slug = a.supported_by WHERE NOT a.deleted AND NOT b.deleted
  UNION ALL SELECT entity_id, issuer_id, 'issued_by', 'registry:r:' || entity_id FROM entities_ WHERE issuer_id IS NOT NULL) """


@query("g2_typed_edges", _EDGES + "SELECT source, target, type, provenance FROM edges_ WHERE source = 'doc:18' OR target = 'doc:2' OR source = 'doc:2' OR target = 'doc:18' OR source = 'entity:company:4' OR target = 'entity:company:4' ORDER BY 1, 2, 3, 4")
def g2(spark, sf_dir):
    """Edges of four kinds at a document and an entity, with where each comes from."""
    return adjacent(_graph(spark, sf_dir), ["doc:18", "doc:2", "entity:company:4"])


@query("u4_edge_arms", _EDGES + "SELECT type, count(*) AS n, count(DISTINCT source) AS sources FROM edges_ GROUP BY 1")
def u4(spark, sf_dir):
    return _graph(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("g7_two_hops", _EDGES + ", one AS (SELECT * FROM edges_ WHERE type = 'supported_by' AND (source = 'doc:18' OR target = 'doc:18')), near AS (SELECT source AS id FROM one UNION SELECT target FROM one) SELECT DISTINCT source, target, provenance AS declared_in FROM edges_ WHERE type = 'supported_by' AND (source IN (SELECT id FROM near) OR target IN (SELECT id FROM near))")
def g7(spark, sf_dir):
    """Typed relations of documents up to two hops away, with the field that declares each."""
    graph = _graph(spark, sf_dir).where("type = 'supported_by'")
    _, taken, _ = traverse(graph.select("source", "target", "type"), "doc:18", depth=2, max_nodes=400, max_edges=500)
    chosen = spark.createDataFrame(taken, "source string, target string, type string")
    return graph.join(F.broadcast(chosen), ["source", "target", "type"]).select("source", "target", F.col("provenance").alias("declared_in"))


@query("g8_related_capped", f"{P} SELECT a.document_id AS source, b.document_id AS target FROM pages_ a JOIN pages_ b ON b.slug = a.supported_by WHERE NOT a.deleted AND NOT b.deleted ORDER BY 1, 2 LIMIT 500")
def g8(spark, sf_dir):
    """Relations from page fields alone, without an index, at most 500."""
    live = pages(spark, sf_dir).where(~F.col("deleted"))
    joined = live.where("supported_by is not null").select(F.col("document_id").alias("source"), F.col("supported_by").alias("slug")).join(live.select("slug", F.col("document_id").alias("target")), "slug")
    return joined.select("source", "target").orderBy("source", "target").limit(500)


@query("g9_entity_scope", MODEL + "SELECT slug FROM pages_ WHERE NOT deleted AND document_id IN (SELECT document_id FROM resolved_ WHERE entity_id = 'entity:company:7')")
def g9(spark, sf_dir):
    """Pages that an entity stands in."""
    hit = resolved(mentions(pages(spark, sf_dir)), entities(spark, sf_dir)).where("entity_id = 'entity:company:7'")
    return pages(spark, sf_dir).where(~F.col("deleted")).join(hit, "document_id", "left_semi").select("slug")


def hub_index(docs: DataFrame, found: DataFrame) -> DataFrame:
    """slug, hub, kind, evidence, pages: tags but for the generic ones and curated entities of each page, up to three proofs of each
    link, and how many pages a hub has."""
    tags = docs.select("slug", F.explode(F.array_distinct("tags")).alias("tag")).where(~F.lower("tag").isin(*GENERIC))
    tags = tags.select("slug", F.concat(F.lit("tag:"), "tag").alias("hub"), F.lit("tag").alias("kind"), F.concat(F.lit("tags="), "tag").alias("proof"))
    named = found.where("status = 'curated'").join(docs.select("document_id", "slug"), "document_id").select("slug", F.col("entity_id").alias("hub"), F.lit("entity").alias("kind"), F.concat("field", F.lit("="), "raw").alias("proof"))
    links = tags.unionByName(named).distinct()
    rows = first_per(links, ["slug", "hub", "kind"], ["proof"], 3).groupBy("slug", "hub", "kind").agg(F.array_join(F.sort_array(F.collect_list("proof")), "; ").alias("evidence"))
    return rows.join(rows.groupBy("hub").agg(F.count("*").alias("pages")), "hub")


_HUBS = MODEL + """, links_ AS (SELECT slug, 'tag:' || tag AS hub, 'tag' AS kind, 'tags=' || tag AS proof FROM (SELECT slug, unnest(list_distinct(tags)) AS tag FROM pages_) WHERE lower(tag) NOT IN ('local', 'pdf', 'web', 'report')
  UNION SELECT slug, entity_id, 'entity', field || '=' || raw FROM resolved_ JOIN pages_ USING (document_id) WHERE status = 'curated'),
hubs_ AS (SELECT slug, hub, kind, string_agg(proof, '; ' ORDER BY proof) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY slug, hub ORDER BY proof) AS n FROM links_) WHERE n <= 3 GROUP BY 1, 2, 3),
sized_ AS (SELECT *, count(*) OVER (PARTITION BY hub) AS pages FROM hubs_) """


@query("g11_page_graph_index", _HUBS + "SELECT slug, hub, kind, evidence, pages FROM sized_")
def g11(spark, sf_dir):
    docs = pages(spark, sf_dir)
    return hub_index(docs, resolved(mentions(docs), entities(spark, sf_dir))).select("slug", "hub", "kind", "evidence", "pages")


def neighbourhood(index: DataFrame, docs: DataFrame, slug: str, hubs: int = 32, related: int = 50) -> tuple[DataFrame, DataFrame]:
    """The hubs shown with a page (entities first, then the rarer), and the pages that share them, best first: each shared hub is
    worth 1 (an entity 2) over log2 of 2 plus its pages."""
    shown = index.where(F.col("slug") == slug).orderBy(F.desc(F.col("kind") == "entity"), "pages", "hub").limit(hubs)
    weight = F.when(F.col("kind") == "entity", 2).otherwise(1) / F.log2(2 + F.col("pages"))
    near = index.join(F.broadcast(shown.select("hub")), "hub", "left_semi").where(F.col("slug") != slug)
    score = near.groupBy("slug").agg(F.sum(weight).alias("score")).join(docs.select("slug", "updated_at"), "slug")
    return shown, score.orderBy(F.desc(F.round("score", 9)), F.desc("updated_at"), "slug").limit(related)


@query("g12_page_neighbourhood", _HUBS + ", shown AS (SELECT hub FROM sized_ WHERE slug = 'sources/p-6' ORDER BY kind = 'entity' DESC, pages, hub LIMIT 3) SELECT s.slug, round(sum(CASE WHEN kind = 'entity' THEN 2 ELSE 1 END / log2(2 + pages)), 9) AS score FROM sized_ s JOIN pages_ p ON p.slug = s.slug WHERE hub IN (SELECT hub FROM shown) AND s.slug <> 'sources/p-6' GROUP BY s.slug, updated_at ORDER BY score DESC, updated_at DESC, s.slug LIMIT 50")
def g12(spark, sf_dir):
    docs = pages(spark, sf_dir)
    index = hub_index(docs, resolved(mentions(docs), entities(spark, sf_dir)))
    return neighbourhood(index, docs, "sources/p-6", hubs=3)[1].select("slug", F.round("score", 9).alias("score"))


@query("g13_bipartite", f"{P}, shown AS (SELECT slug, tags FROM pages_ ORDER BY updated_at DESC, slug LIMIT 80), t AS (SELECT slug, unnest(list_distinct(tags)) AS tag FROM shown), r AS (SELECT tag, row_number() OVER (ORDER BY tag = 'lang:en' DESC, regexp_matches(tag, '^(公司|行业|领域)[:：]') DESC, count(*) DESC, tag) AS rank FROM t GROUP BY 1), e AS (SELECT slug, tag, row_number() OVER (PARTITION BY slug ORDER BY rank) AS n FROM t JOIN r USING (tag) WHERE rank <= 40) SELECT slug, tag, (SELECT count(*) FROM e WHERE n > 10) AS omitted FROM e WHERE n <= 10")
def g13(spark, sf_dir):
    """The newest pages with at most forty tags (asked ones, entities, then the commonest) and ten edges each; how many were left out."""
    shown = pages(spark, sf_dir).orderBy(F.desc("updated_at"), "slug").limit(80).select("slug", F.explode(F.array_distinct("tags")).alias("tag"))
    rank = [F.desc(F.col("tag") == "lang:en"), F.desc(F.col("tag").rlike("^(公司|行业|领域)[:：]")), F.desc("n"), "tag"]
    tags = shown.groupBy("tag").agg(F.count("*").alias("n")).orderBy(*rank).limit(40)
    edges_ = shown.join(F.broadcast(tags), "tag")
    kept = first_per(edges_, ["slug"], rank, 10)
    omitted = edges_.groupBy("slug").agg(F.greatest(F.count("*") - 10, F.lit(0)).alias("x")).agg(F.sum("x").alias("omitted"))
    return kept.select("slug", "tag").join(F.broadcast(omitted))


def overview(docs: DataFrame, featured: int = 6, asked: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Edges (category, tag, weight) between categories and the featured tags of each group, and the groups (grp, distinct, singletons,
    shown). A tag of one page is featured only if it was asked for. Every page counts; no pair of pages is made."""
    category = F.coalesce("category", F.lit("source"))
    tags = docs.select(category.alias("category"), F.explode(F.array_distinct("tags")).alias("tag"))
    tag = F.col("tag")
    group = F.when(F.startswith(tag, F.lit("公司:")), "company").when(F.startswith(tag, F.lit("行业:")), "industry").when(F.startswith(tag, F.lit("领域:")), "field").otherwise("topic")
    counts = tags.groupBy("tag").agg(F.count("*").alias("n")).withColumn("grp", group)
    wanted = F.col("tag").isin(*asked) if asked else F.lit(False)
    best = first_per(counts.where((F.col("n") >= 2) | wanted), ["grp"], [F.desc(wanted), F.desc("n"), "tag"], featured)
    groups = counts.groupBy("grp").agg(F.count("*").alias("distinct"), F.count_if(F.col("n") == 1).alias("singletons"), F.least(F.count_if((F.col("n") >= 2) | wanted), F.lit(featured)).alias("shown"))
    return tags.join(F.broadcast(best.select("tag")), "tag").groupBy("category", "tag").agg(F.count("*").alias("weight")), groups


_OVER = f"{P}, t AS (SELECT coalesce(category, 'source') AS category, unnest(list_distinct(tags)) AS tag FROM pages_ WHERE NOT deleted), c AS (SELECT tag, count(*) AS n, CASE WHEN starts_with(tag, '公司:') THEN 'company' WHEN starts_with(tag, '行业:') THEN 'industry' WHEN starts_with(tag, '领域:') THEN 'field' ELSE 'topic' END AS grp FROM t GROUP BY 1)"


@query("g14_overview_edges", f"{_OVER}, f AS (SELECT tag FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, tag) AS k FROM c WHERE n >= 2) WHERE k <= 6) SELECT category, tag, count(*) AS weight FROM t WHERE tag IN (SELECT tag FROM f) GROUP BY 1, 2")
def g14(spark, sf_dir):
    return overview(pages(spark, sf_dir).where(~F.col("deleted")))[0]


@query("g14_overview_groups", f'{_OVER} SELECT grp, count(*) AS "distinct", count(*) FILTER (n = 1) AS singletons, least(count(*) FILTER (n >= 2), 6) AS shown FROM c GROUP BY 1')
def g14_groups(spark, sf_dir):
    return overview(pages(spark, sf_dir).where(~F.col("deleted")))[1]


@query("g15_inventory", f"{P} SELECT slug, CASE WHEN doc_id % 6 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'added' ELSE 'read again' END AS change FROM pages_ WHERE NOT (doc_id % 6 = 0 AND doc_id % 7 = 0) AND (doc_id % 6 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0)")
def g15(spark, sf_dir):
    """What of a kept inventory is to be read again, dropped or added: by slug and time of change."""
    from ..plans.incremental import changes

    rows = pages(spark, sf_dir).select("doc_id", "slug", F.col("updated_at").alias("signature"))
    kept = rows.where("doc_id % 7 <> 0").withColumn("signature", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("signature")))
    found = changes(kept, rows.where("doc_id % 6 <> 0"), "slug")
    return found.select("slug", F.when(F.col("change") == "changed", "read again").otherwise(F.col("change")).alias("change"))


@query("g16_merged_neighbourhood", _EDGES + ", a AS (SELECT source, target, type FROM edges_ WHERE type = 'supported_by'), b AS (SELECT 'doc:' || (doc_id // 9) AS source, 'doc:' || doc_id AS target, 'manual' AS type FROM pages_ WHERE doc_id % 9 = 0 AND doc_id < 100) SELECT source, target, type, false AS explicit_unavailable FROM a WHERE source = 'doc:2' OR target = 'doc:2' UNION SELECT source, target, type, false FROM b WHERE source = 'doc:2' OR target = 'doc:2'")
def g16(spark, sf_dir):
    """Edges of a page from the pages' own fields and from a link table, each once; if the table can't be read, that is told."""
    own = _graph(spark, sf_dir).where("type = 'supported_by'").select("source", "target", "type")
    n = F.expr("doc_id div 9")
    manual = pages(spark, sf_dir).where("doc_id % 9 = 0 and doc_id < 100").select(F.concat(F.lit("doc:"), n).alias("source"), F.col("document_id").alias("target"), F.lit("manual").alias("type"))
    return own.union(manual).where("source = 'doc:2' or target = 'doc:2'").distinct().withColumn("explicit_unavailable", F.lit(False))


@query("g4_seeds_intersect", MODEL + "SELECT document_id FROM pages_ WHERE NOT deleted AND list_contains(tags, 'lang:en') AND document_id IN (SELECT document_id FROM resolved_ WHERE entity_id = 'entity:security:5') ORDER BY document_id LIMIT 10001")
def g4(spark, sf_dir):
    """Documents that have two to five seeds, in order of id: a semi join for each."""
    docs = pages(spark, sf_dir).where(~F.col("deleted"))
    graph = _graph(spark, sf_dir)
    out = docs.select("document_id")
    for target in (_SHA(F.lit("lang:en")), F.lit("entity:security:5")):
        out = out.join(graph.where(F.col("target") == target).select(F.col("source").alias("document_id")), "document_id", "left_semi")
    return out.orderBy("document_id").limit(10_001)


@query("j18_observed", "SELECT s_suppkey, s_suppkey % 4 = 1 AS valid FROM supplier")
def j18(spark, sf_dir):
    """Relations valid on a day: begun, not ended, and known by then; without a beginning, or observed later, they are not."""
    k = F.col("s_suppkey") % 4
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k != 0, F.lit("2024-01-01").cast("date")).alias("valid_from"), F.when(k == 2, F.lit("2024-02-01").cast("date")).alias("valid_to"), F.when(k == 3, F.lit("2024-12-01")).otherwise("2024-01-05").cast("date").alias("observed_at"))
    return rows.select("s_suppkey", as_of("2024-06-30").alias("valid"))


def as_of(day: str) -> Column:
    """Valid and observed on a day."""
    at = F.lit(day).cast("date")
    return F.coalesce((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at)) & (F.col("observed_at") <= at), F.lit(False))
