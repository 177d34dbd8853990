"""The page index and the live corpus: scopes, blocks and outlines, freshness, facets, home lists, queues."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import BLOCKS, MODEL, PAGES, blocks, entities, pages
from ..registry import registry
from ..views import table
from .filters import InvalidArgument, apply_filter, validate
from .mentions import mentions, resolved
from .windows import first_per

QUERIES, SQL, query = registry()
P = f"WITH {PAGES} "
B = f"WITH {PAGES}, {BLOCKS} "


def memberships(spark, sf_dir) -> DataFrame:
    """document_id and entity_id of every resolved mention."""
    return resolved(mentions(pages(spark, sf_dir)), entities(spark, sf_dir)).where("entity_id is not null").select("document_id", "entity_id").distinct()


_MEMBERS = MODEL + ", members_ AS (SELECT DISTINCT document_id, entity_id FROM resolved_ WHERE entity_id IS NOT NULL) "


def with_members(docs: DataFrame, members: DataFrame, op: str, ids: list[str]) -> DataFrame:
    """Documents by their entities: exists, contains_any, contains_all (each of ids), contains_none. Semi joins; no array is built."""
    hit = members.where(F.col("entity_id").isin(ids)) if ids else members
    if op == "contains_all":
        hit = hit.groupBy("document_id").agg(F.countDistinct("entity_id").alias("_n")).where(F.col("_n") == len(set(ids)))
    return docs.join(hit, "document_id", "left_anti" if op in ("contains_none", "missing") else "left_semi")


_TWO = ["entity:company:1", "entity:security:1"]
for _op, _sql in {
    "contains_any": "document_id IN (SELECT document_id FROM members_ WHERE entity_id IN ('entity:company:1', 'entity:security:1'))",
    "contains_all": "document_id IN (SELECT document_id FROM members_ WHERE entity_id IN ('entity:company:1', 'entity:security:1') GROUP BY 1 HAVING count(*) = 2)",
    "contains_none": "document_id NOT IN (SELECT document_id FROM members_ WHERE entity_id IN ('entity:company:1', 'entity:security:1'))",
    "exists": "document_id IN (SELECT document_id FROM members_)",
    "missing": "document_id NOT IN (SELECT document_id FROM members_)",
}.items():

    def _entity(spark, sf_dir, op=_op):
        return with_members(pages(spark, sf_dir), memberships(spark, sf_dir), op, _TWO if op.startswith("contains") else []).select("document_id")

    query(f"p12_entity_{_op}", f"{_MEMBERS} SELECT document_id FROM pages_ WHERE {_sql}")(_entity)


def frozen(docs: DataFrame, members: DataFrame) -> DataFrame:
    """A snapshot column entity_ids: sorted ids, an empty list for none."""
    ids = members.groupBy("document_id").agg(F.sort_array(F.collect_set("entity_id")).alias("entity_ids"))
    return docs.join(ids, "document_id", "left").withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>")))


@query("p13_entity_frozen", f"{_MEMBERS} SELECT document_id FROM pages_ LEFT JOIN (SELECT document_id, list(entity_id) AS ids FROM members_ GROUP BY 1) USING (document_id) WHERE coalesce(list_has_any(ids, ['entity:company:4']), false) AND NOT coalesce(list_has_any(ids, ['entity:security:5']), false)")
def p13(spark, sf_dir):
    node = {"all": [{"field": "entity_ids", "op": "contains_any", "value": ["entity:company:4"]}, {"field": "entity_ids", "op": "contains_none", "value": ["entity:security:5"]}]}
    return apply_filter(frozen(pages(spark, sf_dir), memberships(spark, sf_dir)), node).select("document_id")


_CASES = [
    ("unknown field", {"field": "nothing", "op": "eq", "value": "x"}, False),
    ("date only", {"field": "title", "op": "gte", "value": "2024-01-01"}, False),
    ("no such day", {"field": "published_at", "op": "lte", "value": "2024-02-30"}, False),
    ("empty group", {"all": []}, False),
    ("too deep", {"not": {"not": {"not": {"not": {"not": {"field": "lang", "op": "eq", "value": "en"}}}}}}, False),
    ("too many values", {"field": "lang", "op": "in", "value": ["x"] * 101}, False),
    ("too long", {"field": "lang", "op": "eq", "value": "x" * 501}, False),
    ("exists is boolean", {"field": "tags", "op": "exists", "value": "true"}, False),
    ("any of all", {"any": [{"all": [{"field": "lang", "op": "eq", "value": "en"}]}, {"not": {"field": "tags", "op": "exists", "value": True}}]}, True),
    ("none of two", {"all": [{"field": "tags", "op": "contains_none", "value": ["lang:en", "src:src1"]}, {"field": "published_at", "op": "gte", "value": "2024-02-01"}]}, True),
]


@query("p1_validation", f"{P} SELECT name, name IN ('any of all', 'none of two') AS ok, CASE name WHEN 'any of all' THEN (SELECT count(*) FROM pages_ WHERE lang = 'en' OR len(tags) = 0) WHEN 'none of two' THEN (SELECT count(*) FROM pages_ WHERE NOT list_has_any(tags, ['lang:en', 'src:src1']) AND published_at >= '2024-02-01') END AS documents FROM (SELECT unnest({[n for n, *_ in _CASES]}) AS name)")
def p1(spark, sf_dir):
    """Which filters of a list are accepted, and how many pages pass those that are."""
    docs, out = pages(spark, sf_dir), []
    for name, node, _ in _CASES:
        try:
            out.append((name, True, apply_filter(docs, node).count()))
        except InvalidArgument:
            out.append((name, False, None))
    return spark.createDataFrame(out, "name string, ok boolean, documents long")


@query("p2_bound_values", f"{P} SELECT document_id FROM pages_ WHERE coalesce(title = 'x'' OR 1=1 --', false) OR coalesce(title = 'Report 7 from ' || source, false)")
def p2(spark, sf_dir):
    """Values are literals: quotes and comment signs in them are text."""
    docs = pages(spark, sf_dir)
    own = docs.where("doc_id = 7").select("title").first()
    nodes = [{"field": "title", "op": "eq", "value": v} for v in ("x' OR 1=1 --", own["title"] if own else "none")]
    return apply_filter(docs, {"any": nodes}).select("document_id")


def tags_match(tags: Column, all_: list[str], any_: list[str], none: list[str]) -> Column:
    """The tag triple on an array; an empty list of any_ asks nothing."""
    lit = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    tests = [F.size(F.array_except(lit(all_), tags)) == 0, ~F.coalesce(F.arrays_overlap(tags, lit(none)), F.lit(False))]
    if any_:
        tests.append(F.coalesce(F.arrays_overlap(tags, lit(any_)), F.lit(False)))
    return reduce(and_, tests)


@query("p15_tag_predicate", f"{P} SELECT document_id, list_contains(tags, 'lang:en') AND NOT list_contains(tags, 'src:src3') AS open, list_has_any(tags, ['src:src1', 'src:src2']) AS some FROM pages_")
def p15(spark, sf_dir):
    tags = F.col("tags")
    return pages(spark, sf_dir).select("document_id", tags_match(tags, ["lang:en"], [], ["src:src3"]).alias("open"), tags_match(tags, [], ["src:src1", "src:src2"], []).alias("some"))


@query("p16_combined", f"{P} SELECT document_id FROM pages_ WHERE coalesce(lang = 'de', false) AND list_has_any(tags, ['src:src4', 'src:src5'])")
def p16(spark, sf_dir):
    from .filters import combine, tags_filter

    node = combine(None, {"field": "lang", "op": "eq", "value": "de"}, None, tags_filter(any_=["src:src4", "src:src5"]))
    return apply_filter(pages(spark, sf_dir), node).select("document_id")


def metadata(df: DataFrame, names: list[str]) -> Column:
    """A JSON object of the named fields that are there; unknown names and missing values are left out."""
    known = [F.col(n).alias(n) for n in names if n in df.columns]
    return F.to_json(F.struct(*known), {"ignoreNullFields": "true"}) if known else F.lit("{}")


@query("p18_projection", f"{P} SELECT document_id, published_at, institution, '{{}}' AS nothing FROM pages_")
def p18(spark, sf_dir):
    """Fields by name, read back from the object."""
    docs = pages(spark, sf_dir)
    chosen = docs.select("document_id", metadata(docs, ["published_at", "institution", "none"]).alias("m"), metadata(docs, ["none"]).alias("nothing"))
    return chosen.select("document_id", F.get_json_object("m", "$.published_at").alias("published_at"), F.get_json_object("m", "$.institution").alias("institution"), "nothing")


#: The fields of a card.
CARD = ["tags", "tickers", "companies", "industries", "subfields", "institutions", "authors", "research_topics", "page_type", "category", "language", "stage", "published_at", "updated_at"]


@query("p19_card_fields", f"{P} SELECT document_id, to_json({{'tags': tags, 'tickers': tickers, 'companies': companies}}) AS lists, category, stage, published_at, updated_at, CAST(NULL AS VARCHAR) AS page_type, n_chars > 0 AS text_available, '/wiki/' || replace(slug, '/', '%2F') AS open_url FROM pages_ WHERE NOT deleted")
def p19(spark, sf_dir):
    """Cards: the default fields, null where a page has none, text_available and open_url."""
    docs = pages(spark, sf_dir).where(~F.col("deleted"))
    fields = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in CARD]
    cards = docs.select("document_id", *fields, (F.col("n_chars") > 0).alias("text_available"), F.concat(F.lit("/wiki/"), F.replace(F.url_encode("slug"), F.lit("+"), F.lit("%20"))).alias("open_url"))
    return cards.select("document_id", F.to_json(F.struct("tags", "tickers", "companies")).alias("lists"), "category", "stage", "published_at", "updated_at", "page_type", "text_available", "open_url")


@query("p20_evidence", f"{B} SELECT block_id, document_id, ordinal, start_offset, end_offset, 'block_only' AS locator_quality, substr(text, 1, 700) AS snippet FROM blocks_ WHERE NOT deleted")
def p20(spark, sf_dir):
    """Evidence: where a block stands, and whether its page is known."""
    quality = F.when(F.col("pdf_page").isNull(), "block_only").otherwise("pdf_page")
    return blocks(spark, sf_dir).where(~F.col("deleted")).select("block_id", "document_id", "ordinal", "start_offset", "end_offset", quality.alias("locator_quality"), F.substring("text", 1, 700).alias("snippet"))


@query("f17_block_snippet", f"{B} SELECT block_id, substr(text, 1, 700) AS snippet FROM blocks_ WHERE ordinal = 0")
def f17(spark, sf_dir):
    return blocks(spark, sf_dir).where("ordinal = 0").select("block_id", F.substring("text", 1, 700).alias("snippet"))


@query("p21_live", f"{P} SELECT document_id FROM pages_ WHERE NOT deleted")
def p21(spark, sf_dir):
    return pages(spark, sf_dir).where(~F.col("deleted")).select("document_id")


def index_filter(docs: DataFrame, categories=(), tag=None, tags=((), (), ()), stage=None, due=None, q="") -> DataFrame:
    """Pages of an index by category, one tag, tag triple, stage, review date and text in title, slug or tags."""
    tests = [tags_match(F.col("tags"), *map(list, tags))]
    if categories:
        tests.append(F.coalesce("category", F.lit("source")).isin(*categories))
    if tag:
        tests.append(F.array_contains("tags", tag))
    if stage:
        tests.append(F.coalesce(F.col("stage") == stage, F.lit(False)))
    if due:
        tests.append((F.coalesce("stage", F.lit("")) != "archived") & (F.col("updated_at") <= due))
    if q:
        tests.append(F.contains(F.lower(F.concat_ws(" ", "title", "slug", F.array_join("tags", " "))), F.lit(q.strip().lower())))
    return docs.where(reduce(and_, tests))


@query("p22_index_filters", f"{P} SELECT slug FROM pages_ WHERE coalesce(category, 'source') IN ('cat1', 'source') AND list_contains(tags, 'lang:en') AND coalesce(stage, '') <> 'archived' AND updated_at <= '2024-09-30' AND contains(lower(title || ' ' || slug || ' ' || array_to_string(tags, ' ')), 'report 1')")
def p22(spark, sf_dir):
    return index_filter(pages(spark, sf_dir), categories=("cat1", "source"), tag="lang:en", due="2024-09-30", q=" REPORT 1").select("slug")


@query("p24_graph_scope", f"{P} SELECT slug FROM pages_ WHERE list_contains(tags, 'lang:fr') AND coalesce(category, 'source') = 'cat2' AND contains(lower(title || ' ' || slug || ' ' || array_to_string(tags, ' ')), 'notes/')")
def p24(spark, sf_dir):
    return index_filter(pages(spark, sf_dir), categories=("cat2",), tags=(("lang:fr",), (), ()), q="Notes/").select("slug")


#: Columns that each view of a document reads; the scan is pruned to them.
VIEWS = {"metadata": ["document_id", "revision_id", "title", "tags"], "outline": ["document_id", "revision_id", "ordinal", "pdf_page", "section"], "blocks": ["document_id", "revision_id", "block_id", "ordinal", "text"]}


@query("p25_view_metadata", f"{P} SELECT document_id, revision_id, title, array_to_string(tags, '|') AS tags FROM pages_ WHERE doc_id < 50")
def p25(spark, sf_dir):
    """The metadata view reads no block."""
    return pages(spark, sf_dir).where("doc_id < 50").select(*VIEWS["metadata"]).withColumn("tags", F.array_join("tags", "|"))


def only(rows: DataFrame, by: Column) -> dict:
    """The one row where by holds: NOT_FOUND without one, AMBIGUOUS_ID with more; two rows at most are read."""
    found = rows.where(by).limit(2).collect()
    if len(found) != 1:
        raise InvalidArgument("AMBIGUOUS_ID" if found else "NOT_FOUND")
    return found[0].asDict(recursive=True)


@query("p26_one_id", f"{P} SELECT unnest(['doc:7', 'lang', 'none']) AS asked, unnest(['doc:7', 'AMBIGUOUS_ID', 'NOT_FOUND']) AS answer")
def p26(spark, sf_dir):
    docs, out = pages(spark, sf_dir), []
    for asked, test in (("doc:7", F.col("document_id") == "doc:7"), ("lang", F.col("lang") == "en"), ("none", F.col("document_id") == "none")):
        try:
            out.append((asked, only(docs.select("document_id", "lang"), test)["document_id"]))
        except InvalidArgument as problem:
            out.append((asked, str(problem)))
    return spark.createDataFrame(out, "asked string, answer string")


def selected(blocks_: DataFrame, start: int | None = None, page: int | None = None, block_id: str | None = None, find: str | None = None, neighbors: int = 0) -> DataFrame:
    """Blocks chosen by place, page, id or text (any case), with up to three neighbours on each side; each once."""
    if not 0 <= neighbors <= 3:
        raise InvalidArgument("neighbors must be from 0 to 3")
    test = F.lit(True)
    for value, own in ((start, F.col("ordinal") >= F.lit(start)), (page, F.col("pdf_page") == F.lit(page)), (block_id, F.col("block_id") == F.lit(block_id))):
        test = test & own if value is not None else test
    if find is not None:
        test = test & F.contains(F.lower("text"), F.lit(find.lower()))
    chosen = blocks_.where(test).select("document_id", F.explode(F.sequence(F.col("ordinal") - neighbors, F.col("ordinal") + neighbors)).alias("ordinal")).distinct()
    return blocks_.join(chosen, ["document_id", "ordinal"], "left_semi")


@query("p27_blocks_found", f"{B} SELECT DISTINCT b.document_id, b.ordinal FROM blocks_ b JOIN blocks_ h ON h.document_id = b.document_id AND b.ordinal BETWEEN h.ordinal - 1 AND h.ordinal + 1 WHERE contains(lower(h.text), 'the and')")
def p27(spark, sf_dir):
    return selected(blocks(spark, sf_dir), find="THE and", neighbors=1).select("document_id", "ordinal")


def outline(blocks_: DataFrame) -> DataFrame:
    """One entry of each page and heading path of a document: where it first stands."""
    return blocks_.groupBy("document_id", "pdf_page", "section").agg(F.min("ordinal").alias("ordinal"))


@query(
    "p28_outline",
    f"WITH {PAGES} SELECT document_id, CAST(p AS INTEGER) AS pdf_page, CASE WHEN p = 1 THEN 'Top' WHEN p = 2 THEN 'Top|Sub ' || (doc_id % 3) ELSE 'Next' END AS section FROM pages_, range(1, 4) t(p) WHERE doc_id % 4 = 0",
)
def p28(spark, sf_dir):
    """Outline of documents of three pages with headings, split into blocks first."""
    from ..functions.text import split_blocks

    n = F.col("doc_id")
    body = F.concat(F.lit("## PDF 第 1 页\n# Top\n"), F.repeat(F.lit("word "), 900), F.lit("\n## PDF 第 2 页\n## Sub "), n % 3, F.lit("\ntext\n## PDF 第 3 页 \n# Next\ntext"))
    split = pages(spark, sf_dir).where("doc_id % 4 = 0").select("document_id", F.posexplode(split_blocks(body)).alias("ordinal", "b")).select("document_id", "ordinal", "b.*")
    return outline(split).select("document_id", "pdf_page", F.array_join("section", "|").alias("section"))


@query("p29_public_path", f"{P} SELECT slug, starts_with(slug, 'sources/') AND NOT deleted AS public, CASE WHEN starts_with(slug, 'sources/') AND NOT deleted THEN '/files/' || substr(slug, 9) || '.zh.md' END AS url FROM pages_")
def p29(spark, sf_dir):
    """Translations are public for live sources only."""
    public = F.startswith("slug", F.lit("sources/")) & ~F.col("deleted")
    return pages(spark, sf_dir).select("slug", public.alias("public"), F.when(public, F.concat(F.lit("/files/"), F.substring("slug", 9, 300), F.lit(".zh.md"))).alias("url"))


def slug_ok(slug: Column) -> Column:
    """Segments of letters, digits and _ - . that are not only dots, 200 characters at most."""
    segments = F.forall(F.split(slug, "/"), lambda s: ~s.rlike("^\\.+$"))
    return F.coalesce(slug.rlike(r"^[\p{L}\p{N}_.\-]+(/[\p{L}\p{N}_.\-]+)*$") & (F.char_length(slug) <= 200) & segments, F.lit(False))


@query("p30_slugs", f"{P} SELECT raw, regexp_matches(raw, '^[\\p{{L}}\\p{{N}}_.-]+(/[\\p{{L}}\\p{{N}}_.-]+)*$') AND length(raw) <= 200 AND NOT regexp_matches(raw, '(^|/)\\.+(/|$)') AS ok, regexp_matches(raw, '^[\\p{{L}}\\p{{N}}_.-]+(/[\\p{{L}}\\p{{N}}_.-]+)*$') AND length(raw) <= 200 AND NOT regexp_matches(raw, '(^|/)\\.+(/|$)') AND NOT starts_with(raw, 'sources/') AS editable FROM (SELECT slug || CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/..' WHEN 2 THEN ' x' WHEN 3 THEN '/é.b' ELSE repeat('z', 200) END AS raw FROM pages_)")
def p30(spark, sf_dir):
    """Which slugs are valid, and which of these may be edited (sources may not)."""
    n = F.col("doc_id") % 5
    raw = F.concat("slug", F.when(n == 0, "").when(n == 1, "/..").when(n == 2, " x").when(n == 3, "/é.b").otherwise(F.repeat(F.lit("z"), 200)))
    rows = pages(spark, sf_dir).select(raw.alias("raw")).withColumn("ok", slug_ok(F.col("raw")))
    return rows.withColumn("editable", F.col("ok") & ~F.startswith("raw", F.lit("sources/")))


@query("j1_revision_join", f"{P} SELECT p.document_id, e.k FROM pages_ p JOIN (SELECT document_id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE revision_id END AS revision_id, doc_id % 3 AS k FROM pages_) e ON e.document_id = p.document_id AND e.revision_id = p.revision_id")
def j1(spark, sf_dir):
    """Entries of a snapshot with the very revision they name: two keys."""
    docs = pages(spark, sf_dir)
    entries = docs.select("document_id", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("revision_id")).alias("revision_id"), (F.col("doc_id") % 3).alias("k"))
    return docs.select("document_id", "revision_id").join(entries, ["document_id", "revision_id"]).select("document_id", "k")


def pinned(docs: DataFrame, refs: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """Documents at pinned revisions, and those of refs whose revision is not there."""
    asked = docs.sparkSession.createDataFrame(refs, "document_id string, revision_id string")
    keys = ["document_id", "revision_id"]
    missing = asked.join(docs.select(*keys), keys, "left_anti").collect()  # as many as refs at most
    return docs.join(F.broadcast(asked), keys), sorted(r["document_id"] for r in missing)


@query("j2_pinned", f"{P} SELECT document_id, true AS found FROM pages_ WHERE document_id IN ('doc:1', 'doc:2') UNION ALL SELECT 'doc:3', false")
def j2(spark, sf_dir):
    docs = pages(spark, sf_dir)
    refs = [(r["document_id"], r["revision_id"]) for r in docs.where("doc_id in (1, 2)").select("document_id", "revision_id").collect()]
    found, missing = pinned(docs, [*refs, ("doc:3", "gone")])
    return found.select("document_id", F.lit(True).alias("found")).union(spark.createDataFrame([(m, False) for m in missing], "document_id string, found boolean"))


@query("j8_first_chunks", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64) WHERE n <= 5")
def j8(spark, sf_dir, most: int = 5):
    """The first valid chunks of every page."""
    valid = table(spark, sf_dir, "embeddings").where("embedding is not null and size(embedding) = 64")
    return first_per(valid.select("label", "vec_id"), ["label"], ["vec_id"], most)


def matched(chunks: DataFrame, blocks_: DataFrame) -> DataFrame:
    """Chunks (document_id, chunk_text) with the blocks of their document of which either holds the other, trimmed."""
    joined = chunks.join(blocks_.where("text <> ''").select("document_id", "ordinal", "text"), "document_id")
    inner = F.trim(F.regexp_replace("text", r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    return joined.where(F.contains("text", F.col("chunk_text")) | ((inner != "") & F.contains("chunk_text", inner)))


@query("j12_chunk_blocks", f"{B} SELECT p.document_id, b.ordinal FROM pages_ p JOIN blocks_ b USING (document_id) WHERE contains(b.text, substr(p.text, 1801, 50)) AND length(p.text) > 1900 OR length(p.text) > 1900 AND contains(substr(p.text, 1801, 50), trim(b.text, ' ' || chr(9) || chr(10) || chr(13))) AND trim(b.text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def j12(spark, sf_dir):
    chunks = pages(spark, sf_dir).where(F.char_length("text") > 1900).select("document_id", F.substring("text", 1801, 50).alias("chunk_text"))
    return matched(chunks, blocks(spark, sf_dir)).select("document_id", "ordinal")


@query("j13_fresh_chunks", f"{P} SELECT p.document_id, v.vec_id FROM pages_ p JOIN embeddings v ON v.vec_id = p.doc_id WHERE NOT p.deleted AND (v.vec_id * 37) % 1000 >= p.n_chars % 1000 - 100")
def j13(spark, sf_dir):
    """Chunks of the page with the same key, unless they are older than the page by more than the slack."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", ((F.col("vec_id") * 37) % 1000).alias("updated"))
    docs = pages(spark, sf_dir).where(~F.col("deleted")).select("document_id", "doc_id", (F.col("n_chars") % 1000).alias("modified"))
    return docs.join(vectors, (F.col("vec_id") == F.col("doc_id")) & (F.col("updated") >= F.col("modified") - 100)).select("document_id", "vec_id")


@query("j16_both_ends", f"{_MEMBERS}, scope AS (SELECT DISTINCT entity_id FROM members_ SEMI JOIN (SELECT document_id FROM pages_ WHERE lang = 'en' AND NOT deleted) USING (document_id)) SELECT entity_id, issuer_id FROM entities_ WHERE issuer_id IN (SELECT entity_id FROM scope) AND entity_id IN (SELECT entity_id FROM scope)")
def j16(spark, sf_dir):
    """Relations both of whose ends stand in documents of the filter."""
    docs = apply_filter(pages(spark, sf_dir).where(~F.col("deleted")), {"field": "lang", "op": "eq", "value": "en"})
    scope = memberships(spark, sf_dir).join(docs, "document_id", "left_semi").select("entity_id").distinct()
    relations = entities(spark, sf_dir).where("issuer_id is not null").select("entity_id", "issuer_id")
    return relations.join(scope, "entity_id", "left_semi").join(scope.toDF("issuer_id"), "issuer_id", "left_semi").select("entity_id", "issuer_id")


def frontier(edges: DataFrame, ids: list[str], direction: str = "both") -> DataFrame:
    """Edges at any of ids, by direction; both ends are looked up apart and joined, each edge once."""
    arms = {"outgoing": ["source"], "incoming": ["target"], "both": ["source", "target"]}[direction]
    found = [edges.where(F.col(a).isin(ids)) for a in arms]
    return found[0] if len(found) == 1 else found[0].union(found[1]).distinct()


@query("j17_frontier", "SELECT 's' || s_suppkey AS source, 'n' || s_nationkey AS target, 'both' AS direction FROM supplier WHERE s_nationkey IN (3, 7) OR s_suppkey = 2 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'incoming' FROM supplier WHERE s_nationkey IN (3, 7) UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'outgoing' FROM supplier WHERE s_suppkey = 2")
def j17(spark, sf_dir):
    edges = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target"))
    out = [frontier(edges, ["s2", "n3", "n7"], d).withColumn("direction", F.lit(d)) for d in ("both", "incoming", "outgoing")]
    return out[0].union(out[1]).union(out[2])


@query("j19_affected", MODEL + "SELECT DISTINCT document_id FROM mentions_ WHERE (type = 'company' AND norm IN ('acme 3', 'unknown co 2')) OR (type = 'security' AND norm = 'hk:00004')")
def j19(spark, sf_dir):
    """Documents with a mention whose alias changed."""
    changed = spark.createDataFrame([("company", "acme 3"), ("company", "unknown co 2"), ("security", "hk:00004")], "type string, norm string")
    return mentions(pages(spark, sf_dir)).join(F.broadcast(changed), ["type", "norm"], "left_semi").select("document_id").distinct()


@query("j21_lookup", f"{P} SELECT a.slug, b.title AS target_title FROM pages_ a JOIN pages_ b ON b.slug = a.supported_by")
def j21(spark, sf_dir):
    """Relation targets by slug."""
    docs = pages(spark, sf_dir)
    return docs.where("supported_by is not null").select("slug", "supported_by").join(docs.select(F.col("slug").alias("supported_by"), F.col("title").alias("target_title")), "supported_by").select("slug", "target_title")


@query("a8_ordered_array", f"{P} SELECT source, array_to_string(list(institution ORDER BY institution) FILTER (institution IS NOT NULL), ',') AS institutions FROM (SELECT DISTINCT source, institution FROM pages_) GROUP BY 1")
def a8(spark, sf_dir):
    """Values in order; nulls are left out, a group without any is null."""
    rows = pages(spark, sf_dir).select("source", "institution").distinct()
    joined = rows.groupBy("source").agg(F.sort_array(F.collect_list("institution")).alias("i"))
    return joined.select("source", F.when(F.size("i") > 0, F.array_join("i", ",")).alias("institutions"))


@query("a9_object", f"{P} SELECT lang, max(n) FILTER (stage = 'draft') AS draft, max(n) FILTER (stage = 'active') AS active FROM (SELECT lang, stage, count(*) AS n FROM pages_ WHERE stage IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def a9(spark, sf_dir):
    """Counts by stage as one object for each language."""
    counted = pages(spark, sf_dir).where("stage is not null").groupBy("lang", "stage").agg(F.count("*").alias("n"))
    objects = counted.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("stage", "n"))).alias("o"))
    return objects.select("lang", F.col("o")["draft"].alias("draft"), F.col("o")["active"].alias("active"))


@query("a12_counters", f"{_MEMBERS} SELECT (SELECT count(*) FROM entities_) AS entities, (SELECT count(*) FROM members_) AS memberships, (SELECT count(DISTINCT document_id) FROM members_) AS documents, (SELECT count(DISTINCT tag) FROM (SELECT unnest(tags) AS tag FROM pages_)) AS tags")
def a12(spark, sf_dir):
    members = memberships(spark, sf_dir)
    arms = [entities(spark, sf_dir).agg(F.count("*").alias("entities")), members.agg(F.count("*").alias("memberships"), F.countDistinct("document_id").alias("documents")), pages(spark, sf_dir).select(F.explode("tags").alias("tag")).agg(F.countDistinct("tag").alias("tags"))]
    return arms[0].join(arms[1]).join(arms[2])  # one row each


@query("a17_tag_counts", f"{P} SELECT tag, count(*) AS n FROM (SELECT document_id, unnest(list_distinct(tags)) AS tag FROM pages_ WHERE NOT deleted) GROUP BY 1 ORDER BY n DESC, tag LIMIT 100")
def a17(spark, sf_dir):
    tags = pages(spark, sf_dir).where(~F.col("deleted")).select(F.explode(F.array_distinct("tags")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(100)


def tag_options(docs: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Tags that hold q, most frequent first, each with the number of tags in its group over the whole index."""
    tags = docs.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    tags = tags.withColumn("grp", F.regexp_extract("tag", "^([^:：]*)[:：]", 1))
    groups = tags.groupBy("grp").agg(F.count("*").alias("in_group"))
    hit = tags.where(F.contains(F.lower("tag"), F.lit(q.lower()))).orderBy(F.desc("n"), "tag").limit(limit)
    return hit.join(groups, "grp")


@query("a20_tag_options", f"{P}, t AS (SELECT tag, count(*) AS n, split_part(replace(tag, '：', ':'), ':', 1) AS grp FROM (SELECT unnest(list_distinct(tags)) AS tag FROM pages_) GROUP BY 1) SELECT grp, tag, n, in_group FROM (SELECT * FROM t WHERE contains(lower(tag), 'src1') ORDER BY n DESC, tag LIMIT 20) JOIN (SELECT grp, count(*) AS in_group FROM t GROUP BY 1) USING (grp)")
def a20(spark, sf_dir):
    return tag_options(pages(spark, sf_dir), "SRC1").select("grp", "tag", "n", "in_group")


@query("a21_navigation", f"{P} SELECT category, document_id, total FROM (SELECT coalesce(category, 'source') AS category, document_id, count(*) OVER (PARTITION BY coalesce(category, 'source')) AS total, row_number() OVER (PARTITION BY coalesce(category, 'source') ORDER BY updated_at DESC, document_id) AS n FROM pages_ WHERE NOT deleted) WHERE n <= 8")
def a21(spark, sf_dir):
    """The eight latest pages of each category with its total, counted apart from the ranking."""
    live = pages(spark, sf_dir).where(~F.col("deleted")).select(F.coalesce("category", F.lit("source")).alias("category"), "document_id", "updated_at")
    total = live.groupBy("category").agg(F.count("*").alias("total"))
    return first_per(live, ["category"], [F.desc("updated_at"), "document_id"], 8).join(total, "category").select("category", "document_id", "total")


@query(
    "a25_quality_at_k",
    "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS place, role = 'user' AS relevant FROM conversations), a AS (SELECT conv_id, count(*) FILTER (relevant) AS wanted, count(*) FILTER (relevant AND place <= 20) AS got, sum(CASE WHEN relevant AND place <= 10 THEN 1 / log2(place + 1) ELSE 0 END) AS dcg, min(place) FILTER (relevant) AS first FROM r GROUP BY 1) SELECT round(avg(CASE WHEN wanted = 0 THEN 0 ELSE got * 1.0 / wanted END), 9) AS recall_20, round(avg(coalesce(1.0 / first, 0)), 9) AS mrr, round(avg(CASE WHEN wanted = 0 THEN 0 ELSE dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(wanted, 10) AS BIGINT) + 1) t(i)) END), 9) AS ndcg_10 FROM a",
)
def a25(spark, sf_dir):
    """Recall at 20, reciprocal rank and normalised gain at 10; questions without an answer count as zero."""
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn")
    ranked = table(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(w).alias("place"), (F.col("role") == "user").alias("relevant"))
    hit = F.col("relevant")
    per = ranked.groupBy("conv_id").agg(F.count_if(hit).alias("wanted"), F.count_if(hit & (F.col("place") <= 20)).alias("got"), F.sum(F.when(hit & (F.col("place") <= 10), 1 / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("dcg"), F.min(F.when(hit, F.col("place"))).alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    none = F.col("wanted") == 0
    return per.agg(F.round(F.avg(F.when(none, 0.0).otherwise(F.col("got") / F.col("wanted"))), 9).alias("recall_20"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 9).alias("mrr"), F.round(F.avg(F.when(none, 0.0).otherwise(F.col("dcg") / ideal)), 9).alias("ndcg_10"))


@query("a26_identity", MODEL + "SELECT count(*) AS mentions, count(*) FILTER (status = 'curated') AS mapped, count(*) FILTER (status = 'curated' AND entity_id = gold) AS right, count(*) FILTER (gold IS NOT NULL AND status <> 'curated') AS missed, count(*) FILTER (status = 'curated' AND entity_id IS DISTINCT FROM gold) AS false_merges, round(count(*) FILTER (status = 'curated' AND entity_id = gold) / CAST(count(*) FILTER (status = 'curated') AS DOUBLE), 9) AS precision FROM (SELECT r.*, CASE WHEN CAST(substr(document_id, 5) AS BIGINT) % 10 = 0 THEN 'entity:company:1' WHEN starts_with(norm, 'supplier#') THEN 'entity:company:' || CAST(regexp_extract(norm, '#0*([1-9][0-9]*)', 1) AS INTEGER) END AS gold FROM resolved_ r WHERE type = 'company')")
def a26(spark, sf_dir):
    """Resolution against known identities: precision, what was missed, what was merged wrongly."""
    gold = F.when(F.substring("document_id", 5, 20).cast("long") % 10 == 0, "entity:company:1").when(F.startswith("norm", F.lit("supplier#")), F.concat(F.lit("entity:company:"), F.regexp_extract("norm", "#0*([1-9][0-9]*)", 1)))
    rows = resolved(mentions(pages(spark, sf_dir)), entities(spark, sf_dir)).where("type = 'company'").withColumn("gold", gold)
    mapped, right = F.col("status") == "curated", F.coalesce(F.col("entity_id") == F.col("gold"), F.lit(False))
    return rows.agg(F.count("*").alias("mentions"), F.count_if(mapped).alias("mapped"), F.count_if(mapped & right).alias("right"), F.count_if(F.col("gold").isNotNull() & ~mapped).alias("missed"), F.count_if(mapped & ~F.col("entity_id").eqNullSafe(F.col("gold"))).alias("false_merges"), F.round(F.count_if(mapped & right) / F.count_if(mapped), 9).alias("precision"))


@query("a28_corpus_statistics", f"{P} SELECT coalesce(category, 'source') AS type, count(*) AS pages, count(*) FILTER (supported_by IS NOT NULL) AS links, count(DISTINCT source) AS sources, false AS estimated FROM pages_ GROUP BY 1")
def a28(spark, sf_dir):
    """Pages and links by type. Counts are exact here, and say so."""
    return pages(spark, sf_dir).groupBy(F.coalesce("category", F.lit("source")).alias("type")).agg(F.count("*").alias("pages"), F.count("supported_by").alias("links"), F.countDistinct("source").alias("sources")).withColumn("estimated", F.lit(False))


@query("a29_status_counts", f"{P} SELECT coalesce(stage, 'none') AS status, count(*) AS n FROM pages_ GROUP BY 1")
def a29(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(F.coalesce("stage", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


@query("w4_total_groups", f"{P}, g AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM pages_) GROUP BY 1) SELECT tag, n, (SELECT count(*) FROM g) AS total_groups FROM g ORDER BY n DESC, tag LIMIT 10")
def w4(spark, sf_dir):
    """The largest groups with the number of all groups, from an aggregate of its own."""
    groups = pages(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    total = groups.agg(F.count("*").alias("total_groups"))
    return groups.orderBy(F.desc("n"), "tag").limit(10).join(F.broadcast(total))


@query("w5_page_total", f"{P} SELECT slug, total FROM pages_, (SELECT count(*) AS total FROM pages_ WHERE NOT deleted) WHERE NOT deleted ORDER BY updated_at DESC, slug LIMIT 50 OFFSET 50")
def w5(spark, sf_dir):
    live = pages(spark, sf_dir).where(~F.col("deleted")).select("slug", "updated_at")
    total = live.agg(F.count("*").alias("total"))
    return live.orderBy(F.desc("updated_at"), "slug").offset(50).limit(50).join(F.broadcast(total)).select("slug", "total")


@query("w2_nearest_three", "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT label, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), e), 9) AS score FROM embeddings, q) SELECT label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 3")
def w2(spark, sf_dir):
    """The three nearest chunks of every document."""
    from .search import cosine

    vectors = table(spark, sf_dir, "embeddings")
    q = vectors.where("vec_id = 0").first()["embedding"]
    scored = vectors.select("label", "vec_id", F.round(cosine(F.col("embedding"), q), 9).alias("score"))
    return first_per(scored, ["label"], [F.desc("score"), "vec_id"], 3)


@query("w9_group_cap", f"{P} SELECT document_id FROM (SELECT document_id, row_number() OVER (PARTITION BY family_id ORDER BY n_chars DESC, document_id) AS n FROM pages_) WHERE n <= 3")
def w9(spark, sf_dir):
    return first_per(pages(spark, sf_dir), ["family_id"], [F.desc("n_chars"), "document_id"], 3).select("document_id")


@query("w11_edges_per_page", f"{P}, r AS (SELECT tag, row_number() OVER (ORDER BY count(*) DESC, tag) AS rank FROM (SELECT unnest(tags) AS tag FROM pages_) GROUP BY 1) SELECT slug, tag FROM (SELECT slug, tag, row_number() OVER (PARTITION BY slug ORDER BY rank) AS n FROM (SELECT slug, unnest(tags) AS tag FROM pages_) JOIN r USING (tag)) WHERE n <= 2")
def w11(spark, sf_dir, most: int = 2):
    """The edges of each page to its commonest tags: ranked by the tags' counts, no rank of its own is made."""
    tags = pages(spark, sf_dir).select("slug", F.explode("tags").alias("tag"))
    counts = tags.groupBy("tag").agg(F.count("*").alias("n"))
    return first_per(tags.join(counts, "tag"), ["slug"], [F.desc("n"), "tag"], most).select("slug", "tag")


@query("o3_more_pages", f"{P} SELECT count(*) = 11 AS more FROM (SELECT document_id FROM pages_ WHERE lang = 'en' ORDER BY document_id LIMIT 11)")
def o3(spark, sf_dir):
    """One row more than the page tells that there are more."""
    rows = pages(spark, sf_dir).where("lang = 'en'").orderBy("document_id").limit(11)
    return rows.agg((F.count("*") == 11).alias("more"))


def within_budget(rows: list[dict], tokens: int) -> tuple[list[dict], bool]:
    """Rows of a page while their JSON fits two characters a token; a first row that does not fit is an error."""
    import json

    out, used = [], 0
    for row in rows:
        used += len(json.dumps(row, ensure_ascii=False, default=str))
        if used > 2 * tokens:
            if not out:
                raise InvalidArgument("RESULT_TOO_LARGE")
            return out, True
        out.append(row)
    return out, False


@query("o4_too_large", "SELECT unnest([512, 40]) AS tokens, unnest(['cut', 'RESULT_TOO_LARGE']) AS outcome")
def o4(spark, sf_dir):
    rows = [r.asDict() for r in pages(spark, sf_dir).orderBy("document_id").limit(60).select("document_id", "slug", "title", "revision_id").collect()]
    out = []
    for tokens in (512, 40):
        try:
            out.append((tokens, "cut" if within_budget(rows, tokens)[1] else "whole"))
        except InvalidArgument as problem:
            out.append((tokens, str(problem)))
    return spark.createDataFrame(out, "tokens int, outcome string")


@query("o5_cursors", f"{P} SELECT name, CASE name WHEN 'same' THEN (SELECT document_id FROM pages_ WHERE NOT deleted ORDER BY title, document_id LIMIT 1 OFFSET 2) ELSE code END AS outcome FROM (SELECT unnest(['same', 'other request', 'damaged', 'other operation']) AS name, unnest(['', 'CURSOR_MISMATCH', 'INVALID_CURSOR', 'CURSOR_MISMATCH']) AS code)")
def o5(spark, sf_dir):
    """A cursor goes on where its page of the corpus ended; with another request or operation, or damaged, it is refused."""
    from ..plans.service import Service

    service, args, out = Service(spark, sf_dir), {"sort": "title", "direction": "asc", "limit": 2}, []
    cursor = service.execute("query", **args)["next_cursor"]
    for name, operation, asked in (("same", "query", args | {"cursor": cursor}), ("other request", "query", args | {"cursor": cursor, "direction": "desc"}), ("damaged", "query", args | {"cursor": cursor[:-5]}), ("other operation", "describe", {"section": "tags", "cursor": cursor})):
        try:
            out.append((name, service.execute(operation, **asked)["results"][0]["document_id"]))
        except InvalidArgument as problem:
            out.append((name, str(problem)))
    return spark.createDataFrame(out, "name string, outcome string")


#: Candidates that a search may consider by mode.
CANDIDATES = {"lexical": 120, "hybrid": 120, "deep": 300}


@query("o6_candidates", f"{P} SELECT mode, count(*) AS n FROM (SELECT 'lexical' AS mode FROM (SELECT 1 FROM pages_ LIMIT 120) UNION ALL SELECT 'hybrid' FROM (SELECT 1 FROM pages_ LIMIT 120) UNION ALL SELECT 'deep' FROM (SELECT 1 FROM pages_ LIMIT 300)) GROUP BY 1")
def o6(spark, sf_dir):
    ranked = pages(spark, sf_dir).orderBy(F.desc("n_chars"), "document_id")
    arms = [ranked.limit(n).select(F.lit(mode).alias("mode")) for mode, n in CANDIDATES.items()]
    return arms[0].union(arms[1]).union(arms[2]).groupBy("mode").agg(F.count("*").alias("n"))


def capped(df: DataFrame, most: int, fail: bool) -> tuple[DataFrame, bool]:
    """At most most rows and whether there were more; with fail, more is an error."""
    more = df.limit(most + 1).count() > most
    if more and fail:
        raise InvalidArgument("RESULT_TOO_LARGE")
    return df.limit(most), more


@query("o7_caps", f"{P} SELECT (SELECT count(*) FROM pages_) > 100 AS truncated, 100 AS returned, (SELECT count(*) FROM pages_) > 100 AS refused")
def o7(spark, sf_dir):
    docs = pages(spark, sf_dir).select("document_id")
    some, more = capped(docs, 100, False)
    try:
        capped(docs, 100, True)
        refused = False
    except InvalidArgument:
        refused = True
    return some.agg(F.lit(more).alias("truncated"), F.count("*").cast("int").alias("returned"), F.lit(refused).alias("refused"))


_SPELT = ("zebra", "Äpfel", "apfel", "Zoo", "北京", "上海", "广州")


@query("o9_collated", f"{P} SELECT name, row_number() OVER (ORDER BY name COLLATE zh, name) AS place FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT unnest(tags) FROM pages_ UNION SELECT unnest({list(_SPELT)}))")
def o9(spark, sf_dir):
    """Names in the order of a Chinese reader (pinyin, and letters as everywhere): the collation is Spark's. Tags of all pages, nations,
    regions, and names of mixed scripts; their list is short, as each name is taken once."""
    spelt = spark.createDataFrame([(x,) for x in _SPELT], "name string")
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "region").select("r_name"))
    names = names.union(pages(spark, sf_dir).select(F.explode("tags"))).union(spelt).distinct()
    return names.select("name", F.row_number().over(Window.orderBy(F.collate("name", "zh"), "name")).cast("long").alias("place"))


@query("o11_top_per_group", f"{P} SELECT grp, tag, n FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, tag) AS k FROM (SELECT split_part(tag, ':', 1) AS grp, tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM pages_) GROUP BY 1, 2)) WHERE k <= 6")
def o11(spark, sf_dir):
    tags = pages(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return first_per(tags.withColumn("grp", F.split_part("tag", F.lit(":"), F.lit(1))), ["grp"], [F.desc("n"), "tag"], 6).select("grp", "tag", "n")


@query("o12_priority", f"{P} SELECT document_id FROM pages_ ORDER BY coalesce(published_at, '') DESC, lang <> 'en' DESC, source, document_id LIMIT 40")
def o12(spark, sf_dir):
    """What to do next: newest, foreign before domestic, then batch and id."""
    order = [F.coalesce("published_at", F.lit("")).desc(), (F.col("lang") != "en").desc(), F.col("source"), F.col("document_id")]
    return pages(spark, sf_dir).orderBy(*order).limit(40).select("document_id")


@query("o13_report_order", f"{P} SELECT document_id FROM (SELECT *, doc_id % 7 = 0 AS fallback, substr(updated_at, 1, 7) AS month, CASE WHEN doc_id % 7 = 0 THEN substr(updated_at, 1, 7) || '-01' ELSE updated_at END AS day FROM pages_) ORDER BY month DESC, day DESC, CASE WHEN fallback THEN n_chars END DESC NULLS LAST, slug LIMIT 60")
def o13(spark, sf_dir):
    """Reports by month and day; only where both days are the month's fallback does the file's time decide."""
    fallback = F.col("doc_id") % 7 == 0
    month = F.substring("updated_at", 1, 7)
    rows = pages(spark, sf_dir).withColumn("month", month).withColumn("day", F.when(fallback, F.concat(month, F.lit("-01"))).otherwise(F.col("updated_at")))
    return rows.orderBy(F.desc("month"), F.desc("day"), F.when(fallback, F.col("n_chars")).desc_nulls_last(), "slug").limit(60).select("document_id")


@query("o14_home", f"{P} SELECT 'recent' AS list, document_id FROM (SELECT document_id FROM pages_ ORDER BY updated_at DESC, document_id LIMIT 8) UNION ALL SELECT 'unread', document_id FROM (SELECT document_id FROM pages_ WHERE stage IS NULL ORDER BY updated_at DESC, document_id LIMIT 8) UNION ALL SELECT 'due', document_id FROM (SELECT document_id FROM pages_ WHERE coalesce(stage, '') <> 'archived' AND updated_at <= '2024-06-30' ORDER BY updated_at, document_id LIMIT 8)")
def o14(spark, sf_dir):
    docs = pages(spark, sf_dir)
    new = [F.desc("updated_at"), "document_id"]
    lists = {"recent": (docs, new), "unread": (docs.where("stage is null"), new), "due": (index_filter(docs, due="2024-06-30"), ["updated_at", "document_id"])}
    arms = [rows.orderBy(*order).limit(8).select(F.lit(name).alias("list"), "document_id") for name, (rows, order) in lists.items()]
    return arms[0].union(arms[1]).union(arms[2])


@query("o15_queue_page", f"{P} SELECT document_id FROM pages_ WHERE stage = 'draft' ORDER BY document_id LIMIT 50 OFFSET 10")
def o15(spark, sf_dir):
    return pages(spark, sf_dir).where("stage = 'draft'").orderBy("document_id").offset(10).limit(50).select("document_id")


@query("u2_header_matches", f"{P} SELECT document_id FROM pages_ WHERE list_contains(tags, 'src:src1') UNION SELECT document_id FROM pages_ WHERE contains(lower(title), 'src12')")
def u2(spark, sf_dir):
    """Two branches, each with its own filter, instead of one OR; each document once."""
    docs = pages(spark, sf_dir)
    return docs.where(F.array_contains("tags", "src:src1")).select("document_id").union(docs.where(F.contains(F.lower("title"), F.lit("src12"))).select("document_id")).distinct()


@query("u3_channels", f"{P} SELECT document_id, 'body' AS channel, 0.1 AS score FROM pages_ WHERE contains(lower(text), ' the ') UNION ALL SELECT document_id, 'header', 4.0 FROM pages_ WHERE contains(title, 'src1')")
def u3(spark, sf_dir):
    docs = pages(spark, sf_dir)
    body = docs.where(F.contains(F.lower("text"), F.lit(" the "))).select("document_id", F.lit("body").alias("channel"), F.lit(0.1).alias("score"))
    return body.unionByName(docs.where(F.contains("title", F.lit("src1"))).select("document_id", F.lit("header").alias("channel"), F.lit(4.0).alias("score")))


@query("u5_affected_names", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT 's' || s_suppkey AS k, s_nationkey AS v FROM supplier WHERE s_suppkey % 5 <> 0) a FULL JOIN (SELECT 's' || s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS v FROM supplier WHERE s_suppkey % 7 <> 0) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def u5(spark, sf_dir):
    """Registry keys that were added, removed or lead elsewhere: the names to resolve again."""
    from ..plans.incremental import changes

    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"), F.concat(F.lit("s"), "s_suppkey").alias("k"), F.col("s_nationkey").alias("signature"))
    new = s.where("n % 7 <> 0").withColumn("signature", F.when(F.col("n") % 3 == 0, F.col("signature") + 1).otherwise(F.col("signature")))
    return changes(s.where("n % 5 <> 0"), new, "k")


@query("r1_distinct_in_order", f"{P} SELECT document_id, array_to_string(list_distinct_ordered, '|') AS tags FROM (SELECT document_id, list_concat([tags[2]], list_filter(tags, lambda t: t <> tags[2])) AS list_distinct_ordered FROM pages_)")
def r1(spark, sf_dir):
    """Repeats go, the order of first places stays."""
    return pages(spark, sf_dir).select("document_id", F.array_join(F.array_distinct(F.concat(F.array(F.col("tags")[1]), "tags", "tags")), "|").alias("tags"))


@query("d9_fresh", "SELECT event_id, epoch_ms(ts) >= 1704067200000 + (event_id % 30) * 86400000 - 1000 AS fresh FROM events")
def d9(spark, sf_dir):
    """Whether a row is as new as its source, to a second."""
    modified = F.lit(1704067200000) + (F.col("event_id") % 30) * 86_400_000
    return table(spark, sf_dir, "events").select("event_id", (F.unix_millis(F.col("ts").cast("timestamp")) >= modified - 1000).alias("fresh"))
