"""The graph around one page: explicit links up to two hops, the hubs it shows, and related pages, each within its budget.

Spark finds the links of a frontier, the page's hubs and the best related pages; what reaches the driver is bounded by the budgets,
and is put together there. A link table beside the pages' own fields is read if it can be; if not, the answer says so.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import entities, pages
from ..registry import registry
from .filters import InvalidArgument
from .mentions import mentions, resolved
from .networks import _HUBS, hub_index
from .retrieval import scratch

QUERIES, SQL, query = registry()
#: Explicit pages of a hop, hubs, related pages, nodes of explicit links, edges.
PER_HOP, HUBS, RELATED, EXPLICIT, EDGES = 50, 32, 50, 51, 1000


def explicit(links: DataFrame, slug: str, depth: int = 2) -> tuple[list[tuple], bool]:
    """Links (source, target, type) around a page in order, and whether a budget cut them."""
    frontier, found, cut = [slug], {}, False
    for _ in range(min(depth, 2)):
        near = links.where(F.col("source").isin(frontier) | F.col("target").isin(frontier)).orderBy("source", "target", "type").limit(EDGES + 1).collect()
        following: dict[str, None] = {}
        for edge in map(tuple, near):
            found[edge] = None
            if len(found) >= EDGES:
                cut = True
                break
            for a, b in (edge[:2], edge[1::-1]):
                if a in frontier and b not in following:
                    if len(following) < PER_HOP:
                        following[b] = None
                    else:
                        cut = True
        frontier = list(following)
        if not frontier:
            break
    return list(found), cut


def page_graph(hubs: DataFrame, links: DataFrame, docs: DataFrame, slug: str, limit: int = 150, beside: Callable[[], DataFrame] | None = None) -> dict:
    """nodes (id, kind, level), edges (source, target, type), truncated, explicit_unavailable of a page's graph.

    hubs: slug, hub, kind, pages; links: source, target, type of pages' own fields; docs: slug, updated_at; beside: reads a further link
    table, which may not be there."""
    if not docs.where(F.col("slug") == slug).limit(1).count():
        raise InvalidArgument("NOT_FOUND")
    found, cut = explicit(links, slug)
    unavailable = False
    if beside is not None:
        try:
            more, also = explicit(beside().select("source", "target", "type"), slug)
            found, cut = list(dict.fromkeys([*found, *more])), cut or also
        except AnalysisException:  # the table is not there, or not such a table
            unavailable = True
    nodes, edges = {slug: ("page", 0)}, {}

    def connect(edge: tuple) -> None:
        nonlocal cut
        if edge not in edges:
            if len(edges) >= EDGES:
                cut = True
            else:
                edges[edge] = None

    for edge in found:
        missing = [x for x in dict.fromkeys(edge[:2]) if x not in nodes]
        if len(nodes) + len(missing) > min(limit, EXPLICIT):
            cut = True
            continue
        nodes |= {x: ("page", 1) for x in missing}
        connect(edge)
    own = hubs.where(F.col("slug") == slug).orderBy(F.desc(F.col("kind") == "entity"), "pages", "hub").limit(HUBS + 1).collect()
    cut = cut or len(own) > HUBS
    shown = {}
    for h in own[:HUBS]:
        if len(nodes) >= limit:
            cut = True
            break
        nodes[h["hub"]], shown[h["hub"]] = (h["kind"], 1), f"has_{h['kind']}"
        connect((slug, h["hub"], shown[h["hub"]]))
    if shown:
        held = hubs.where(F.col("hub").isin(list(shown)) & (F.col("slug") != slug))
        weight = F.when(F.col("kind") == "entity", 2).otherwise(1) / F.log2(2 + F.col("pages"))
        score = held.groupBy("slug").agg(F.round(F.sum(weight), 9).alias("score")).join(docs.select("slug", "updated_at"), "slug")
        best = [r["slug"] for r in score.orderBy(F.desc("score"), F.desc("updated_at"), "slug").limit(RELATED + len(nodes) + 1).collect()]
        fresh = [x for x in best if x not in nodes]
        room = max(0, min(RELATED, limit - len(nodes)))
        cut = cut or len(fresh) > room
        nodes |= {x: ("page", 2) for x in fresh[:room]}
        around = [x for x, (kind, _) in nodes.items() if kind == "page" and x != slug]
        for r in held.where(F.col("slug").isin(around)).select("slug", "hub").orderBy("slug", "hub").collect():  # pages times hubs, both bounded
            connect((r["slug"], r["hub"], shown[r["hub"]]))
    return {"nodes": [(k, *v) for k, v in nodes.items()], "edges": list(edges), "truncated": cut, "explicit_unavailable": unavailable}


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = pages(spark, sf_dir)
    links = docs.where("supported_by is not null").select(F.col("slug").alias("source"), F.col("supported_by").alias("target"), F.lit("supported_by").alias("type")).where("source <> target")
    links = links.join(docs.select(F.col("slug").alias("target")), "target", "left_semi").select("source", "target", "type")
    return hub_index(docs, resolved(mentions(docs), entities(spark, sf_dir))), links, docs


_GRAPH = (
    _HUBS
    + """, l0 AS (SELECT a.slug AS source, a.supported_by AS target FROM pages_ a JOIN pages_ b ON b.slug = a.supported_by WHERE a.slug <> a.supported_by),
l1 AS (SELECT * FROM l0 WHERE source = 'sources/p-18' OR target = 'sources/p-18'), n1 AS (SELECT source AS id FROM l1 UNION SELECT target FROM l1),
l2 AS (SELECT * FROM l1 UNION SELECT * FROM l0 WHERE source IN (SELECT id FROM n1) OR target IN (SELECT id FROM n1)), n2 AS (SELECT source AS id FROM l2 UNION SELECT target FROM l2 UNION SELECT 'sources/p-18'),
shown AS (SELECT hub, kind FROM sized_ WHERE slug = 'sources/p-18' ORDER BY kind = 'entity' DESC, pages, hub LIMIT 32),
near AS (SELECT s.slug FROM sized_ s JOIN pages_ p ON p.slug = s.slug WHERE hub IN (SELECT hub FROM shown) AND s.slug NOT IN (SELECT id FROM n2) GROUP BY s.slug, updated_at ORDER BY round(sum(CASE WHEN kind = 'entity' THEN 2 ELSE 1 END / log2(2 + pages)), 9) DESC, updated_at DESC, s.slug LIMIT 50),
all_ AS (SELECT id FROM n2 UNION SELECT slug FROM near) """
)


@query("g12_page_graph", _GRAPH + "SELECT source, target, 'supported_by' AS type FROM l2 UNION ALL SELECT slug, hub, 'has_' || kind FROM sized_ WHERE slug IN (SELECT id FROM all_) AND hub IN (SELECT hub FROM shown)")
def g12(spark, sf_dir):
    """A page with its links of two hops, its hubs, and the fifty pages nearest to it, connected to the hubs that are shown."""
    found = page_graph(*_parts(spark, sf_dir), "sources/p-18")
    return spark.createDataFrame(found["edges"], "source string, target string, type string")


@query("g16_link_table", _GRAPH + ", more AS (SELECT 'sources/p-18' AS source, slug AS target FROM pages_ WHERE doc_id IN (4, 7)) SELECT name, (SELECT count(*) FROM l2) + CASE WHEN name = 'there' THEN 2 ELSE 0 END AS links, name = 'gone' AS explicit_unavailable FROM (SELECT unnest(['there', 'gone']) AS name)")
def g16(spark, sf_dir):
    """The pages' own links with those of a table, and without it where it is gone: the answer says so."""
    hubs, links, docs = _parts(spark, sf_dir)
    path, out = f"{scratch(spark)}/links-{uuid.uuid4().hex}", []
    docs.where("doc_id in (4, 7)").select(F.lit("sources/p-18").alias("source"), F.col("slug").alias("target"), F.lit("manual").alias("type")).write.parquet(path)
    for name, place in (("there", path), ("gone", f"{path}-gone")):
        found = page_graph(hubs, links, docs, "sources/p-18", beside=lambda place=place: spark.read.parquet(place))
        own = [e for e in found["edges"] if not e[2].startswith("has_")]
        out.append((name, len(own), found["explicit_unavailable"]))
    return spark.createDataFrame(out, "name string, links long, explicit_unavailable boolean")
