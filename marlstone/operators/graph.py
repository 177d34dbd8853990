"""Graph operators: typed edges, budgeted breadth-first search, bipartite projections."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import registry
from ..views import DOCS, MEMBERS, documents, memberships, table
from .joins import relations, valid_on
from .windows import first_per

QUERIES, SQL, query = registry()
EDGE = ["source", "target", "type"]

EDGES = "WITH edges AS (SELECT 's' || s_suppkey AS source, 'n' || s_nationkey AS target, 'located_in' AS type FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'located_in' FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM nation) "


def edges(spark, sf_dir) -> DataFrame:
    def arm(name: str, a: str, x: str, b: str, y: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(a), x).alias("source"), F.concat(F.lit(b), y).alias("target"), F.lit(kind).alias("type"))

    return arm("supplier", "s", "s_suppkey", "n", "s_nationkey", "located_in").unionByName(arm("customer", "c", "c_custkey", "n", "c_nationkey", "located_in")).unionByName(arm("nation", "n", "n_nationkey", "r", "n_regionkey", "part_of"))


def traverse(graph: DataFrame, seed: str, depth: int = 2, max_nodes: int = 100, max_edges: int = 300, direction: str = "both") -> tuple[list[str], list[tuple], bool]:
    """Nodes, edges and whether the budget cut the walk, from one seed (``walk`` is the same for many). Edges are taken in order; one
    that would exceed a budget ends it. Direction holds on every hop.

    Each level asks Spark for max_edges + 1 edges, so what reaches the driver is bounded by the budget.
    """
    names = [c for c in (*EDGE, "provenance") if c in graph.columns]
    sides = {"outgoing": ["source"], "incoming": ["target"], "both": ["source", "target"]}[direction]
    nodes, taken, frontier, cut = {seed: None}, {}, [seed], False
    for _ in range(depth):
        if not frontier or cut:
            break
        at = reduce(or_, [F.col(s).isin(frontier) for s in sides])
        near = [tuple(r) for r in graph.select(*names).where(at).orderBy(*names).limit(max_edges + 1).collect()]
        found = []
        for edge in near:
            if edge in taken:
                continue
            new = [x for x in dict.fromkeys(edge[:2]) if x not in nodes]
            if len(taken) + 1 > max_edges or len(nodes) + len(new) > max_nodes:
                cut = True
                break
            taken[edge] = None
            nodes |= dict.fromkeys(new)
            found += new
        cut = cut or len(near) > max_edges
        frontier = found
    return list(nodes), list(taken), cut


@query("g3_bfs", EDGES + "SELECT source, target, type FROM edges WHERE source = 'n3' OR target = 'n3' OR source IN (SELECT source FROM edges WHERE target = 'n3') OR target IN (SELECT target FROM edges WHERE source = 'n3')")
def g3(spark, sf_dir):
    _, taken, _ = traverse(edges(spark, sf_dir), "n3", depth=2, max_nodes=400, max_edges=1000)
    return spark.createDataFrame(taken, "source string, target string, type string")


@query("g2_adjacent", EDGES + "SELECT source, target, type FROM edges WHERE target IN ('r1', 'n7') ORDER BY 1, 2, 3 LIMIT 101")
def g2(spark, sf_dir):
    return edges(spark, sf_dir).where(F.col("target").isin("r1", "n7")).orderBy(*EDGE).limit(101)


@query("g5_overview", EDGES + "SELECT target AS node, type, count(DISTINCT source) AS n FROM edges GROUP BY 1, 2")
def g5(spark, sf_dir):
    return edges(spark, sf_dir).groupBy(F.col("target").alias("node"), "type").agg(F.countDistinct("source").alias("n"))


@query("g6_pending", f"{DOCS} SELECT count(*) AS pending FROM docs d LEFT JOIN labels l USING (doc_id) WHERE NOT d.deleted AND l.quality IS DISTINCT FROM 1")
def g6(spark, sf_dir):
    """Live documents whose projection is missing or of another version."""
    docs = documents(spark, sf_dir).where(~F.col("deleted")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.where(~F.col("quality").eqNullSafe(F.lit(1))).agg(F.count("*").alias("pending"))


@query("g12_related_pages", MEMBERS + ", hub AS (SELECT entity_id, 2 / log2(2 + count(*)) AS w FROM members GROUP BY 1) SELECT b.document_id, round(sum(w), 9) AS score FROM members a JOIN members b ON a.entity_id = b.entity_id AND b.document_id <> a.document_id JOIN hub h ON h.entity_id = a.entity_id WHERE a.document_id = 1 GROUP BY 1 ORDER BY sum(w) DESC, 1 LIMIT 50")
def g12(spark, sf_dir):
    """Pages that share hubs with a page, weighed by how few pages a hub has."""
    members = memberships(spark, sf_dir)
    own = members.where("document_id = 1").select("entity_id")
    shared = members.join(own, "entity_id", "left_semi")
    weight = shared.groupBy("entity_id").agg((2 / F.log2(2 + F.count("*"))).alias("w"))
    score = shared.where("document_id <> 1").join(weight, "entity_id").groupBy("document_id").agg(F.sum("w").alias("s"))
    return score.orderBy(F.desc("s"), "document_id").limit(50).select("document_id", F.round("s", 9).alias("score"))


@query("g13_tag_graph", f"{DOCS}, page AS (SELECT * FROM docs WHERE NOT deleted ORDER BY published_at DESC NULLS LAST, document_id LIMIT 200) SELECT document_id, tag FROM (SELECT document_id, tag, row_number() OVER (PARTITION BY document_id ORDER BY tag) AS n FROM (SELECT document_id, unnest(tags) AS tag FROM page)) WHERE n <= 10")
def g13(spark, sf_dir):
    """The newest pages and at most ten tag edges of each."""
    pages = documents(spark, sf_dir).where(~F.col("deleted")).orderBy(F.desc_nulls_last("published_at"), "document_id").limit(200)
    return first_per(pages.select("document_id", F.explode("tags").alias("tag")), ["document_id"], ["tag"], 10)


@query("g7_related_as_of", "WITH rel AS (SELECT l_suppkey AS source_id, l_partkey AS target_id, CAST(min(l_shipdate) AS DATE) AS valid_from, CASE WHEN l_partkey % 3 <> 0 THEN CAST(max(l_shipdate) AS DATE) END AS valid_to FROM lineitem GROUP BY 1, 2) SELECT target_id, count(*) AS n FROM rel WHERE source_id IN (1, 2, 3) AND valid_from <= DATE '1997-01-01' AND (valid_to IS NULL OR valid_to >= DATE '1997-01-01') GROUP BY 1")
def g7(spark, sf_dir):
    near = relations(spark, sf_dir).where(F.col("source_id").isin(1, 2, 3)).where(valid_on("1997-01-01"))
    return near.groupBy("target_id").agg(F.count("*").alias("n"))
