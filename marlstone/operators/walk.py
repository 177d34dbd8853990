"""Budgeted walks from many seeds at once: for each level one join of all frontiers with the edges, and for each seed the longest
prefix of its edges, in order, that its budget of edges and nodes allows.

The rules are those of the single walk (``graph.traverse``): edges in order of source, target, type and provenance; a whole edge
ends the walk if it would exceed a budget; a seed that was stopped goes no further. A seed sees max_edges + 1 edges of a level at
most, which its rows are cut to before they are shuffled for the order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import registry
from ..views import table
from .retrieval import scratch

QUERIES, SQL, query = registry()
EDGE = ["source", "target", "type", "provenance"]


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A level, written: it is read several times, and ends the lineage."""
    path = f"{scratch(df.sparkSession)}/walk-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _valid(day: Column) -> Column:
    """An edge without validity columns always holds; one with them holds if begun, not ended and observed by that day."""
    known = F.col("valid_from").isNotNull() & (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)) & (F.col("observed_at") <= day)
    return day.isNull() | ~F.col("dated") | F.coalesce(known, F.lit(False))


def walk(graph: DataFrame, seeds: DataFrame, depth: int = 2, max_nodes: int = 100, max_edges: int = 300, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """(seed, level, source, target, type, provenance) of the edges that each walk takes, and (seed, nodes, edges, truncated).

    graph: source, target, type, provenance, and where relations are dated also dated (boolean), valid_from, valid_to, observed_at.
    seeds: seed, and a day if walks are as of days (null: any)."""
    dated = "dated" in graph.columns
    seeds = seeds.select("seed", (F.col("day") if "day" in seeds.columns else F.lit(None).cast("date")).alias("day")).dropDuplicates(["seed"])
    sides = {"outgoing": ["source"], "incoming": ["target"], "both": ["source", "target"]}[direction]
    visited = _kept(seeds.select("seed", F.col("seed").alias("node")), "nodes")
    frontier = seeds.select("seed", "day", F.col("seed").alias("node"))
    state = seeds.select("seed", F.lit(False).alias("stopped"), F.lit(0).alias("taken"), F.lit(1).alias("seen"))
    taken = None
    order = Window.partitionBy("seed").orderBy(*EDGE)
    for level in range(1, depth + 1):
        parts = [frontier.join(graph.withColumn("node", F.col(s)), "node") for s in sides]
        near = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        near = near.where(_valid(F.col("day"))) if dated else near
        near = near.select("seed", *EDGE).distinct() if len(parts) > 1 or level > 1 else near.select("seed", *EDGE)
        # A seed with more edges than it may take keeps one that is not taken yet: its row tells so.
        asked = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_edges + 1)
        asked = asked.withColumn("many", F.max("k").over(Window.partitionBy("seed")) > max_edges)
        fresh = asked if taken is None else asked.join(taken.select("seed", *EDGE), ["seed", *EDGE], "left_anti")
        placed = _kept(fresh.withColumn("rn", F.row_number().over(Window.partitionBy("seed").orderBy("k"))), "placed")
        ends = placed.select("seed", "rn", F.explode(F.array("source", "target")).alias("node")).join(visited, ["seed", "node"], "left_anti")
        first = ends.groupBy("seed", "node").agg(F.min("rn").alias("rn"))
        new = first.groupBy("seed", "rn").agg(F.count("*").alias("new"))
        running = F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy("seed").orderBy("rn"))
        sums = placed.join(new, ["seed", "rn"], "left").withColumn("sum", running).join(state, "seed")
        fits = (F.col("taken") + F.col("rn") <= max_edges) & (F.col("seen") + F.col("sum") <= max_nodes)
        judged = _kept(sums.withColumn("fits", fits), "judged")
        accepted = judged.where("fits")
        told = judged.groupBy("seed").agg(F.bool_or("many").alias("many"), F.count_if("fits").alias("more"), F.coalesce(F.max(F.when(F.col("fits"), F.col("sum"))), F.lit(0)).alias("nodes"), F.bool_or(~F.col("fits")).alias("cut"))
        state = state.join(told, "seed", "left")
        state = state.select("seed", (F.col("stopped") | F.coalesce("cut", F.lit(False)) | F.coalesce("many", F.lit(False))).alias("stopped"), (F.col("taken") + F.coalesce("more", F.lit(0))).cast("int").alias("taken"), (F.col("seen") + F.coalesce("nodes", F.lit(0))).cast("int").alias("seen"))
        state = _kept(state, "state")
        got = accepted.select("seed", F.lit(level).alias("level"), *EDGE)
        taken = _kept(got if taken is None else taken.unionByName(got), "taken")
        if level < depth:
            reached = _kept(first.join(accepted.select("seed", "rn"), ["seed", "rn"], "left_semi").select("seed", "node"), "reached")
            visited = visited.unionByName(reached)
            frontier = reached.join(state.where("not stopped").select("seed"), "seed", "left_semi").join(seeds, "seed").select("seed", "day", "node")
    return taken, state.select("seed", F.col("seen").alias("nodes"), F.col("taken").alias("edges"), F.col("stopped").alias("truncated"))


def links(spark, sf_dir) -> DataFrame:
    """The link table: orders and their parts, each link once, with where it is declared."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.lit("has").alias("type")).distinct()
    return _kept(rows.withColumn("provenance", F.lit("lineitem")), "links")  # every level reads it, from both ends


_LINKS = "links AS (SELECT DISTINCT 'o' || l_orderkey AS source, 'p' || l_partkey AS target FROM lineitem)"


def _capped(seeds: str, most: int) -> str:
    """Walks of three levels over links, for DuckDB: a level takes a prefix of a seed's edges in order, most in all; no cap on nodes."""
    ctes, taken, reached = [], None, f"(SELECT id AS seed, id AS node FROM ({seeds}))"
    stopped = "SELECT NULL AS seed WHERE false"
    for k in (1, 2, 3):
        before = f"SELECT * FROM t{k - 1}" if k > 1 else "SELECT NULL AS seed, NULL AS source, NULL AS target, NULL AS level WHERE false"
        ctes += [
            f"a{k} AS (SELECT * FROM (SELECT seed, source, target, row_number() OVER (PARTITION BY seed ORDER BY source, target) AS k FROM (SELECT DISTINCT f.seed, l.source, l.target FROM f{k - 1} f JOIN links l ON l.source = f.node OR l.target = f.node)) WHERE k <= {most + 1})",
            f"p{k} AS (SELECT a.seed, a.source, a.target, row_number() OVER (PARTITION BY a.seed ORDER BY a.k) + coalesce(n.n, 0) AS place FROM a{k} a LEFT JOIN (SELECT seed, count(*) AS n FROM ({before}) GROUP BY 1) n ON n.seed = a.seed WHERE NOT EXISTS (SELECT 1 FROM ({before}) t WHERE t.seed = a.seed AND t.source = a.source AND t.target = a.target))",
            f"s{k} AS ({stopped} UNION SELECT seed FROM a{k} WHERE k > {most} UNION SELECT seed FROM p{k} WHERE place > {most})",
            f"t{k} AS ({before} UNION ALL SELECT seed, source, target, {k} FROM p{k} WHERE place <= {most})",
            f"v{k} AS (SELECT seed, source AS node FROM t{k} UNION SELECT seed, target FROM t{k} UNION SELECT seed, node FROM f0)",
            f"f{k} AS (SELECT * FROM v{k} WHERE seed NOT IN (SELECT seed FROM s{k}) AND (seed, node) NOT IN (SELECT seed, node FROM v{k - 1}))",
        ]
        stopped = f"SELECT seed FROM s{k}"
    return f"WITH {_LINKS}, f0 AS {reached}, v0 AS (SELECT * FROM f0), " + ", ".join(ctes)


@query("g10_link_neighbourhood", _capped("SELECT 'o1' AS id", 2000) + " SELECT source, target, 'has' AS type, level FROM t3")
def g10(spark, sf_dir):
    """Edges of a link table around a page, up to three hops, with the cap on edges."""
    seeds = spark.createDataFrame([("o1",)], "seed string")
    return walk(links(spark, sf_dir), seeds, 3, 1_000_000, 2000)[0].select("source", "target", "type", "level")


@query("g3_many_seeds", _capped("SELECT DISTINCT 'p' || p_partkey AS id FROM part WHERE p_partkey % 50 = 0", 40) + " SELECT seed, count(*) AS edges, max(level) AS depth, seed IN (SELECT seed FROM s3) AS truncated FROM t3 GROUP BY 1, 4")
def g3_many(spark, sf_dir):
    """Walks of three levels and forty edges from every fiftieth part, in one plan."""
    seeds = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("seed"))
    taken, told = walk(links(spark, sf_dir), seeds, 3, 1_000_000, 40)
    return taken.groupBy("seed").agg(F.count("*").alias("edges"), F.max("level").alias("depth")).join(told.select("seed", "truncated"), "seed")
