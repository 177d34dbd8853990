"""Edges at nodes: none is left out, however many a node has."""

from pyspark.sql import functions as F

from marlstone.operators.networks import adjacent


def test_every_edge_at_a_node(spark):
    """A node with 1,200 edges in and 900 out, of which one is a loop; others are not at it."""
    n = F.col("id").cast("string")
    into = spark.range(1200).select(F.concat(F.lit("a"), n).alias("source"), F.lit("x").alias("target"))
    out = spark.range(899).select(F.lit("x").alias("source"), F.concat(F.lit("b"), n).alias("target"))
    loop = spark.range(1).select(F.lit("x").alias("source"), F.lit("x").alias("target"))
    other = spark.range(50).select(F.concat(F.lit("c"), n).alias("source"), F.lit("y").alias("target"))
    graph = into.union(out).union(loop).union(other).select("source", "target", F.lit("t").alias("type"), F.lit("p").alias("provenance"))
    found = [(r["source"], r["target"]) for r in adjacent(graph, ["x"]).collect()]
    assert len(found) == 2100 and found == sorted(set(found))
    assert adjacent(graph, ["x"], "incoming").count() == 1201 and adjacent(graph, ["x"], "outgoing").count() == 900
