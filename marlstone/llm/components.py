"""Connected components of a link table by alternating stars, with a local forest per partition first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, fingerprint


def _forest(batches):
    """Union-find over the links of one partition; one link per node and root leaves it."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in list(root)]
    pairs = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
    for i in range(0, len(pairs), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 100_000, 0]), pa.array(pairs[i : i + 100_000, 1])], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the two columns of links; component is the smallest node reachable.

    Each round does a large star and a small star. Minima are aggregated before the join, so a node with very
    many links is one row on one side and a side that adaptive execution may split on the other. Ends when the
    stars no longer change. The joins are by shuffle: tables of links are far larger in memory than on disk, and a
    side sent to all tasks is built on the driver. Null ends and loops are ignored; an empty table gives an empty result.
    """
    a, b = links.columns[:2]
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    edges = cut(links.mapInArrow(_forest, "u long, v long").distinct(), "links")
    before = fingerprint(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        used, edges = edges, cut(small.distinct(), "small")
        discard(used, large)
        after = fingerprint(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
