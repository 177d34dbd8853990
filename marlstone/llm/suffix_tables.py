"""The difference-cover suffix sort over tables: a row for each position, every sort a range sort of the cluster.

Sampled triples (positions not divisible by 3) are sorted and named; the names are a text a third shorter, which is sorted the same
way until names reach deep enough; the other suffixes are sorted by their first symbol and the rank behind it, and merged in by two
more sorts; equal prefixes stand side by side then, and a class's least document decides.

This is the method of ``passages`` in its distributed form, kept to measure it: each level sorts seven tables of some forty bytes a
position. README has the figures; ``passages`` sorts within buckets instead, with the same results (the tests hold both to brute force).

Defined cases: as in ``passages``; doc_ids must be unique and not null here.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered


def _bytes(width: int):
    """Rows of every byte: owner, place in it, symbol, and the window of width bytes from there (null if it does not fit)."""

    def run(batches):
        for batch in batches:
            for owner, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = (text or "").encode()
                for k in range(0, len(raw), 50_000):
                    at = range(k, min(k + 50_000, len(raw)))
                    windows = [raw[i : i + width] if i + width <= len(raw) else None for i in at]
                    yield pa.RecordBatch.from_arrays([pa.array([owner] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(list(raw[k : k + 50_000]), pa.int64()), pa.array(windows, pa.binary())], ["owner", "at", "c", "window"])

    return run


def _shifted(table: DataFrame, column: str, by: int) -> DataFrame:
    return table.select((F.col("pos") - by).alias("pos"), F.col(column).alias(f"{column}{by}"))


def order(text: DataFrame, depth: int) -> DataFrame:
    """pos and place of every suffix of a text (pos from 0, c above 0), in order of their first depth symbols."""
    here = cut(text.select("pos", F.col("c").alias("c0")).join(_shifted(text, "c", 1), "pos", "left").join(_shifted(text, "c", 2), "pos", "left").na.fill(0), "triples")
    sample = here.where("pos % 3 <> 0")
    names = cut(numbered(sample.select("c0", "c1", "c2").distinct(), ["c0", "c1", "c2"], "name"), "names")
    named = cut(sample.join(names, ["c0", "c1", "c2"]).select("pos", (F.col("name") + 1).alias("name")), "named")
    n, rows = names.count(), named.count()
    if n < rows and depth > 3:  # the names' text: first the positions 1, 4, ..., a gap, then 2, 5, ...
        ones = named.where("pos % 3 = 1").count()
        place = F.when(F.col("pos") % 3 == 1, F.expr("pos div 3")).otherwise(F.expr("pos div 3") + ones + 1)
        moved = named.select("pos", place.alias("new"), "name")
        inner = order(moved.select(F.col("new").alias("pos"), F.col("name").alias("c")), -(-depth // 3))
        ranked = moved.join(inner.select(F.col("pos").alias("new"), "place"), "new").select("pos", F.col("place").alias("name"))
    else:
        ranked = named
    rank = cut(numbered(ranked, ["name", "pos"], "place").select("pos", "place", (F.col("place") + 1).alias("r")), "ranks")
    whole = cut(here.join(_shifted(rank, "r", 1), "pos", "left").join(_shifted(rank, "r", 2), "pos", "left").na.fill(0), "keys")
    zero = whole.where("pos % 3 = 0")
    out, below = None, numbered(zero, ["c0", "r1", "pos"], "i").select("pos", "i")
    zeros = cut(below, "zeros")
    for kind, keys in ((1, ["c0", "r1"]), (2, ["c0", "c1", "r2"])):
        other = whole.where(F.col("pos") % 3 == kind)
        both = cut(numbered(zero.union(other).withColumn("kind", F.col("pos") % 3), [*keys, "kind", "pos"], "u").select("pos", "kind", "u"), "merged")
        # In the union, a row's place less its place among its own is how many of the others come before it.
        own = cut(numbered(other.join(rank.select("pos", "place"), "pos").select("pos", "place"), [*(["place"]), "pos"], "i"), "own")
        late = both.where(F.col("kind") == kind).join(own, "pos").select("pos", (F.col("place") + F.col("u") - F.col("i")).alias("place"))
        out = late if out is None else out.union(late)
        early = both.where("kind = 0").join(zeros, "pos").select("pos", (F.col("u") - F.col("i")).alias(f"b{kind}"))
        below = below.join(early, "pos")
    return cut(out.union(below.select("pos", (F.col("i") + F.col("b1") + F.col("b2")).alias("place"))), "places")


def covered(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id and at of every window that also starts in a document with a smaller doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_bytes(width), "owner long, at long, c long, window binary")
    placed = cut(numbered(cut(rows, "bytes"), ["owner", "at"], "pos"), "positions")
    places = order(placed.select("pos", (F.col("c") + 1).alias("c")), width)
    windows = placed.where("window is not null").join(places, "pos").select("owner", "at", "window", "place")
    # Adjacent prefixes: a class begins where a window differs from the one before it; its number is a prefix sum of beginnings.
    placed = cut(numbered(windows, ["place"], "n"), "ordered")
    before = placed.select((F.col("n") + 1).alias("n"), F.col("window").alias("last"))
    begun = cut(placed.join(before, "n", "left").select("n", "owner", "at", (~F.col("window").eqNullSafe(F.col("last"))).alias("new")), "begun")
    heads = numbered(begun.where("new").select("n"), ["n"], "class")
    ends = heads.select("class", F.col("n").alias("first")).join(heads.select((F.col("class") - 1).alias("class"), F.col("n").alias("next")), "class", "left")
    # Rows find their class by range: both sides are cut into ranges of 4096 places, a class stands in each that it meets.
    span = 4096
    last = F.coalesce("next", F.lit(begun.count())) - 1
    spread = ends.select("class", "first", last.alias("last")).withColumn("range", F.explode(F.sequence(F.expr(f"first div {span}"), F.expr(f"last div {span}"))))
    classed = begun.withColumn("range", F.expr(f"n div {span}")).join(spread, "range").where("n between first and last").select("class", "owner", "at")
    least = classed.groupBy("class").agg(F.min("owner").alias("least"))
    return classed.join(least, "class").where("owner > least").select(F.col("owner").alias("doc_id"), "at")
