"""Sharding: the smallest feasible shard capacity over ordered atomic groups, by binary search with greedy checks.

Groups are rows of equal text; they are ordered by a 64-bit hash of the text, so that a row knows its place in the
order by itself: no join brings the cuts back, and a group that holds a third of all rows is still cut-free and
spread over tasks. The smallest capacity for which greedy filling needs at most ``n_shards`` shards is found by bisection.

Greedy filling asks only "what is the last prefix sum of group sizes at or below x". The driver holds sums of cells, ranges
of the hash order (``CELLS`` at most), which bound every answer from both sides: most capacities are settled by
them alone. Only cells in which an open answer lies are split further, by one aggregate over their rows, until those
cells are single groups and the answers exact. The driver sees sums of cells, never groups or rows.

Defined cases: a null text has size 1 (no bytes, plus one), the CRC of no bytes, and is grouped with the other null
texts; very long texts count whole; an empty table gives an empty result; repeated rows are all placed; rows of equal doc_id
are numbered in any order among themselves. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Cells that one aggregate may bring to the driver, in bits, and those of the first.
CELLS, FIRST = 17, 12
#: Rows aimed at in a part of a shard, within which slots are numbered.
PART = 100_000


def _cells(rows: DataFrame, depth: int, within: list[int] | None = None, before: int = 0) -> dict[int, tuple[int, int, int]]:
    """Size, least and greatest hash of each cell: hashes that agree in their first depth bits (of the cells within, if given)."""
    if within is not None:
        rows = rows.where(F.shiftright("h", 64 - before).isin(within))
    found = rows.groupBy((F.shiftright("h", 64 - depth) if depth < 64 else F.col("h")).alias("cell")).agg(F.sum("size").alias("size"), F.min("h").alias("least"), F.max("h").alias("most"))
    return {r["least"]: (r["size"], r["most"], r["cell"]) for r in found.collect()}


def capacity(rows: DataFrame, n_shards: int) -> tuple[int, list[int], list[int]]:
    """The smallest capacity with which greedy filling of rows (h, size) reaches the end in n_shards; the hashes after which
    it ends a shard, and the prefix sums there. A shard that stays empty has no cut."""
    depth, cells = FIRST, _cells(rows, FIRST)
    low, high = 0, sum(c[0] for c in cells.values())  # a capacity that fails, one that holds
    if not cells:
        return 0, [], []
    while True:
        order = sorted(cells)
        upto = [0, *accumulate(cells[h][0] for h in order)]
        single = [h == cells[h][1] for h in order]
        total = upto[-1]

        def last(x: int, least: bool) -> int:
            """Bounds of the last prefix sum at or below x."""
            if x >= total:
                return total
            k = bisect_right(upto, x) - 1
            return upto[k] if least or single[k] else x

        def ends(c: int, least: bool) -> list[int]:
            out = [0]
            for _ in range(n_shards):
                out.append(last(out[-1] + c, least))
            return out

        def smallest(low: int, high: int, good) -> int:
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (low, middle) if good(middle) else (middle, high)
            return high

        high = smallest(low, high, lambda c: ends(c, True)[-1] == total)
        low = smallest(low, high, lambda c: ends(c, False)[-1] == total) - 1
        floor, ceiling = ends(low + 1, True), ends(high, False)
        if low + 1 == high and floor == ceiling:
            break
        # Cells in which an end of an open capacity may lie.
        wanted = set()
        for a, b in zip(floor[:-1], ceiling[:-1]):
            i, j = bisect_right(upto, a + low + 1) - 1, bisect_right(upto, b + high) - 1
            wanted.update(k for k in range(i, min(j, len(order) - 1) + 1) if not single[k])
        more = min(64 - depth, max(1, CELLS - len(wanted).bit_length()))
        split = [order[k] for k in wanted]
        fresh = _cells(rows, depth + more, [cells[h][2] for h in split], depth)
        for h in split:
            del cells[h]
        depth += more
        # Cells that were not split keep their place; they are never asked for again.
        cells |= fresh
    at = {s: cells[h][1] for s, h in zip(upto[1:], order)}
    cuts = [e for e in dict.fromkeys(floor[1:]) if 0 < e < total]
    return high, [at[e] for e in cuts], cuts


def shard(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, capacity of every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("h")), "rows")
    most, hashes, _ = capacity(rows.select("h", "size"), n_shards)
    number = F.lit(0)
    for h in hashes:
        number = number + (F.col("h") > F.lit(h)).cast("int")
    parts = max(16, rows.count() // PART)
    placed = rows.withColumn("shard", number.cast("int")).withColumn("part", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "h"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row for each PART rows or so
    inside = Window.partitionBy("shard", "part").orderBy("doc_id")
    return placed.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.lit(most).cast("long").alias("capacity"),
    )
