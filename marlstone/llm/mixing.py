"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed prefix sums of
token counts, and a cut at each source's exact budget; whole epochs come first when the budget exceeds the source.

All on DataFrame functions. Sums of words by source and range of the hash key tell in which range a source's budget ends;
only the rows of that one range are sorted, so that a source with a third of all rows sorts no more than one with few.
What the cut is (key, doc_id and size of the row it falls on) then goes back to the rows: texts are never shuffled.
Keys depend on doc_id alone, so reruns agree.

Defined cases: a null text has size 0; very long texts count whole; a document of size 0 takes nothing and is kept once; a
null source is a source of its own, last in order; rows of equal doc_id follow each other by size; repeated rows (equal
doc_id and size) on which the cut falls share what is left evenly, rounded down; an empty table gives an empty result.
Columns beside doc_id, text, source and those of ``keep`` are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, numbered

#: Rows aimed at in a range of the hash key; sources that may be sent to every task (a row of some 100 bytes each).
RANGE, SENT = 50_000, 200_000
WEIGHTS = (5, 2, 1)
EPOCHS = 3


def targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size): adds target. Sources share the total by weight; a target stops at epochs x its
    source, and what exceeds that is shared again by weight among the others until no target is above.

    Each round is one aggregate over the table of sources; the shares of the others only grow, so a source
    once stopped stays stopped.
    """
    ranked = cut(numbered(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_rank").drop("_null"), "ranks")
    turn = F.col("_rank") % len(weights)
    weight = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        weight = F.when(turn == i, float(w)).otherwise(weight)
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.lit(epochs) * F.col("source_size"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        stopped = (F.col("_cap") <= F.lit(level) * F.col("_w")) | (F.col("_cap") == 0)
        kept, free = ranked.agg(F.sum(F.when(stopped, F.col("_cap"))), F.sum(F.when(~stopped, F.col("_w")))).first()
        if not free:
            break
        new = (total - (kept or 0)) / free
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_w")).alias("target"))


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, epochs: int = EPOCHS, keep: tuple = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, taken (words, repeats counted), copies (whole documents) of every row.

    taken sums to the target (rounded down) in each source: floor(target / source_size) whole epochs, and of the next
    epoch the documents in key order up to the budget, the one at the cut in part. copies counts that one as whole
    when at least half of it is taken. Columns named in keep are carried along.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("_key"), *keep)
    narrow = cut(rows.select("doc_id", "source", "size", "_key"), "sizes")
    if not keep:
        rows = narrow
    sizes = cut(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")), "sources")
    aims = targets(sizes.drop("_n"), weights, epochs)
    # Whole epochs, and what is left of the budget for the epoch after them.
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    aims = aims.withColumn("_whole", whole).withColumn("_rest", F.floor("target").cast("long") - F.col("_whole") * F.col("source_size"))
    aims = cut(aims.withColumnRenamed("source", "_s"), "aims")
    own = F.col("source").eqNullSafe(F.col("_s"))
    bits = max(10, min(40, ((sizes.agg(F.max("_n")).first()[0] or 0) // RANGE).bit_length()))
    ranged = narrow.withColumn("_b", F.shiftright("_key", 64 - bits))
    sums = ranged.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(aims, own)
    # The range in which the rest ends; a source with a rest of its whole size has none.
    ending = starts.where((F.col("_start") <= F.col("_rest")) & (F.col("_rest") < F.col("_start") + F.col("_n"))).select("_s", F.col("_b").alias("_sb"), "_start", "_rest")
    inside = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.join(ending, own & (F.col("_b") == F.col("_sb")))
    each = summed.groupBy("source", "_key", "doc_id", "size", "_start", "_rest").agg(F.count("*").alias("_times"))
    upto = each.withColumn("_upto", F.col("_start") + F.sum(F.col("size") * F.col("_times")).over(inside))
    falls = (F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("size") * F.col("_times") <= F.col("_rest"))
    part = F.expr("(_rest - (_upto - size * _times)) div _times")
    cuts = upto.where(falls).select(F.col("source").alias("_cs"), F.struct("_key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "size").alias("_at"), part.alias("_part"))
    table = cut(aims.join(cuts, F.col("_s").eqNullSafe(F.col("_cs")), "left").drop("_cs"), "cuts")
    if sizes.count() <= SENT:
        table = F.broadcast(table)
    joined = rows.join(table, own)
    place = F.struct("_key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "size")
    # Without a cut the next epoch takes nothing (no rest), or all of it where the source has no words at all.
    next_ = F.when(F.col("_at").isNull() | (place > F.col("_at")), F.lit(0)).when(place == F.col("_at"), F.col("_part")).otherwise(F.col("size")).cast("long")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("_whole") + (next_ * 2 >= F.col("size")).cast("long"))
    return joined.select("doc_id", "size", "source", "source_size", "target", (F.col("_whole") * F.col("size") + next_).alias("taken"), copies.cast("long").alias("copies"), *keep)
