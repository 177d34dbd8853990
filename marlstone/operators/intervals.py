"""Interval join: which validity intervals hold on which days, for many days at once and without comparing all with all.

Intervals fall into classes by length, each class into bins as wide as its longest interval: an interval lies in two bins of its class
at most, a day in one bin of each class. Rows meet on (class, bin), and on keys if there are any, so that the join is an ordinary
hash or merge join; the bounds are tested on what meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import registry
from .joins import VALID, relations

QUERIES, SQL, query = registry()
#: Days from the first on which an interval without an end counts as open; classes beyond it are one.
_FAR = 1 << 16


def _day(c: Column | str) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def on_days(intervals: DataFrame, days: DataFrame, keys: list[str] = (), day: str = "day") -> DataFrame:
    """Rows of intervals (valid_from, valid_to, observed_at if there is one) joined with rows of days (day) on which they hold: begun,
    not ended (an open end never ends), and observed by then. Without a beginning an interval holds on no day."""
    begin, end = _day("valid_from"), F.coalesce(_day("valid_to"), _day("valid_from") + _FAR)
    length = F.greatest(end - begin + 1, F.lit(1))
    level = F.when(F.col("valid_to").isNull(), F.lit(17)).otherwise(F.least(F.ceil(F.log2(length)), F.lit(17))).cast("int")
    rows = intervals.where("valid_from is not null and (valid_to is null or valid_to >= valid_from)").withColumn("_level", level)
    width = F.expr("shiftleft(1, _level)")
    # An open end, or one beyond the widest class, is met from its first bin on: days probe that class by the bins that there are.
    long_ = rows.where("_level >= 17")
    short = rows.where("_level < 17").withColumn("_bin", F.explode(F.sequence(F.floor(begin / width), F.floor(end / width))))
    levels = [r["_level"] for r in rows.where("_level < 17").select("_level").distinct().collect()]  # at most 17
    probe = days.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)]).cast("array<int>")))
    probe = probe.withColumn("_bin", F.floor(_day(day) / F.expr("shiftleft(1, _level)")))
    holds = (F.col("valid_from") <= F.col(day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col(day)))
    if "observed_at" in intervals.columns:
        holds = holds & F.coalesce(F.col("observed_at") <= F.col(day), F.lit(False))
    met = short.join(probe, [*keys, "_level", "_bin"]).where(holds).drop("_level", "_bin")
    if keys:
        rest = long_.drop("_level").join(days, list(keys)).where(holds)
    else:
        # Open intervals sorted into bins of days by their beginning: a day meets those of its own bin by test, those before it all.
        wide = 64
        open_ = long_.drop("_level").withColumn("_bin", F.floor(begin / wide))
        bins = open_.select("_bin").distinct()
        asked = days.withColumn("_own", F.floor(_day(day) / wide))
        reach = asked.select("_own").distinct().join(F.broadcast(bins), F.col("_bin") <= F.col("_own"))  # bins of 64 days: some thousands in all
        rest = asked.join(reach, "_own").join(open_, "_bin").where(holds).drop("_own", "_bin")
    return met.unionByName(rest.select(met.columns))


def _days(spark, sf_dir) -> DataFrame:
    from ..views import table

    return table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("day")).distinct()


@query("j18_interval_join", VALID + "SELECT day, count(*) AS relations, sum(source_id + target_id) AS checksum FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS day FROM orders) d JOIN rel ON valid_from <= day AND (valid_to IS NULL OR valid_to >= day) GROUP BY 1")
def j18(spark, sf_dir):
    """For the first day of every month with an order, the relations that hold on it."""
    held = on_days(relations(spark, sf_dir), _days(spark, sf_dir))
    return held.groupBy("day").agg(F.count("*").alias("relations"), F.sum(F.col("source_id") + F.col("target_id")).alias("checksum"))


@query(
    "j18_interval_join_keyed",
    VALID + "SELECT o_orderkey, day, l_partkey AS target_id, valid_from FROM (SELECT DISTINCT o_orderkey, CAST(o_orderdate AS DATE) AS day, l_suppkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) o JOIN rel ON source_id = l_suppkey AND target_id = l_partkey AND valid_from <= day AND (valid_to IS NULL OR valid_to >= day)",
)
def j18_keyed(spark, sf_dir):
    """For every line of an order, whether its supplier's relation to the part held on the order's day."""
    from ..views import table

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id")).distinct()
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")).join(lines, "o_orderkey")
    return on_days(relations(spark, sf_dir), asked, ["source_id", "target_id"]).select("o_orderkey", "day", "target_id", "valid_from")
