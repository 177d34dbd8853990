"""Related pages of all pages at once: the best k by the hubs that two pages share, without expanding heavy hubs into their pairs.

A hub is heavy beyond the square root of the number of pages. Pairs are made through light hubs only; what the two pages' heavy
hubs are worth together is added from their signatures (the sets of heavy hubs, few in number). A page that shares no light hub
with another is worth no more than the heavy hubs alone, the same for all pages of one signature: so for each signature the best k
of every other signature stand for all of it. Where a page's k-th light pair is worth more than all of its heavy hubs, these are
not probed at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import MODEL, entities, pages
from ..registry import registry
from .mentions import mentions, resolved
from .networks import _HUBS, hub_index
from .retrieval import scratch
from .windows import first_per

QUERIES, SQL, query = registry()


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = f"{scratch(df.sparkSession)}/related-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def related(index: DataFrame, docs: DataFrame, k: int = 50, hubs: int = 32) -> DataFrame:
    """slug, other, score: for each page its best k others by shared hubs. index: slug, hub, kind, pages; docs: slug, updated_at. A page
    shows hubs of its own, entities first, then the rarer; a shared hub is worth 1 (an entity 2) over log2 of 2 plus its pages. Ties:
    the later change, then the slug."""
    n = docs.count()
    weight = F.when(F.col("kind") == "entity", 2).otherwise(1) / F.log2(2 + F.col("pages"))
    links = first_per(index, ["slug"], [F.desc(F.col("kind") == "entity"), "pages", "hub"], hubs).join(docs.select("slug", "updated_at"), "slug")
    links = _kept(links.select("slug", "hub", weight.alias("w"), (F.col("pages") * F.col("pages") > n).alias("heavy"), "updated_at"), "links")
    light, heavy = links.where("not heavy"), links.where("heavy")
    # Signatures: their heavy hubs with the weights, and each page's signature.
    sets = heavy.groupBy("slug", "updated_at").agg(F.sort_array(F.collect_list(F.struct("hub", "w"))).alias("set"))
    signed = _kept(sets.withColumn("sig", F.xxhash64("set.hub")), "signed")
    kinds = _kept(signed.groupBy("sig").agg(F.first("set").alias("set")), "kinds")
    each = kinds.select("sig", F.explode("set").alias("h")).select("sig", "h.hub", "h.w")
    worth = _kept(each.join(each.select(F.col("sig").alias("other_sig"), "hub"), "hub").groupBy("sig", "other_sig").agg(F.sum("w").alias("both")), "worth")
    # Pairs through light hubs, with what their signatures share.
    near = light.select("slug", "hub", "w").join(light.select(F.col("slug").alias("other"), "hub", F.col("updated_at").alias("changed")), "hub").where("slug <> other")
    near = near.groupBy("slug", "other", "changed").agg(F.sum("w").alias("part"))
    sig = signed.select("slug", "sig")
    near = near.join(sig, "slug", "left").join(sig.toDF("other", "other_sig"), "other", "left").join(worth, ["sig", "other_sig"], "left")
    order = [F.desc(F.round("score", 9)), F.desc("changed"), "other"]
    near = near.select("slug", "other", "changed", (F.col("part") + F.coalesce("both", F.lit(0.0))).alias("score"))
    near = _kept(first_per(near, ["slug"], order, k), "near")
    # Pages whose k-th light pair may be beaten by a page that shares heavy hubs only.
    bound = signed.select("slug", "sig", F.aggregate("set", F.lit(0.0), lambda a, x: a + x["w"]).alias("most"))
    full = near.groupBy("slug").agg(F.count("*").alias("have"), F.min("score").alias("least"))
    open_ = bound.join(full, "slug", "left").where((F.coalesce("have", F.lit(0)) < k) | (F.round("least", 9) <= F.round("most", 9)))
    best = first_per(signed.select("sig", F.col("slug").alias("other"), F.col("updated_at").alias("changed")), ["sig"], [F.desc("changed"), "other"], k + 1)
    offers = worth.join(open_.select("sig").distinct(), "sig", "left_semi").join(best.withColumnRenamed("sig", "other_sig"), "other_sig").select("sig", "other", "changed", F.col("both").alias("score"))
    offers = _kept(first_per(offers, ["sig"], order, k + 1), "offers")  # k + 1: the page itself is among them
    far = open_.select("slug", "sig").join(offers, "sig").where("slug <> other").select("slug", "other", "changed", "score")
    every = near.unionByName(far).groupBy("slug", "other", "changed").agg(F.max("score").alias("score"))
    return first_per(every, ["slug"], order, k).select("slug", "other", F.round("score", 9).alias("score"))


@query(
    "g12_all_neighbourhoods",
    _HUBS + ", pair_ AS (SELECT a.slug, b.slug AS other, round(sum(CASE WHEN a.kind = 'entity' THEN 2 ELSE 1 END / log2(2 + a.pages)), 9) AS score FROM sized_ a JOIN sized_ b ON a.hub = b.hub AND a.slug <> b.slug GROUP BY 1, 2) SELECT slug, other, score FROM (SELECT p.*, row_number() OVER (PARTITION BY p.slug ORDER BY score DESC, updated_at DESC, other) AS n FROM pair_ p JOIN pages_ d ON d.slug = p.other) WHERE n <= 10",
)
def g12_all(spark, sf_dir):
    """The ten pages nearest to each page by the hubs they share."""
    docs = pages(spark, sf_dir)
    return related(hub_index(docs, resolved(mentions(docs), entities(spark, sf_dir))), docs, 10)
