"""Many patterns in texts against contains, related pages against all pairs, title lookup against the score of every page."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions.strings import fuzzy
from marlstone.operators.lookup import gram_index, ranked
from marlstone.operators.patterns import found_in
from marlstone.operators.related import related


@pytest.mark.parametrize("shard", [1 << 20, 200])
def test_patterns(spark, shard):
    """One automaton or several give what contains gives: overlapping, nested, repeated, one-letter, non-ASCII, absent, empty ones."""
    r = random.Random(2)
    texts = [(k, "".join(r.choice("abé ") for _ in range(r.randint(0, 40)))) for k in range(120)] + [(200, None), (201, ""), (202, "ab\nab")]
    patterns = {"".join(r.choice("abé ") for _ in range(r.randint(1, 4))) for _ in range(60)} | {"", "zz", "b\na", "é"}
    rows = spark.createDataFrame(texts, "id long, text string").withColumn("clash", F.lit("x"))
    asked = spark.createDataFrame([(p,) for p in patterns] + [("é",), (None,)], "pattern string")
    got = [(x["id"], x["pattern"]) for x in found_in(rows, asked, ["id"], shard=shard).collect()]
    want = {(i, p) for i, t in texts for p in patterns if p and t and p in t}
    assert len(got) == len(set(got)) and set(got) == want
    assert found_in(rows.where("false"), asked, ["id"]).count() == 0 and found_in(rows, asked.where("false"), ["id"]).count() == 0


@pytest.mark.parametrize("k", [3, 8])
def test_related_is_all_pairs(spark, k):
    """Heavy hubs are never expanded, and the best k of every page are those of all pairs, ties by date and slug."""
    r = random.Random(k)
    pages = [(f"p{n:02d}", f"2024-0{r.randint(1, 4)}") for n in range(60)]
    links = {(s, h) for s, _ in pages for h in r.sample(["big1", "big2", "big3"], r.randint(0, 2))} | {(s, f"small{r.randint(0, 25)}") for s, _ in pages for _ in range(r.randint(0, 2))}
    size = {h: sum(x == h for _, x in links) for _, h in links}
    index = spark.createDataFrame([(s, h, "entity" if h.endswith("3") else "tag", size[h]) for s, h in sorted(links)], "slug string, hub string, kind string, pages long")
    got = related(index, spark.createDataFrame(pages, "slug string, updated_at string"), k).collect()
    import math

    of = {s: {h for x, h in links if x == s} for s, _ in pages}
    worth = lambda h: (2 if h.endswith("3") else 1) / math.log2(2 + size[h])
    day, want = dict(pages), set()
    for s, _ in pages:
        scored = [(round(sum(worth(h) for h in of[s] & of[o]), 9), o) for o, _ in pages if o != s and of[s] & of[o]]
        best = sorted(sorted(scored, key=lambda x: x[1]), key=lambda x: (x[0], day[x[1]]), reverse=True)
        best = sorted(scored, key=lambda x: (-x[0], [-ord(c) for c in day[x[1]]], x[1]))[:k]
        want |= {(s, o, w) for w, o in best}
    assert {(x["slug"], x["other"], x["score"]) for x in got} == want and len(got) == len(want)


def test_lookup_is_the_full_ranking(spark):
    r = random.Random(4)
    words = ["Report", "Zinsen", "加息", "alpha", "beta", "x1", "Q"]
    rows = [(f"d{n}", " ".join(r.choices(words, k=3)), f"wiki/{r.choice(words).lower()}-{n}", [r.choice(words)]) for n in range(150)]
    docs = spark.createDataFrame(rows, "document_id string, title string, slug string, tags array<string>")
    index = gram_index(docs)
    for q in ("report", "Zinsen alpha", "加息", "q", "x1 nothing", "beta-7", "nowhere"):
        want = docs.select("document_id", F.round(fuzzy(F.col("title"), F.col("slug"), F.col("tags"), q), 6).alias("score")).where("score >= 25").orderBy(F.desc("score"), "document_id").limit(20)
        assert [tuple(x) for x in ranked(docs, index, q, 20).collect()] == [tuple(x) for x in want.collect()], q
