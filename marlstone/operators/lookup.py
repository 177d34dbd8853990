"""Title lookup through an index of letter sequences: the same ranking as a score of every page, which reads only pages that
may score at all.

A page scores if its title or slug holds the query, or some of its parts, or if the query is one of its tags. So candidates are the
pages with all short sequences of some part (three letters, or the whole of a shorter part), found in the index; the exact score
is for these only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import fuzzy
from ..functions.text import query_terms
from ..model import PAGES, pages
from ..registry import registry

QUERIES, SQL, query = registry()
P = f"WITH {PAGES} "
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    n = F.char_length(text)
    at = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(text, i, F.lit(size)))


def gram_index(docs: DataFrame) -> DataFrame:
    """gram, document_id: the sequences of one to three letters of title and slug, and whole tags (marked), each once."""
    rows = [docs.select("document_id", F.explode(F.array_distinct(F.concat(*[_grams(F.lower(c), k) for c in ("title", "slug") for k in range(1, GRAM + 1)]))).alias("gram"))]
    rows.append(docs.select("document_id", F.explode(F.array_distinct(F.transform("tags", lambda t: F.concat(F.lit("tag\t"), F.lower(t))))).alias("gram")))
    return rows[0].unionByName(rows[1])


def parts_of(q: str) -> list[str]:
    """What of a query counts: words, and pairs of neighbouring Han characters."""
    return [p for unit in query_terms(q) for p in (unit if len(unit) == 1 else ["".join(unit[i : i + 2]) for i in range(len(unit) - 1)])]


def candidates(index: DataFrame, q: str) -> DataFrame:
    """Documents that may score: with all sequences of some part of the query, or of the whole query, or with it as a tag."""
    q = " ".join(q.split()).lower()
    needs = {p: sorted({p[i : i + GRAM] for i in range(max(1, len(p) - GRAM + 1))}) for p in {*parts_of(q), q} if p}
    needs["tag\t"] = [f"tag\t{q}"]
    asked = index.where(F.col("gram").isin(sorted({g for gs in needs.values() for g in gs})))
    held = asked.groupBy("document_id").agg(F.collect_set("gram").alias("g"))  # as many as the query has sequences
    test = F.lit(False)
    for grams in needs.values():
        test = test | (F.size(F.array_except(F.array(*[F.lit(g) for g in grams]), "g")) == 0)
    return held.where(test).select("document_id")


def ranked(docs: DataFrame, index: DataFrame, q: str, limit: int = 30, least: float = 25.0) -> DataFrame:
    """document_id, score of the best pages for a query; scores below least are no hit."""
    near = docs.join(candidates(index, q), "document_id", "left_semi")
    scored = near.select("document_id", F.round(fuzzy(F.col("title"), F.col("slug"), F.col("tags"), q), 6).alias("score"))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "document_id").limit(limit)


@query(
    "f19_indexed",
    f"{P} SELECT q, document_id, score FROM (SELECT q, document_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, document_id) AS n FROM (SELECT q, document_id, round(greatest(CASE WHEN t = q THEN 100 ELSE CASE WHEN strpos(t, q) > 0 THEN 60 - least(strpos(t, q) - 1, 30) ELSE 0 END + list_sum(list_transform(w, lambda x: CAST(contains(t, x) AS INTEGER))) / len(w) * 40 END, 0.9 * (CASE WHEN slug = q THEN 100 ELSE CASE WHEN strpos(slug, q) > 0 THEN 60 - least(strpos(slug, q) - 1, 30) ELSE 0 END + list_sum(list_transform(w, lambda x: CAST(contains(slug, x) AS INTEGER))) / len(w) * 40 END), CASE WHEN list_contains(list_transform(tags, lambda x: lower(x)), q) THEN 70 ELSE 0 END), 6) AS score FROM (SELECT *, lower(title) AS t FROM pages_), (SELECT unnest(['report 1', 'src12', 'lang:de', 'p-7 zzz']) AS q, unnest([['report', '1'], ['src12'], ['lang', 'de'], ['p', '7', 'zzz']]) AS w)) WHERE score >= 25) WHERE n <= 30",
)
def f19(spark, sf_dir):
    """Four queries: words of a title, a word of some titles, a tag, a part of a slug with a word that nothing has."""
    docs = pages(spark, sf_dir).select("document_id", "title", "slug", "tags")
    index, out = gram_index(docs), None
    for q in ("report 1", "src12", "lang:de", "p-7 zzz"):
        rows = ranked(docs, index, q).select(F.lit(q).alias("q"), "document_id", "score")
        out = rows if out is None else out.unionByName(rows)
    return out
