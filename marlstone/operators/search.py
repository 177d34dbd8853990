"""Lexical search over blocks, phrase adjacency, vector rerank within the shortlist, rank fusion, diversification."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import registry
from ..views import DOCS, documents, table
from .segments import recalled
from .windows import first_per

QUERIES, SQL, query = registry()
RRF = 60
#: Words of each block of a text (the supplied texts have no marks, so that a block is a slice), and of all blocks, for DuckDB.
_TB = "list_transform(range(CAST(ceil(length(text) / 1800.0) AS BIGINT)), lambda k: regexp_extract_all(lower(substr(text, CAST(1800 * k + 1 AS BIGINT), 1800)), '\\p{Nd}+(?:[.,]\\p{Nd}+)+|[\\p{L}\\p{M}\\p{N}_]+(?:[''’][\\p{L}\\p{M}\\p{N}_]+)*'))"
_T = f"flatten({_TB})"


def _bodies(spark, sf_dir, words: list[str]) -> DataFrame:
    """Postings of words in texts, from the projection."""
    from .retrieval import index

    return index(spark, sf_dir).lookup(words).where(F.col("ordinal") >= 0)


def _live(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).where(~F.col("deleted")).select("document_id")


@query("x1_lexical_all", f"{DOCS} SELECT document_id FROM docs WHERE NOT deleted AND list_has_all({_T}, ['the', 'and', 'with'])")
def x1(spark, sf_dir):
    """All terms, from the lexeme projection: no text is read."""
    words = ["the", "and", "with"]
    return recalled(_bodies(spark, sf_dir, words), [[w] for w in words], "all").join(_live(spark, sf_dir), "document_id", "left_semi")


@query("x2_any_fallback", f"{DOCS} SELECT document_id, 'any' AS lexical_match FROM docs WHERE NOT deleted AND list_has_any({_T}, ['con', 'zzzzzz'])")
def x2(spark, sf_dir):
    """All terms first; any of them only if no document has all."""
    words = ["con", "zzzzzz"]
    found, match = _bodies(spark, sf_dir, words), "all"
    hits = recalled(found, [[w] for w in words], match).join(_live(spark, sf_dir), "document_id", "left_semi")
    if hits.isEmpty():
        match = "any"
        hits = recalled(found, [[w] for w in words], match).join(_live(spark, sf_dir), "document_id", "left_semi")
    return hits.select("document_id", F.lit(match).alias("lexical_match"))


@query("x3_phrase", f"{DOCS} SELECT document_id FROM docs WHERE len(list_filter({_TB}, lambda t: contains(' ' || array_to_string(t, ' ') || ' ', ' of the '))) > 0")
def x3(spark, sf_dir):
    """Words that follow each other in one block, by their positions in the postings."""
    return recalled(_bodies(spark, sf_dir, ["of", "the"]), [["of", "the"]], "all")


@query("x1_shortlist", f"{DOCS} SELECT document_id, score FROM (SELECT document_id, CASE WHEN list_has_all({_T}, ['the', 'for']) THEN 0.1 ELSE 0 END + CASE WHEN contains(lower(title), 'src1') THEN 8 + 4 ELSE 0 END AS score FROM docs WHERE NOT deleted) WHERE score > 0 ORDER BY score DESC, document_id LIMIT 120")
def x1_shortlist(spark, sf_dir):
    """Body recall weighs 0.1, a title that holds the query 12; scores add up; a bounded shortlist."""
    docs = documents(spark, sf_dir).where(~F.col("deleted"))
    body = recalled(_bodies(spark, sf_dir, ["the", "for"]), [["the"], ["for"]], "all").select("document_id", F.lit(0.1).alias("s"))
    head = docs.where(F.contains(F.lower("title"), F.lit("src1"))).select("document_id", F.lit(12.0).alias("s"))
    score = body.unionByName(head).groupBy("document_id").agg(F.sum("s").alias("score"))
    return score.join(docs.select("document_id"), "document_id", "left_semi").orderBy(F.desc("score"), "document_id").limit(120)


def cosine(v: Column, q: list[float]) -> Column:
    """Cosine of a vector column with a constant vector, in double precision, without leaving the JVM."""
    norm = math.sqrt(sum(x * x for x in q))
    target = F.array(*[F.lit(float(x)) for x in q])
    dot = F.aggregate(F.zip_with(v, target, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (length * norm)


def rerank(chunks: DataFrame, q: list[float], limit: int) -> DataFrame:
    """Chunks of the shortlist by similarity to q; dimensions must agree."""
    return chunks.where(F.size("embedding") == len(q)).withColumn("score", cosine(F.col("embedding"), q)).orderBy(F.desc("score"), "vec_id").limit(limit)


@query("x4_vector_rerank", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, q WHERE label IN (1, 2, 3) ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) DESC, vec_id LIMIT 20")
def x4(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    q = vectors.where("vec_id = 0").first()["embedding"]
    return rerank(vectors.where(F.col("label").isin(1, 2, 3)), q, 20).select("vec_id", F.round("score", 6).alias("score"))


def diversify(ranked: DataFrame, group: str, k: int, order: list[Column]) -> DataFrame:
    """At most k rows of each group, the best first."""
    return first_per(ranked, [group], order, k)


@query("x8_diversify", f"{DOCS} SELECT document_id, family_id FROM (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY n_chars DESC, doc_id) AS n FROM docs WHERE contains(lower(text), 'the')) WHERE n <= 1")
def x8(spark, sf_dir):
    found = documents(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("the")))
    return diversify(found, "family_id", 1, [F.desc("n_chars"), F.asc("doc_id")]).select("document_id", "family_id")


@query("x10_empty_reason", f"{DOCS} SELECT CASE WHEN count(*) = 0 THEN 'no_documents_match_filters' WHEN count(*) FILTER (WHERE contains(text, 'zzzzzz')) = 0 THEN 'no_match_in_searched_text' END AS reason FROM docs WHERE lang = 'de'")
def x10(spark, sf_dir):
    docs = documents(spark, sf_dir).where("lang = 'de'")
    hits = F.count_if(F.contains("text", F.lit("zzzzzz")))
    return docs.agg(F.when(F.count("*") == 0, "no_documents_match_filters").when(hits == 0, "no_match_in_searched_text").alias("reason"))
