"""Search over the lexical projection: recall in bodies and headers, a filtered shortlist, ranked passages, vectors within the
shortlist, fusion, diversification, entity-aware search, explanations.

The projection (``segments``) is kept as tables and brought up to date by revision, so that a query reads its terms' postings and
no text; blocks are read for a bounded shortlist only. Passages are ranked by cover density: the shorter the spans that hold all
words, the better (numbers are not those of another engine, order and constants are).
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_terms, terms
from ..model import BLOCKS, MODEL, PAGES, blocks, entities, pages
from ..registry import registry
from ..views import table
from .filters import apply_filter
from .mentions import mentions, resolved
from .search import cosine
from .segments import HEADER, Projection, covered, recalled
from .windows import first_per

QUERIES, SQL, query = registry()
P = f"WITH {PAGES} "
B = f"WITH {PAGES}, {BLOCKS} "
_TERM = "'\\p{Nd}+(?:[.,]\\p{Nd}+)+|[\\p{L}\\p{M}\\p{N}_]+(?:[''’][\\p{L}\\p{M}\\p{N}_]+)*'"
#: Of each session and corpus: its projection, and what its files looked like when it was last brought up to date.
_KEPT: dict[str, tuple[Projection, int]] = {}
_LOCK = threading.Lock()


def scratch(spark: SparkSession) -> str:
    """A folder for tables of this session: the shared one, or on one machine a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, "marlstone")


def projection(docs: DataFrame) -> DataFrame:
    """document_id, revision_id, lexemes: the distinct words of each text, sorted."""
    return docs.select("document_id", "revision_id", F.array_sort(F.array_distinct(terms(F.coalesce("text", F.lit(""))))).alias("lexemes"))


def _files(spark: SparkSession, path: str) -> int:
    """A checksum of the names, sizes and times of a table's files; nothing of them is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()[0] or 0


def index(spark: SparkSession, sf_dir: str) -> Projection:
    """The projection of a corpus: built once a session, and refreshed by revision when the files of the documents have changed."""
    key, files = f"{spark.sparkContext.applicationId}|{sf_dir}", _files(spark, f"{sf_dir}/documents.parquet")
    with _LOCK:
        if key not in _KEPT:
            _KEPT[key] = (Projection.create(spark, f"{scratch(spark)}/lexical-{uuid.uuid4().hex}"), 0)
        kept, seen = _KEPT[key]
        if seen != files:
            kept.refresh(pages(spark, sf_dir))
            _KEPT[key] = (kept, files)
        return kept


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of documents' first blocks: document_id, ordinal, vec_id, embedding."""
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("doc:"), "vec_id").alias("document_id"), F.lit(0).alias("ordinal"), "vec_id", "embedding")


class Lexical:
    """One lexical search: shortlist (document_id, score), passages, and how it matched. Without a limit all matches are the shortlist."""

    def __init__(self, spark: SparkSession, sf_dir: str, q: str, filters: dict | None = None, limit: int | None = 120, match: str = "all", docs: DataFrame | None = None):
        self.spark, self.sf_dir, self.q, self.units, self.limit = spark, sf_dir, q, query_terms(q), limit
        self.words = sorted({w for u in self.units for w in u})
        self.index, docs = index(spark, sf_dir), pages(spark, sf_dir).where(~F.col("deleted")) if docs is None else docs
        self.docs, self.found = docs, self.index.lookup(self.words)
        heads = self.found.where(F.col("ordinal") == HEADER)
        body = recalled(self.found.where(F.col("ordinal") >= 0), self.units, match)
        title = docs.select("document_id", F.contains(F.lower("title"), F.lit(q.lower())).alias("whole"))
        in_header = recalled(heads, self.units, match).select("document_id", F.lit(True).alias("_h"))
        near = covered(heads, self.words).select("document_id", "density")
        held = title.join(in_header, "document_id", "left").where(F.col("whole") | F.col("_h").isNotNull()).join(near, "document_id", "left")
        self.header = held.select("document_id", (4 + F.coalesce("density", F.lit(0.0)) + F.when(F.col("whole"), 8).otherwise(0)).alias("score"))
        hits = body.select("document_id", F.lit(0.1).alias("score")).unionByName(self.header)
        score = hits.groupBy("document_id").agg(F.sum("score").alias("score"))
        self.matched = score.join(apply_filter(docs, filters).select("document_id"), "document_id", "left_semi")
        self.total, self._top = None, None

    @property
    def shortlist(self) -> DataFrame:
        ranked = self.matched.orderBy(F.desc("score"), "document_id")
        return ranked if self.limit is None else ranked.limit(self.limit)

    def top(self) -> list[tuple[str, float]]:
        """The shortlist's rows, limit at most, and beside them how many documents were matched before the limit: one job."""
        if self._top is None:
            seen = Observation()
            counted = self.matched.observe(seen, F.count("*").alias("n"))
            self._top = [tuple(r) for r in counted.orderBy(F.desc("score"), "document_id").limit(self.limit or 300).collect()]
            self.total = seen.get["n"]
        return self._top

    def blocks(self) -> DataFrame:
        """Blocks of the shortlist, from the store: row groups without its documents are not read."""
        return self.index.blocks([i for i, _ in self.top()])

    def passages(self, most: int = 3) -> DataFrame:
        """document_id, ordinal, score, channel: the best blocks of each shortlisted document, and its header as a candidate."""
        ids = self.spark.createDataFrame([(i,) for i, _ in self.top()], "document_id string")
        near = covered(self.found.where(F.col("ordinal") >= 0).join(F.broadcast(ids), "document_id", "left_semi"), self.words)
        whole = self.blocks().select("document_id", "ordinal", F.contains(F.lower("text"), F.lit(self.q.lower())).cast("int").alias("whole"))
        lexical = near.join(whole, ["document_id", "ordinal"]).select("document_id", "ordinal", (F.col("density") + F.col("whole")).alias("score"), F.lit("lexical").alias("channel"))
        head = self.header.join(F.broadcast(ids), "document_id", "left_semi").select("document_id", F.lit(0).alias("ordinal"), "score", F.lit("metadata").alias("channel"))
        best = first_per(lexical, ["document_id"], [F.desc("score"), "ordinal"], most)
        return first_per(best.unionByName(head), ["document_id"], [F.desc("score"), "ordinal"], most)

    def vectors(self, vector: list[float], most: int = 3, each: int = 64) -> DataFrame:
        """document_id, ordinal, score: the nearest chunks of the shortlist, among the first each of a document with the query's dimensions."""
        ids = self.spark.createDataFrame([(i,) for i, _ in self.top()], "document_id string")
        chunks = chunk_vectors(self.spark, self.sf_dir).where(F.size("embedding") == len(vector)).join(F.broadcast(ids), "document_id", "left_semi")
        scored = first_per(chunks, ["document_id"], ["ordinal", "vec_id"], each).withColumn("score", F.round(cosine(F.col("embedding"), vector), 9))
        return first_per(scored.where("score is not null"), ["document_id"], [F.desc("score"), "ordinal"], most).select("document_id", "ordinal", "score")


def lexical(spark: SparkSession, sf_dir: str, q: str, filters: dict | None = None, limit: int | None = 120, docs: DataFrame | None = None) -> tuple[Lexical, str]:
    """All units first; any of them only if nothing has all and the query has more than one. docs: live documents with the fields of
    the filter, if not those of the corpus itself."""
    found = Lexical(spark, sf_dir, q, filters, limit, docs=docs)
    if len(found.units) > 1 and (found.matched.isEmpty() if limit is None else not found.top()):
        return Lexical(spark, sf_dir, q, filters, limit, "any", docs), "any_term_fallback"
    return found, "all_terms"


_HEAD = "concat_ws(' ', title, array_to_string(tags, ' '), array_to_string(tickers, ' '), array_to_string(companies, ' '))"
_LEX = f"lex_ AS (SELECT document_id, revision_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), {_TERM}))) AS lexemes, list_distinct(regexp_extract_all(lower({_HEAD}), {_TERM})) AS head FROM pages_)"

#: Words of documents as their blocks have them, for DuckDB; to follow pages_ and blocks_.
_BLEX = f"lex_ AS (SELECT p.document_id, coalesce(b.lexemes, []) AS lexemes, list_distinct(regexp_extract_all(lower({_HEAD}), {_TERM})) AS head FROM pages_ p LEFT JOIN (SELECT document_id, list_distinct(flatten(list(regexp_extract_all(lower(text), {_TERM})))) AS lexemes FROM blocks_ GROUP BY 1) b USING (document_id))"


@query("k7_lexemes", f"{P}, {_LEX} SELECT document_id, revision_id, CAST(len(lexemes) AS INTEGER) AS n, sha256(array_to_string(lexemes, ' ')) AS hash FROM lex_")
def k7(spark, sf_dir):
    """The lexeme projection: one row of distinct words for each document and revision."""
    return projection(pages(spark, sf_dir)).select("document_id", "revision_id", F.size("lexemes").alias("n"), F.sha2(F.array_join("lexemes", " "), 256).alias("hash"))


@query("a10_lexeme_union", f"{B} SELECT document_id, count(DISTINCT term) AS n FROM (SELECT document_id, unnest(regexp_extract_all(lower(text), {_TERM})) AS term FROM blocks_) GROUP BY 1")
def a10(spark, sf_dir):
    """Words of a document as the union over its blocks."""
    found = blocks(spark, sf_dir).select("document_id", F.explode(terms(F.col("text"))).alias("term"))
    return found.groupBy("document_id").agg(F.countDistinct("term").alias("n"))


def stale(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Documents whose projection is missing or of another revision: only these are made anew."""
    joined = docs.join(kept.select("document_id", F.col("revision_id").alias("_kept")), "document_id", "left")
    return joined.where(~F.col("revision_id").eqNullSafe(F.col("_kept"))).drop("_kept")


@query("k8_stale_projection", f"{P}, {_LEX} SELECT document_id, CAST(len(lexemes) AS INTEGER) AS n FROM lex_ JOIN pages_ USING (document_id) WHERE doc_id % 4 = 0 OR doc_id % 10 = 3")
def k8(spark, sf_dir):
    docs = pages(spark, sf_dir)
    kept = docs.where("doc_id % 4 <> 0").select("document_id", F.when(F.col("doc_id") % 10 == 3, "old").otherwise(F.col("revision_id")).alias("revision_id"))
    return projection(stale(docs, kept)).select("document_id", F.size("lexemes").alias("n"))


@query("f4_any_and_all", f"{B}, {_BLEX} SELECT document_id, list_has_all(lexemes, ['the', 'of']) AS every, list_has_any(lexemes, ['the', 'der']) AS some FROM lex_ WHERE list_has_any(lexemes, ['the', 'of', 'der'])")
def f4(spark, sf_dir):
    """Recall of all and of any units from the projection."""
    found = index(spark, sf_dir).lookup(["the", "of", "der"]).where(F.col("ordinal") >= 0)
    terms_ = found.groupBy("document_id").agg(F.collect_set("term").alias("t"))
    has = lambda w: F.array_contains("t", w)
    return terms_.select("document_id", (has("the") & has("of")).alias("every"), (has("the") | has("der")).alias("some"))


@query("x1_search", f"{B}, {_BLEX} SELECT document_id, CASE WHEN contains(lower(title), 'from src1') THEN 12 WHEN list_has_all(head, ['from', 'src1']) THEN 4 ELSE 0 END AS header_floor FROM lex_ JOIN pages_ USING (document_id) WHERE NOT deleted AND lang = 'en' AND (contains(lower(title), 'from src1') OR list_has_all(head, ['from', 'src1']) OR list_has_all(lexemes, ['from', 'src1']))")
def x1(spark, sf_dir):
    """Which documents a search with a filter finds, and the least that their headers are worth (4, and 8 for the title)."""
    found, _ = lexical(spark, sf_dir, "from src1", {"field": "lang", "op": "eq", "value": "en"}, limit=None)
    return found.shortlist.select("document_id", F.when(F.col("score") >= 12, 12).when(F.col("score") >= 4, 4).otherwise(0).alias("header_floor"))


@query("x1_matched_total", f"{B}, {_BLEX}, m AS (SELECT document_id FROM lex_ JOIN pages_ USING (document_id) WHERE NOT deleted AND list_has_all(lexemes, ['the', 'and'])) SELECT least((SELECT count(*) FROM m), 5) AS returned, (SELECT count(*) FROM m) AS matched_documents")
def x1_matched(spark, sf_dir):
    """The shortlist and how many were matched before its limit."""
    found, _ = lexical(spark, sf_dir, "the and", limit=5)
    return spark.createDataFrame([(len(found.top()), found.total)], "returned long, matched_documents long")


@query("x2_any_label", f"{B}, {_BLEX} SELECT document_id, 'any_term_fallback' AS lexical_match FROM lex_ JOIN pages_ USING (document_id) WHERE NOT deleted AND list_has_any(lexemes, ['der', 'zzzzqq'])")
def x2(spark, sf_dir):
    found, how = lexical(spark, sf_dir, "der zzzzqq", limit=None)
    return found.shortlist.select("document_id", F.lit(how).alias("lexical_match"))


def _with_han(docs: DataFrame) -> DataFrame:
    """Documents of which some begin with Han words: as a phrase, with a character between, full-width, or in the header only."""
    n = F.col("doc_id")
    text = F.when(n % 5 == 0, F.concat(F.lit("央行加息, AI "), "text")).when(n % 5 == 1, F.concat(F.lit("加大息 ai "), "text")).when(n % 5 == 2, F.concat(F.lit("ＡＩ：加息 "), "text")).otherwise(F.col("text"))
    return docs.withColumn("text", text).withColumn("title", F.when(n % 5 == 3, F.concat("title", F.lit(" 加息 ai"))).otherwise(F.col("title")))


@query("x3_phrases", f"{P} SELECT document_id, 'body' AS field FROM pages_ WHERE doc_id % 5 IN (0, 2) AND text <> '' UNION ALL SELECT document_id, 'header' FROM pages_ WHERE doc_id % 5 = 3")
def x3(spark, sf_dir):
    """A query of a Han phrase and a word over the corpus's texts, some with Han words: the phrase's characters follow each other in one
    block, by their positions in the postings; another character between them is no phrase; full-width forms are folded."""
    made = Projection.create(spark, f"{scratch(spark)}/han-{uuid.uuid4().hex}")
    made.refresh(_with_han(pages(spark, sf_dir).where("text <> ''").withColumn("revision_id", F.lit("han"))))
    units = query_terms("加息 AI")
    found = made.lookup(sorted({w for u in units for w in u}))
    arms = [recalled(found.where(F.col("ordinal") >= 0 if name == "body" else F.col("ordinal") == HEADER), units, "all").select("document_id", F.lit(name).alias("field")) for name in ("body", "header")]
    return arms[0].union(arms[1])


@query("k8_delta_segments", f"{P} SELECT (SELECT count(*) FROM pages_ WHERE doc_id % 100 = 3) AS tokenised, (SELECT count(*) FROM pages_ WHERE doc_id % 100 = 7) AS removed, 2 AS segments, (SELECT count(*) FROM pages_ WHERE doc_id % 100 = 3) AS found, 0 AS left_over")
def k8_delta(spark, sf_dir):
    """After one document in a hundred has changed and another in a hundred has gone, only the changed are tokenised, and a search
    sees their new words, and none of those that are gone."""
    docs = pages(spark, sf_dir).withColumn("text", F.concat(F.lit("oldzebra "), F.coalesce("text", F.lit(""))))
    made = Projection.create(spark, f"{scratch(spark)}/delta-{uuid.uuid4().hex}")
    made.refresh(docs)
    changed = F.col("doc_id") % 100 == 3
    now = docs.where("doc_id % 100 <> 7").withColumn("text", F.when(changed, F.replace("text", F.lit("oldzebra"), F.lit("newzebra"))).otherwise(F.col("text"))).withColumn("revision_id", F.when(changed, F.concat("revision_id", F.lit(":2"))).otherwise(F.col("revision_id")))
    told = made.refresh(now)
    found = made.lookup(["newzebra"]).agg(F.count("*").alias("found"))
    left = made.lookup(["oldzebra"]).join(docs.where("doc_id % 100 in (3, 7)").select("document_id"), "document_id", "left_semi").agg(F.count("*").alias("left_over"))
    counts = spark.createDataFrame([(told["tokenised"], told["removed"], told["segments"])], "tokenised long, removed long, segments int")
    return counts.join(found).join(left)


#: A search for one word: its shortlist, and of each document the three blocks that have it most often, for DuckDB. One word's cover
#: density is the number of its occurrences, and a block that has it holds the query as a whole.
_ONE = f"""short_ AS (SELECT document_id FROM (SELECT DISTINCT document_id FROM blocks_ WHERE list_contains(regexp_extract_all(lower(text), {_TERM}), 'with')) JOIN (SELECT document_id FROM pages_ WHERE NOT deleted AND lang = 'en') USING (document_id) ORDER BY document_id LIMIT 120),
l AS (SELECT document_id, ordinal, score FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, ordinal) AS n FROM (SELECT document_id, ordinal, 1.0 + len(list_filter(regexp_extract_all(lower(text), {_TERM}), lambda x: x = 'with')) AS score FROM blocks_ JOIN short_ USING (document_id)) WHERE score > 1) WHERE n <= 3),
v AS (SELECT 'doc:' || e.vec_id AS document_id, 0 AS ordinal, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE 'doc:' || e.vec_id IN (SELECT document_id FROM short_)),
f AS (SELECT document_id, ordinal, sum(s) AS score, string_agg(c, ',' ORDER BY c) AS channels FROM (SELECT document_id, ordinal, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, document_id, ordinal)) AS s, 'lexical' AS c FROM l UNION ALL SELECT document_id, ordinal, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, document_id, ordinal)), 'vector' FROM v) GROUP BY 1, 2)"""


def _one_word(spark, sf_dir) -> Lexical:
    return Lexical(spark, sf_dir, "with", {"field": "lang", "op": "eq", "value": "en"})


def _channels(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The channels of a search for one word with a vector: passages and nearest chunks of its shortlist."""
    found = _one_word(spark, sf_dir)
    q = [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]
    return found.passages().where("channel = 'lexical'"), found.vectors(q)


@query("x5_hydrated", f"{B}, {_ONE} SELECT l.document_id, p.revision_id, l.ordinal, b.text FROM l JOIN pages_ p USING (document_id) JOIN blocks_ b USING (document_id, ordinal)")
def x5(spark, sf_dir):
    """The blocks that a search picked, with their documents: row groups without its shortlist are not read, and the active
    revision and the filter are checked again."""
    found = _one_word(spark, sf_dir)
    docs = apply_filter(found.docs, {"field": "lang", "op": "eq", "value": "en"}).select("document_id", "revision_id")
    picks = found.passages().where("channel = 'lexical'").select("document_id", "ordinal")
    chosen = found.blocks().join(F.broadcast(picks), ["document_id", "ordinal"], "left_semi").select("document_id", "revision_id", "ordinal", "text")
    return docs.join(chosen, ["document_id", "revision_id"]).select("document_id", "revision_id", "ordinal", "text")


def fused(channels: list[tuple[str, DataFrame]], k: int = 60) -> DataFrame:
    """Channels (name, document_id, ordinal, score) to document_id, ordinal, score, channels: 1 / (60 + place) added over the channels.
    Each channel is bounded, so its places are one small sort."""
    from pyspark.sql import Window

    parts = [rows.select("document_id", "ordinal", (1.0 / (k + F.row_number().over(Window.orderBy(F.desc("score"), "document_id", "ordinal")))).alias("s"), F.lit(name).alias("channel")) for name, rows in channels]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("document_id", "ordinal").agg(F.sum("s").alias("score"), F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels"))


@query("x6_fusion", f"{B}, {_ONE} SELECT document_id, ordinal, round(score, 12) AS score, channels FROM f")
def x6(spark, sf_dir):
    lexical_, vector = _channels(spark, sf_dir)
    return fused([("lexical", lexical_), ("vector", vector)]).withColumn("score", F.round("score", 12))


@query("x7_borrowed_evidence", f"{B}, {_ONE}, best AS (SELECT document_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, ordinal) AS n FROM l) WHERE n = 1) SELECT p.document_id, p.document_id || ':' || coalesce(CAST(best.ordinal AS VARCHAR), 'document') AS key FROM pages_ p LEFT JOIN best USING (document_id) WHERE NOT p.deleted AND contains(lower(p.title), 'src1')")
def x7(spark, sf_dir):
    """A hit in a header borrows its document's first passage of the search; without one it stands for the document."""
    lexical_, _ = _channels(spark, sf_dir)
    first = first_per(lexical_, ["document_id"], [F.desc("score"), "ordinal"]).select("document_id", "ordinal")
    heads = pages(spark, sf_dir).where(~F.col("deleted") & F.contains(F.lower("title"), F.lit("src1"))).select("document_id")
    key = F.concat("document_id", F.lit(":"), F.coalesce(F.col("ordinal").cast("string"), F.lit("document")))
    return heads.join(first, "document_id", "left").select("document_id", key.alias("key"))


@query("x8_diversified", f"{B}, {_ONE} SELECT document_id, ordinal, 'document' AS grouping FROM (SELECT f.*, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, ordinal) AS n FROM f) WHERE n <= 1 UNION ALL SELECT document_id, ordinal, 'family' FROM (SELECT f.*, row_number() OVER (PARTITION BY family_id ORDER BY score DESC, document_id, ordinal) AS n FROM f JOIN pages_ USING (document_id)) WHERE n <= 1 UNION ALL SELECT document_id, ordinal, 'passage' FROM (SELECT f.*, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, ordinal) AS n FROM f) WHERE n <= 3")
def x8(spark, sf_dir):
    """One passage of a document, one of a family, or three of a document."""
    lexical_, vector = _channels(spark, sf_dir)
    ranked = fused([("lexical", lexical_), ("vector", vector)]).join(pages(spark, sf_dir).select("document_id", "family_id"), "document_id")
    order = [F.desc("score"), "document_id", "ordinal"]
    arms = [first_per(ranked, [key], order, k).select("document_id", "ordinal", F.lit(name).alias("grouping")) for name, key, k in (("document", "document_id", 1), ("family", "family_id", 1), ("passage", "document_id", 3))]
    return arms[0].union(arms[1]).union(arms[2])


@query("x4_guarded_rerank", "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0), c AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IN (1, 2, 3, 4) AND len(embedding) = 64 AND vec_id % 10 <> 0), e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM c) WHERE n <= 64), s AS (SELECT label, vec_id, round(list_cosine_similarity(v, q.e), 9) AS score FROM e, q) SELECT label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 3 ORDER BY score DESC, label, vec_id LIMIT 10")
def x4(spark, sf_dir):
    """Vectors of shortlisted documents only: the first 64 sound chunks of each (dimensions, and the text's hash of when it was embedded),
    its three nearest, the best of all."""
    vectors = table(spark, sf_dir, "embeddings")
    q = vectors.where("vec_id = 0").first()["embedding"]
    shortlist = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "label int")
    text = F.col("vec_id").cast("string")
    chunks = vectors.select("label", "vec_id", "embedding", F.md5(text).alias("now"), F.md5(F.when(F.col("vec_id") % 10 == 0, "other").otherwise(text)).alias("embedded"))
    sound = chunks.where((F.size("embedding") == len(q)) & (F.col("now") == F.col("embedded"))).join(F.broadcast(shortlist), "label", "left_semi")
    scored = first_per(sound, ["label"], ["vec_id"], 64).select("label", "vec_id", F.round(cosine(F.col("embedding"), q), 9).alias("score"))
    return first_per(scored, ["label"], [F.desc("score"), "vec_id"], 3).orderBy(F.desc("score"), "label", "vec_id").limit(10)


@query("x10_empty_reasons", "SELECT unnest(['nothing left', 'no match', 'cut short', 'found']) AS name, unnest(['no_documents_match_filters', 'no_match_in_searched_text', 'retrieval_incomplete', NULL]) AS reason")
def x10(spark, sf_dir):
    """Why a search is empty: no document passes the filter, the search was cut short, or the texts do not have it."""
    docs = pages(spark, sf_dir).where(~F.col("deleted"))
    cases = [("nothing left", docs.where("lang = 'xx'"), "the", False), ("no match", docs, "zzzzqqq", False), ("cut short", docs, "zzzzqqq", True), ("found", docs, "the", False)]
    arms = []
    for name, rows, word, degraded in cases:
        hits = F.count_if(F.contains(F.lower("text"), F.lit(word)))
        reason = F.when(F.count("*") == 0, "no_documents_match_filters").when((hits == 0) & F.lit(degraded), "retrieval_incomplete").when(hits == 0, "no_match_in_searched_text")
        arms.append(rows.agg(F.lit(name).alias("name"), reason.alias("reason")))
    return arms[0].union(arms[1]).union(arms[2]).union(arms[3])


def entity_search(docs: DataFrame, found: DataFrame, registry_: DataFrame, name: str, kind: str, group: str = "document_id", limit: int = 20) -> DataFrame:
    """Documents about a named entity: if one curated entity goes by the name, those resolved to it come first (identity confirmed);
    after them, those that only have the name in their text (text only). One of each group."""
    from .mentions import aliases

    norm = " ".join(name.split()).lower()
    known = aliases(registry_).where((F.col("type") == kind) & (F.col("norm") == norm) & (F.size("ids") == 1)).select(F.explode("ids").alias("entity_id"))
    scoped = found.join(F.broadcast(known), "entity_id", "left_semi").select("document_id").distinct().select("document_id", F.lit(0).alias("route"))
    named = docs.where(F.contains(F.lower(F.concat_ws(" ", "title", "text", F.array_join("companies", " "))), F.lit(norm))).select("document_id", F.lit(1).alias("route"))
    best = scoped.union(named).groupBy("document_id").agg(F.min("route").alias("route"))
    rows = best.join(docs, "document_id").select("document_id", F.col(group).alias("_g"), "route")
    status = F.when(F.col("route") == 0, "identity_confirmed").otherwise("text_only")
    return first_per(rows, ["_g"], ["route", "document_id"]).orderBy("route", "document_id").limit(limit).select("document_id", status.alias("identity_status"))


@query("x11_entity_search", MODEL + ", live AS (SELECT * FROM pages_ WHERE NOT deleted), hit AS (SELECT document_id, min(route) AS route FROM (SELECT document_id, 0 AS route FROM resolved_ WHERE entity_id = 'entity:company:4' UNION ALL SELECT document_id, 1 FROM live WHERE contains(lower(concat_ws(' ', title, text, array_to_string(companies, ' '))), 'supplier#000000004')) GROUP BY 1) SELECT document_id, CASE route WHEN 0 THEN 'identity_confirmed' ELSE 'text_only' END AS identity_status FROM (SELECT h.*, row_number() OVER (PARTITION BY family_id ORDER BY route, h.document_id) AS n FROM hit h JOIN live l ON l.document_id = h.document_id) WHERE n = 1 ORDER BY route, document_id LIMIT 20")
def x11(spark, sf_dir):
    docs = pages(spark, sf_dir).where(~F.col("deleted"))
    known = entities(spark, sf_dir)
    return entity_search(docs, resolved(mentions(pages(spark, sf_dir)), known), known, " Supplier#000000004", "company", "family_id")


@query("x12_expected", f"{B}, {_BLEX} SELECT unnest(['doc:3', 'doc:11', 'none']) AS expected_id, unnest([(SELECT count(*) FROM pages_ WHERE document_id = 'doc:3'), (SELECT count(*) FROM pages_ WHERE document_id = 'doc:11'), 0]) > 0 AS exists, unnest([(SELECT count(*) FROM pages_ WHERE document_id = 'doc:3' AND NOT deleted), (SELECT count(*) FROM pages_ WHERE document_id = 'doc:11' AND NOT deleted), 0]) > 0 AS passes_filters, unnest([(SELECT count(*) FROM lex_ JOIN pages_ USING (document_id) WHERE document_id = 'doc:3' AND NOT deleted AND list_has_all(lexemes, ['the'])), (SELECT count(*) FROM lex_ JOIN pages_ USING (document_id) WHERE document_id = 'doc:11' AND NOT deleted AND list_has_all(lexemes, ['the'])), 0]) > 0 AS recalled")
def x12(spark, sf_dir):
    """Where an expected document was lost: not there, filtered out, or not recalled."""
    docs = pages(spark, sf_dir)
    found, _ = lexical(spark, sf_dir, "the", limit=None)
    asked = spark.createDataFrame([("doc:3",), ("doc:11",), ("none",)], "expected_id string")
    mark = lambda rows, name: rows.select(F.col("document_id").alias("expected_id")).distinct().withColumn(name, F.col("expected_id"))
    joined = asked.join(mark(docs, "e"), "expected_id", "left").join(mark(docs.where(~F.col("deleted")), "f"), "expected_id", "left").join(mark(found.shortlist, "r"), "expected_id", "left")
    return joined.select("expected_id", F.col("e").isNotNull().alias("exists"), F.col("f").isNotNull().alias("passes_filters"), F.col("r").isNotNull().alias("recalled"))
