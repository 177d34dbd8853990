"""Queries of the training-data operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, minhash, mixing, packing, passages, phrases, resampling, sharding, spelling, toxicity, vectors, warc, whitening


def tokenizer_file() -> str:
    """The public tokenizer that op4 and the pipeline use; a path on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 8)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near(_table(spark, sf_dir, "embeddings"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_file())
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.neighbours(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(_table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_resampling, op2_sharding, op3_embedding_dedup, op4_bpe, op5_minhash, op6_suffix_dedup, op7_phrases, op8_warc, op9_toxicity, op10_mixing, op11_whitening, op12_spelling, op13_packing, pipeline]
    return {f.__name__: f for f in own}


#: Exact cosines in double precision and the closure of the links; small enough for SQL at the scale of the comparison.
OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE e IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(e, lambda x: x * x)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(d.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c USING (vec_id) LEFT JOIN deg d USING (vec_id)
"""

#: Each five hexadecimal digits of the digest are four base32 characters.
OP8 = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS newest,
  list_transform(range(8), lambda i: CAST('0x' || substr(x, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)) AS v FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(v, lambda n: array_to_string(list_transform([15, 10, 5, 0],
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((n >> k) & 31) + 1 AS INTEGER), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < newest THEN newest END AS refers_to
FROM b
"""

#: Sets of two-word shingles, pairs by the shingles they share, and the closure of the links.
OP5 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS c FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2, 3, 4),
link AS (SELECT a, b FROM met WHERE 100 * c >= 80 * (n + m - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comp USING (doc_id)
"""

#: Every window of fifty bytes with the smallest document that has it; windows of later documents, in runs, cut out.
OP6 = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS y, hex(coalesce(text, '')) AS x FROM documents),
win AS (SELECT doc_id, i, y[i + 1 : i + 50] AS s FROM (SELECT doc_id, y, unnest(range(greatest(0, octet_length(y) - 49))) AS i FROM b)),
least_ AS (SELECT s, min(doc_id) AS m FROM win GROUP BY 1),
late AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS fresh FROM win JOIN least_ USING (s) WHERE doc_id > m),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM late) GROUP BY doc_id, g),
cut_ AS (SELECT doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, list(a ORDER BY a) AS a, list(e ORDER BY a) AS e FROM spans GROUP BY 1)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda k:
    substr(x, CASE WHEN k = 0 THEN 0 ELSE 2 * e[k] END + 1, CASE WHEN k = len(a) THEN length(x) ELSE 2 * a[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE 2 * e[k] END)), '') END)) AS kept_sha256
FROM b LEFT JOIN cut_ USING (doc_id)
"""

#: The checksum byte by byte from its table of 256, which a rule gives; near words by masked and by shortened spellings.
OP12 = """
WITH RECURSIVE t AS (
  SELECT list(list_reduce(range(8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), n) ORDER BY n) AS tab FROM range(256) r(n)),
runs AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents)
  GROUP BY 1, 2),
spelt AS (
  SELECT w, n, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w) AS x FROM runs),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS h FROM spelt, t),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
spots AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
masks AS (SELECT word, substr(word, 1, i) || '*' || substr(word, i + 2) AS m FROM spots),
shorter AS (SELECT DISTINCT s.word AS a, w.word AS b FROM spots s JOIN words w ON w.word = substr(s.word, 1, i) || substr(s.word, i + 2)),
near AS (
  SELECT DISTINCT x.word AS a, y.word AS b FROM masks x JOIN masks y ON x.m = y.m AND x.word <> y.word
  UNION SELECT a, b FROM shorter UNION SELECT b, a FROM shorter),
best AS (
  SELECT a, b, w.n AS b_n, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS k, count(*) OVER (PARTITION BY a) AS n_near FROM near JOIN words w ON w.word = b),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 10 * w.n THEN b END AS form, CASE WHEN b_n >= 10 * w.n THEN b_n END AS form_n
  FROM words w LEFT JOIN best ON best.a = w.word AND k = 1),
chain AS (
  SELECT word, word AS here, 0 AS k FROM forms UNION ALL
  SELECT c.word, f.form, c.k + 1 FROM chain c JOIN forms f ON f.word = c.here WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM forms f JOIN (SELECT word, arg_max(here, k) AS root FROM chain GROUP BY 1) c USING (word)
"""

#: What op10 takes follows from the hash keys of the operator, and op2's cuts from its order of groups: left to the tests.
ORACLES: dict[str, str] = {"op3_embedding_dedup": OP3, "op5_minhash": OP5, "op6_suffix_dedup": OP6, "op8_warc": OP8, "op12_spelling": OP12}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
