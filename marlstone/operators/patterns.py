"""Many patterns in many texts: an Aho-Corasick automaton over the patterns finds all that stand in a text in one pass over it.

The patterns' size is measured first. What fits a shard is one automaton, sent to the tasks with the plan and built once in each
worker; larger sets are cut into shards by hash, each scanned and written before the next, so that the driver holds one at a time.
Texts are read once for each shard and never meet the patterns in a join. (Sets of very many shards had better meet their texts by
hashed keys first.)
"""

from __future__ import annotations

import math
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import registry
from ..views import table

QUERIES, SQL, query = registry()
#: Bytes of patterns in one automaton.
SHARD = 16 << 20
_BUILT: dict[str, object] = {}


def _automaton(token: str, patterns: list[str]):
    """The automaton of a shard, kept by the worker for its next tasks."""
    import ahocorasick

    if token not in _BUILT:
        _BUILT.clear()
        made = ahocorasick.Automaton()
        for k, p in enumerate(patterns):
            made.add_word(p, k)
        made.make_automaton()
        _BUILT[token] = made
    return _BUILT[token]


def _scanned(patterns: list[str], keys: list[str], text: str):
    token = uuid.uuid4().hex

    def run(batches):
        made = _automaton(token, patterns)
        for batch in batches:
            rows, hits = [], []
            for k, value in enumerate(batch.column(text)):
                if (value := value.as_py()) and patterns:
                    own = {p for _, p in made.iter(value)}
                    rows += [k] * len(own)
                    hits += sorted(own)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), pa.array([patterns[p] for p in hits], pa.string())], [*keys, "pattern"])

    return run


def found_in(texts: DataFrame, patterns: DataFrame, keys: list[str], text: str = "text", pattern: str = "pattern", shard: int = SHARD) -> DataFrame:
    """keys and pattern of every row of texts and every distinct pattern that its text holds (each once, overlapping ones too). Null and
    empty texts and patterns match nothing."""
    from .retrieval import scratch

    spark = texts.sparkSession
    distinct = patterns.select(F.col(pattern).alias("pattern")).where("pattern <> ''").distinct()
    rows = texts.select(*keys, text)
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys), "pattern string"])
    size = distinct.agg(F.sum(F.octet_length("pattern") + 16)).first()[0] or 0
    parts = math.ceil(size / shard)
    if parts <= 1:
        return rows.mapInArrow(_scanned(sorted(r["pattern"] for r in distinct.collect()), keys, text), schema)
    path = f"{scratch(spark)}/patterns-{uuid.uuid4().hex}"
    for k in range(parts):
        own = distinct.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k)
        rows.mapInArrow(_scanned(sorted(r["pattern"] for r in own.collect()), keys, text), schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


@query("t10_quote_grounding", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND length(b.text) >= 8")
def t10(spark, sf_dir):
    """Documents that quote a passage, as a substring."""
    quotes = table(spark, sf_dir, "benchmark").where(F.char_length("text") >= 8).select("item_id", F.col("text").alias("pattern"))
    hits = found_in(table(spark, sf_dir, "documents"), quotes, ["doc_id"])
    return hits.join(quotes, "pattern").select("doc_id", "item_id")


@query("t10_short_quotes", "WITH q AS (SELECT DISTINCT regexp_extract(text, '^[^ \\t\\n\\r]+', 0) AS pattern FROM benchmark UNION SELECT DISTINCT regexp_extract(text, '^[^ \\t\\n\\r]+ [^ \\t\\n\\r]+', 0) FROM benchmark) SELECT pattern, count(*) AS documents, sum(doc_id) AS checksum FROM documents JOIN q ON pattern <> '' AND contains(text, pattern) GROUP BY 1")
def t10_short(spark, sf_dir):
    """Quotes of one and of two words, which have no inner words to be looked up by."""
    text = table(spark, sf_dir, "benchmark").select("text")
    one, two = (text.select(F.regexp_extract("text", rf"^[^ \t\n\r]+{more}", 0).alias("pattern")) for more in ("", r" [^ \t\n\r]+"))
    hits = found_in(table(spark, sf_dir, "documents"), one.union(two), ["doc_id"])
    return hits.groupBy("pattern").agg(F.count("*").alias("documents"), F.sum("doc_id").alias("checksum"))


@query("t28_names_in_pages", "WITH q AS (SELECT DISTINCT split_part(split_part(url, '/', 3), '.', 1) AS pattern FROM pages UNION SELECT n_name FROM nation UNION SELECT r_name FROM region) SELECT page_id, count(*) AS names FROM pages JOIN q ON pattern <> '' AND contains(html, pattern) GROUP BY 1")
def t28(spark, sf_dir):
    """Names of hosts, nations and regions that stand in raw pages."""
    host = table(spark, sf_dir, "pages").select(F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("."), F.lit(1)).alias("pattern"))
    names = host.union(table(spark, sf_dir, "nation").select("n_name")).union(table(spark, sf_dir, "region").select("r_name"))
    return found_in(table(spark, sf_dir, "pages"), names, ["page_id"], "html").groupBy("page_id").agg(F.count("*").alias("names"))
