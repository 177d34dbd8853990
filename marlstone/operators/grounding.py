"""Grounding of extracted fields: quotes by page and field, required fields, forecasts in tables, merged field groups, the
structure of translations, publishers; and maintenance guarded by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import evidence_text, numbers
from ..registry import registry
from ..views import table

QUERIES, SQL, query = registry()


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def pages_of(bodies: DataFrame, key: str) -> DataFrame:
    """key, page, text of every page of a body, as quotes are compared with it."""
    parts = F.regexp_extract_all("body", F.lit(r"(?s)## PDF 第 \d+ 页\n.*?(?=\n## PDF 第 \d+ 页|$)"), 0)
    rows = bodies.select(key, F.explode(parts).alias("p"))
    return rows.select(key, F.regexp_extract("p", r"第 (\d+) 页", 1).cast("int").alias("page"), evidence_text(F.regexp_extract("p", r"(?s)\n(.*)$", 1)).alias("text"))


def grounded(fields: DataFrame, evidence: DataFrame, bodies: DataFrame, key: str, per_item: tuple[str, ...] = ("companies", "industries", "subfields")) -> DataFrame:
    """fields (key, field, value) with kept: those with a quote (evidence: key, field, item, quote, page) of eight characters or more that
    stands in the body, and on the claimed page if one is claimed. Entity fields need a quote for each value."""
    quoted = evidence.withColumn("q", evidence_text(F.col("quote"))).where(F.char_length("q") >= 8)
    found = quoted.join(pages_of(bodies, key).select(key, F.col("page").alias("_p"), "text"), key).where(F.contains("text", F.col("q")) & (F.col("page").isNull() | (F.col("page") == F.col("_p"))))
    proof = found.select(key, "field", F.when(F.col("field").isin(*per_item), F.col("item")).alias("_item")).distinct().withColumn("_kept", F.col("field"))
    asked = fields.withColumn("_item", F.when(F.col("field").isin(*per_item), F.col("value")))
    joined = asked.join(proof.select(F.col(key).alias("_k"), F.col("field").alias("_f"), F.col("_item").alias("_i"), "_kept"), (F.col(key) == F.col("_k")) & (F.col("field") == F.col("_f")) & F.col("_item").eqNullSafe(F.col("_i")), "left")
    return joined.select(key, "field", "value", F.col("_kept").isNotNull().alias("kept"))


def _extraction(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    bodies = docs.select("doc_id", _say("## PDF 第 1 页\nAcme <b>Holdings</b> rose by ", n, " percent\n## PDF 第 2 页\nBeta Industries fell on 5 March"), n.alias("x")).toDF("doc_id", "body", "x").drop("x")
    values = F.array(F.struct(F.lit("title").alias("field"), F.lit("Rose").alias("value")), F.struct(F.lit("date").alias("field"), F.lit("2024-03-05").alias("value")), F.struct(F.lit("companies").alias("field"), F.lit("Acme").alias("value")), F.struct(F.lit("companies").alias("field"), F.lit("Beta").alias("value")))
    fields = docs.select("doc_id", F.explode(values).alias("f")).select("doc_id", "f.*")
    proof = lambda field, item, quote, page: F.struct(F.lit(field).alias("field"), F.lit(item).cast("string").alias("item"), quote.alias("quote"), page.alias("page"))
    quotes = F.array(
        proof("title", None, _say("Acme Holdings rose by ", n), F.when(n % 2 == 0, 1).otherwise(2)),
        proof("date", None, F.lit("5 March"), F.lit(2)),
        proof("companies", "Acme", F.when(n % 3 == 0, "Acme\n Holdings rose").otherwise("Acme Holdings fell"), F.lit(None).cast("int")),
        proof("companies", "Gamma", F.lit("Beta Industries fell"), F.lit(2)),
    )
    return fields, docs.select("doc_id", F.explode(quotes).alias("e")).select("doc_id", "e.*"), bodies


@query("t10_fields_grounded", "SELECT doc_id, field, value, CASE WHEN field = 'title' THEN doc_id % 2 = 0 WHEN value = 'Acme' THEN doc_id % 3 = 0 ELSE false END AS kept FROM documents, (SELECT unnest(['title', 'date', 'companies', 'companies']) AS field, unnest(['Rose', '2024-03-05', 'Acme', 'Beta']) AS value)")
def t10(spark, sf_dir):
    """Proved on the right page and on a wrong one, by too short a quote, by a text that differs, and for another item."""
    return grounded(*_extraction(spark, sf_dir), "doc_id")


@query("t11_required_fields", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'date' ELSE 'date,title' END || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '|companies' END AS missing FROM documents")
def t11(spark, sf_dir, required: tuple[str, ...] = ("date", "title")):
    """Required fields that are not proved, and entity fields that lost all their values."""
    kept = grounded(*_extraction(spark, sf_dir), "doc_id")
    per = kept.groupBy("doc_id").agg(F.collect_set(F.when(F.col("kept"), F.col("field"))).alias("have"), F.collect_set("field").alias("asked"))
    missing = F.array_except(F.array(*[F.lit(f) for f in required]), "have")
    lost = F.array_except(F.array_intersect("asked", F.array(F.lit("companies"))), "have")
    return per.select("doc_id", F.concat(F.array_join(missing, ","), F.when(F.size(lost) > 0, F.concat(F.lit("|"), F.array_join(lost, ","))).otherwise("")).alias("missing"))


def table_cells(bodies: DataFrame, key: str) -> DataFrame:
    """key, label, period, value of every cell of the simple HTML tables of a body: the first column names the row, the first row the
    periods. Tables with spanning cells are left out, as their columns cannot be told."""
    tables = bodies.select(key, F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<table\b[^>]*>.*?</table>"), 0)).alias("t", "html")).where(~F.col("html").rlike(r"(?i)(?:rowspan|colspan)\s*="))
    rows = tables.select(key, "t", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("r", "row"))
    cells = rows.select(key, "t", "r", F.posexplode(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1)).alias("c", "cell")).withColumn("cell", evidence_text(F.col("cell")))
    head = cells.where("r = 0 and c > 0").select(key, "t", "c", F.col("cell").alias("period"))
    names = cells.where("r > 0 and c = 0").select(key, "t", "r", F.lower("cell").alias("label"))
    return cells.where("r > 0 and c > 0").join(head, [key, "t", "c"]).join(names, [key, "t", "r"]).select(key, "label", "period", F.get(numbers(F.col("cell")), 0).alias("value"))


def forecasts_grounded(claims: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    """claims (key, label, period, value) with status: the number stands in the row of the label under the very period; in that row under
    another period only; differs; or there is no such row."""
    cells = table_cells(bodies, key)
    asked = claims.withColumn("label_", F.lower("label")).withColumn("number", F.get(numbers(F.col("value")), 0))
    joined = asked.join(cells.select(F.col(key).alias("_k"), F.col("label").alias("_l"), F.col("period").alias("_p"), F.col("value").alias("_v")), (F.col(key) == F.col("_k")) & (F.col("label_") == F.col("_l")), "left")
    right, same = F.col("_v") == F.col("number"), F.col("_p") == F.col("period")
    told = joined.groupBy(key, "label", "period", "value").agg(F.max(F.coalesce(right & same, F.lit(False))).alias("a"), F.max(F.coalesce(right, F.lit(False))).alias("b"), F.max(F.coalesce(same, F.lit(False))).alias("c"), F.count("_l").alias("n"))
    status = F.when(F.col("a"), "grounded").when(F.col("b"), "other_period").when(F.col("c"), "different_value").when(F.col("n") > 0, "no_column").otherwise("no_row")
    return told.select(key, "label", "period", "value", status.alias("status"))


@query("t12_forecast_grounding", "SELECT doc_id, label, period, CASE label WHEN 'EPS' THEN CASE period WHEN '2024E' THEN 'grounded' WHEN '2025E' THEN 'other_period' ELSE 'no_column' END WHEN 'Revenue' THEN 'different_value' ELSE 'no_row' END AS status FROM documents, (SELECT unnest(['EPS', 'EPS', 'EPS', 'Revenue', 'Margin']) AS label, unnest(['2024E', '2025E', '2026E', '2024E', '2024E']) AS period)")
def t12(spark, sf_dir):
    """Forecasts in tables: right, under another year, for a year without a column, another number, no row, a table with spans."""
    n = F.col("doc_id")
    body = _say("<table><tr><th></th><th>2024E</th><th>2025E</th></tr><tr><td>EPS</td><td>1,", n + 100, ".50</td><td>(3)</td></tr><tr><td>Revenue</td><td>7</td><td>8</td></tr></table><table><tr><td colspan=2>Margin</td><td>9</td></tr></table>")
    docs = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    claim = lambda label, period, value: F.struct(F.lit(label).alias("label"), F.lit(period).alias("period"), value.alias("value"))
    claims = docs.select("doc_id", F.explode(F.array(claim("EPS", "2024E", _say("1", n + 100, ".5")), claim("EPS", "2025E", _say("1", n + 100, ".5")), claim("EPS", "2026E", F.lit("99")), claim("Revenue", "2024E", F.lit("7.1")), claim("Margin", "2024E", F.lit("9")))).alias("c")).select("doc_id", "c.*")
    return forecasts_grounded(claims, docs, "doc_id").select("doc_id", "label", "period", "status")


@query("t14_groups_merged", "SELECT doc_id, 'aapl' AS identity, 'q1|q2|q3' AS evidence, CASE WHEN doc_id % 2 = 0 THEN 'buy' END AS rating, doc_id % 2 = 1 AS conflict FROM documents")
def t14(spark, sf_dir):
    """Field groups of one identity (ticker, else company): evidence united, each once; two different values of a field are a conflict."""
    n = F.col("doc_id")
    group = lambda ticker, quotes, rating: F.struct(F.lit(ticker).alias("ticker"), F.lit("Apple, Inc.").alias("company"), F.array(*[F.lit(q) for q in quotes]).alias("evidence"), rating.alias("rating"))
    parts = F.array(group("AAPL", ["q1", "q2"], F.lit("buy")), group("aapl ", ["q2", "q3"], F.when(n % 2 == 1, "sell")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(parts).alias("g")).select("doc_id", "g.*")
    identity = F.regexp_replace(F.lower(F.coalesce("ticker", "company")), r"[\s.,()（）]", "")
    merged = rows.groupBy("doc_id", identity.alias("identity")).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))), "|").alias("evidence"), F.min("rating").alias("r"), (F.countDistinct("rating") > 1).alias("conflict"))
    return merged.select("doc_id", "identity", "evidence", F.when(~F.col("conflict"), F.col("r")).alias("rating"), "conflict")


def translation_problem(source: Column, target: Column) -> Column:
    """The first thing that a translation does not keep: length, pictures, page markers, rows, cells, numbers; or that it is none."""
    images = lambda t: F.array_sort(F.regexp_extract_all(t, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), 1))
    markers = lambda t: F.regexp_extract_all(t, F.lit(r"(?m)^## PDF 第 (\d+) 页\r?$"), 1)
    raw_cells = lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1)
    cells = lambda t: F.transform(raw_cells(t), lambda c: F.translate(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", ""), "−", "-"))
    visible = lambda t: F.transform(F.split(t, r"(?m)^## PDF 第 \d+ 页\r?$"), lambda p: F.char_length(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"!\[[^\]]*\]\([^)]*\)", ""), "<[^>]*>", ""), r"\s+", "")))
    short = F.exists(F.arrays_zip(visible(source).alias("a"), visible(target).alias("b")), lambda z: (z["a"] > 400) & (F.coalesce(z["b"], F.lit(0)) < z["a"] * 0.2))
    rows = lambda t: F.regexp_count(t, F.lit(r"(?i)<tr\b"))
    changed = F.exists(F.arrays_zip(cells(source).alias("a"), cells(target).alias("b")), lambda z: z["a"].rlike(r"^[+-]?\d[\d.,]*%?$") & (z["a"] != z["b"]))
    return (
        F.when(F.char_length(F.trim(F.coalesce(target, F.lit("")))) < 15, "empty").when(images(source) != images(target), "images").when(markers(source) != markers(target), "pages").when(short, "short").when(rows(source) != rows(target), "rows")
        .when(F.size(cells(source)) != F.size(cells(target)), "cells").when(changed, "numbers").when(source.rlike("(?i)[a-z]{4}") & ~target.rlike("[\\x{3400}-\\x{9fff}]"), "not translated")
    )


@query("t17_structure", "SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN 'empty' WHEN 2 THEN 'images' WHEN 3 THEN 'pages' WHEN 4 THEN 'short' WHEN 5 THEN 'rows' WHEN 6 THEN 'numbers' WHEN 7 THEN 'not translated' END AS problem FROM documents")
def t17(spark, sf_dir):
    """A sound translation, and one of every fault."""
    k = F.col("doc_id") % 8
    row = "<table><tr><td>Name</td><td>1,5%</td></tr></table>"
    source = _say("![i](a.png)\n## PDF 第 1 页\nwords ", F.repeat(F.lit("long "), 100), row)
    image, mark = F.when(k == 2, "![i](b.png)").otherwise("![图](a.png)"), F.when(k == 3, "## PDF 第 2 页").otherwise("## PDF 第 1 页")
    text = F.when(k == 4, "短").when(k == 7, F.repeat(F.lit("x"), 200)).otherwise(F.repeat(F.lit("长"), 200))
    cells = F.when(k == 5, "<tr></tr><table><tr><td>名</td><td>1,5%</td></tr></table>").when(k == 6, "<table><tr><td>名</td><td>1.5%</td></tr></table>").when(k == 7, "<table><tr><td>n</td><td>1,5%</td></tr></table>").otherwise("<table><tr><td>名</td><td>1,5%</td></tr></table>")
    image = F.when(k == 7, "![i](a.png)").otherwise(image)
    mark_text = F.when(k == 1, "短").otherwise(F.concat(image, F.lit("\n"), mark, F.lit("\n"), text, cells))
    rows = table(spark, sf_dir, "documents").select("doc_id", source.alias("s"), mark_text.alias("t"))
    # A page marker is Chinese itself: the last test needs a text without any.
    plain = lambda c: F.when(k == 7, F.regexp_replace(c, "## PDF 第 1 页\n", "")).otherwise(c)
    return rows.select("doc_id", translation_problem(plain(F.col("s")), plain(F.col("t"))).alias("problem"))


def publisher(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rows (key, category, path, named, title, institutions) with publisher and match_source, by a ladder: none for domestic papers; a
    name verified before; the title's prefix; the folder; the institutions, if they agree. dictionary: id, alias. Each rung is one join."""
    from ..functions.strings import folded_key

    known = dictionary.select("id", folded_key(F.col("alias")).alias("_key")).distinct()
    single = known.groupBy("_key").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    prefix = F.split_part(F.regexp_replace(F.regexp_replace("title", r"^\d{4}[-_.]?\d{2}[-_.]?\d{2}[-_\s—]*", ""), "[-_—]", "\x01"), F.lit("\x01"), F.lit(1))
    folder = F.try_element_at(F.split(F.translate("path", "\\", "/"), "/"), F.lit(-2))
    out = rows.withColumn("_a", folded_key(prefix)).withColumn("_b", folded_key(F.coalesce(folder, F.lit(""))))
    out = out.join(single.select(F.col("_key").alias("_a"), F.col("id").alias("by_title")), "_a", "left").join(single.select(F.col("_key").alias("_b"), F.col("id").alias("by_folder")), "_b", "left")
    agreed = rows.select("key", F.explode("institutions").alias("i")).withColumn("_key", folded_key(F.col("i"))).join(single, "_key").groupBy("key").agg(F.countDistinct("id").alias("n"), F.min("id").alias("by_institution")).where("n = 1").drop("n")
    verified = dictionary.select(F.col("id").alias("named"), F.col("id").alias("by_name")).distinct()
    out = out.join(agreed, "key", "left").join(verified, "named", "left")
    domestic = (F.col("category") == "domestic") | F.coalesce(F.col("path").rlike("(?i)(?:^|/)raw1/"), F.lit(False))
    found = F.coalesce("by_name", "by_title", "by_folder", "by_institution")
    source = F.when(F.col("by_name").isNotNull(), "verified-naming").when(F.col("by_title").isNotNull(), "title-prefix").when(F.col("by_folder").isNotNull(), "publisher-directory").when(F.col("by_institution").isNotNull(), "institution-alias")
    return out.select("key", F.when(~domestic, found).alias("publisher"), F.when(~domestic, source).alias("match_source"))


@query("t24_publisher_ladder", "SELECT doc_id AS key, CASE doc_id % 8 WHEN 0 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE 'GS' END AS publisher, CASE doc_id % 8 WHEN 1 THEN 'verified-naming' WHEN 2 THEN 'title-prefix' WHEN 3 THEN 'publisher-directory' WHEN 4 THEN 'institution-alias' WHEN 5 THEN 'title-prefix' END AS match_source FROM documents")
def t24(spark, sf_dir):
    k = F.col("doc_id") % 8
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"),
        F.when(k == 0, "domestic").otherwise("foreign").alias("category"),
        F.when(k == 3, "in/Goldman-Sachs/x.pdf").when(k == 6, "in/raw1/x.pdf").otherwise("in/other/x.pdf").alias("path"),
        F.when(k.isin(1, 6), "GS").alias("named"),
        F.when(k == 2, "2024-03-05 Goldman Sachs_Outlook").when(k == 5, "20240305-ＧＳ—x").when(k == 7, "Twin - x").otherwise("Outlook").alias("title"),
        F.when(k == 4, F.array(F.lit("goldman sachs."), F.lit("G.S."), F.lit("unknown"))).when(k == 7, F.array(F.lit("GS"), F.lit("MS"))).otherwise(F.array().cast("array<string>")).alias("institutions"),
    )
    dictionary = spark.createDataFrame([("GS", "Goldman Sachs"), ("GS", "GS"), ("MS", "MS"), ("MS", "Twin"), ("GS", "Twin")], "id string, alias string")
    return publisher(rows, dictionary)


@query("t25_bibliography_fields", "SELECT n_nationkey, 'GS|Other' AS institutions, 'Jane Doe|' || n_name AS authors FROM nation")
def t25(spark, sf_dir):
    """Institutions and authors in their dictionary form, each once and in order; what is not known stays as it is."""
    from ..functions.strings import folded_key

    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.array(F.lit("goldman sachs"), F.lit("Other"), F.lit("G.S.")).alias("institutions"), F.array(F.lit("J. Doe"), F.col("n_name"), F.lit("Jane Doe")).alias("authors"))
    entries = spark.createDataFrame([("institutions", "GS", "Goldman Sachs"), ("institutions", "GS", "GS"), ("authors", "Jane Doe", "J Doe"), ("authors", "Jane Doe", "Jane Doe")], "field string, name string, alias string").withColumn("k", folded_key(F.col("alias")))
    out = rows.select("n_nationkey")
    for field in ("institutions", "authors"):
        values = rows.select("n_nationkey", F.posexplode(field).alias("at", "v")).withColumn("k", folded_key(F.col("v")))
        named = values.join(F.broadcast(entries.where(F.col("field") == field).select("k", "name")), "k", "left").groupBy("n_nationkey", F.coalesce("name", "v").alias("v")).agg(F.min("at").alias("at"))
        lists = named.groupBy("n_nationkey").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("l"))
        out = out.join(lists.select("n_nationkey", F.array_join("l.v", "|").alias(field)), "n_nationkey")
    return out


def drained(vectors: DataFrame, made: DataFrame, dims: int) -> DataFrame:
    """Vectors after a drain: a missing one takes the one that was made (chunk, text_hash, vector), if it was made from the text that stands
    there now and is sound; the others stay."""
    sound = (F.size("vector") == dims) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = made.where(F.coalesce(sound, F.lit(False))).select("chunk", F.col("text_hash").alias("_h"), F.col("vector").alias("_v"))
    joined = vectors.join(good, "chunk", "left")
    takes = F.col("vector").isNull() & (F.col("_h") == F.col("text_hash"))
    return joined.select("chunk", F.when(takes, F.col("_v")).otherwise(F.col("vector")).alias("vector"), F.coalesce(takes, F.lit(False)).alias("updated"))


@query("b8_drained", "SELECT vec_id AS chunk, vec_id % 5 = 0 AS updated, vec_id % 5 IN (0, 4) AS present FROM embeddings")
def b8(spark, sf_dir):
    """Missing vectors: made, made from an older text, made with a value that is not finite, not made; and one that was there."""
    k = F.col("vec_id") % 5
    rows = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    now = rows.select(F.col("vec_id").alias("chunk"), F.md5(F.col("vec_id").cast("string")).alias("text_hash"), F.when(k == 4, F.col("v")).alias("vector"))
    made = rows.where(k < 3).select(F.col("vec_id").alias("chunk"), F.md5(F.when(k == 1, "old").otherwise(F.col("vec_id").cast("string"))).alias("text_hash"), F.when(k == 2, F.concat(F.slice("v", 1, 63), F.array(F.lit(float("nan"))))).otherwise(F.col("v")).alias("vector"))
    return drained(now, made, 64).select("chunk", "updated", F.col("vector").isNotNull().alias("present"))


@query("b11_qualified", "SELECT doc_id AS id, doc_id % 4 = 0 AS qualified FROM documents")
def b11(spark, sf_dir):
    """A report counts as done if its event, its report and the manifest agree on id, hash and path."""
    k = F.col("doc_id") % 4
    docs = table(spark, sf_dir, "documents")
    make = lambda bad: docs.select(F.col("doc_id").alias("id"), F.when(k == bad, "other").otherwise(F.md5("text")).alias("hash"), F.concat(F.lit("p/"), "doc_id").alias("path"))
    events, reports, manifest = make(1), make(2), make(4).where("id % 4 <> 3")
    keys = ["id", "hash", "path"]
    good = events.join(reports, keys).join(manifest, keys).select("id", F.col("hash").alias("_ok"))
    return docs.select(F.col("doc_id").alias("id")).join(good, "id", "left").select("id", F.col("_ok").isNotNull().alias("qualified"))


@query("b13_pending", "WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'parsed' WHEN 1 THEN 'pending_parse' WHEN 2 THEN 'failed' ELSE 'pending_ocr' END AS status FROM documents) SELECT status, count(*) AS n, min(doc_id) AS first FROM r WHERE status IN ('pending_parse', 'pending_ocr') GROUP BY 1")
def b13(spark, sf_dir):
    """What of the manifest waits to be parsed, by status."""
    k = F.col("doc_id") % 4
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, "parsed").when(k == 1, "pending_parse").when(k == 2, "failed").otherwise("pending_ocr").alias("status"))
    return rows.where(F.startswith("status", F.lit("pending"))).groupBy("status").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("b9_page_markers", "SELECT doc_id, '## PDF 第 1 页' || chr(10) || 'a ' || doc_id || chr(10) || '## PDF 第 2 页' || chr(10) || 'b' AS body FROM documents")
def b9(spark, sf_dir):
    """Markers of any spelling, in one form: Page 1, [Page: 2], 第3页."""
    raw = _say("<!-- page 1 -->\na ", F.col("doc_id"), "\n## Page 2\nb")
    marked = F.regexp_replace(raw, r"(?mi)^(?:<!--\s*page\s+(\d+)\s*-->|##\s*Page\s+(\d+))\s*$", "## PDF 第 $1$2 页")
    return table(spark, sf_dir, "documents").select("doc_id", marked.alias("body"))


@query("e12_fixture_metrics", "SELECT lang, count(*) AS cases, round(count(*) FILTER (gold = got) / nullif(count(got), 0), 9) AS precision, round(count(*) FILTER (gold = got) / nullif(count(gold), 0), 9) AS recall, count(*) FILTER (gold <> got) AS false_merges FROM (SELECT lang, CASE WHEN l.toxic = 0 THEN 'e' || (doc_id % 7) END AS gold, CASE WHEN doc_id % 5 <> 0 THEN 'e' || (doc_id % 7 + CAST(doc_id % 3 = 0 AS INTEGER)) END AS got FROM documents JOIN labels l USING (doc_id)) GROUP BY 1")
def e12(spark, sf_dir):
    """Metrics of labelled resolutions by language: right among the answered, found among those that have an identity, wrong merges."""
    n = F.col("doc_id")
    cases = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "lang",
        F.when(F.col("toxic") == 0, F.concat(F.lit("e"), n % 7)).alias("gold"),
        F.when(n % 5 != 0, F.concat(F.lit("e"), n % 7 + (n % 3 == 0).cast("int"))).alias("got"),
    )
    right = F.count_if(F.col("gold") == F.col("got"))
    of = lambda c: F.round(right / F.nullif(F.count(c), F.lit(0)), 9)
    return cases.groupBy("lang").agg(F.count("*").alias("cases"), of("got").alias("precision"), of("gold").alias("recall"), F.count_if(F.col("gold") != F.col("got")).alias("false_merges"))
