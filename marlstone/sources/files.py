"""File sources: pages with parsed headers, manifests, journals, archives, spreadsheets, security masters, plans by month.

Queries write a small example with Spark into the session's folder and read it back through the source.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import scratch
from ..registry import registry
from ..views import table
from .connectors import manifest, markdown

QUERIES, SQL, query = registry()

try:  # YAML headers need a parser; without one, flat "key: value" headers are read
    import yaml
except ModuleNotFoundError:
    yaml = None


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def header_fields(text: str | None) -> tuple[str | None, str | None]:
    """A YAML header as JSON, or its error."""
    if text is None:
        return "{}", None
    try:
        if yaml is not None:
            value = yaml.safe_load(text)
        else:
            value = dict(re.fullmatch(r"([\w-]+):\s*(.*)", line).groups() for line in text.splitlines() if line.strip())
    except Exception as problem:
        return None, type(problem).__name__
    if value is None:
        return "{}", None
    if not isinstance(value, dict):
        return None, "NotAMapping"
    return json.dumps(value, default=str, sort_keys=True, ensure_ascii=False), None


def with_header(files: DataFrame) -> DataFrame:
    """files (front_matter, body, ...) with meta (JSON) and error; a header that cannot be read leaves meta empty and tells why."""

    def run(texts: pd.Series) -> pd.DataFrame:
        found = [header_fields(t) for t in texts]
        return pd.DataFrame({"meta": [m for m, _ in found], "error": [e for _, e in found]})

    parsed = F.pandas_udf(run, "meta string, error string")(F.col("front_matter"))
    return files.withColumn("_h", parsed).withColumn("meta", F.coalesce("_h.meta", F.lit("{}"))).withColumn("error", F.col("_h.error")).drop("_h")


def _pages(spark, sf_dir) -> str:
    """Pages of the nations, one file each, in folders by slug."""
    path, k = _folder(spark, "pages"), F.col("n_nationkey")
    head = F.when(k % 3 == 2, _say("title: [damaged")).otherwise(_say("title: ", F.col("n_name"), "\ntags:\n  - a\n  - ", k.cast("string"), "\ndate: 2024-02-01"))
    text = _say("---\n", head, "\n---\n# Body ", k, "\ntext")
    rows = table(spark, sf_dir, "nation").select(text.alias("value"), F.concat(F.lit("p-"), k).alias("slug"))
    rows.write.partitionBy("slug").text(path)
    return path


def _read(spark, sf_dir) -> DataFrame:
    return with_header(markdown(spark, _pages(spark, sf_dir), "*.txt")).withColumn("slug", F.regexp_extract("path", "slug=([^/]+)", 1))


@query("s1_inventory", "SELECT 'p-' || n_nationkey AS slug, true AS present FROM nation")
def s1(spark, sf_dir):
    """Every page under a folder with its slug, length and time."""
    return _read(spark, sf_dir).select("slug", ((F.col("length") > 10) & F.col("modified").isNotNull()).alias("present"))


@query("s3_header_only", "SELECT 'p-' || n_nationkey AS slug, CASE WHEN n_nationkey % 3 <> 2 THEN n_name END AS title FROM nation")
def s3(spark, sf_dir):
    """Headers kept as a table of their own: later reads prune to the columns they need and open no page."""
    path = _folder(spark, "headers")
    _read(spark, sf_dir).select("slug", F.get_json_object("meta", "$.title").alias("title"), "meta").write.parquet(path)
    return spark.read.parquet(path).select("slug", "title")


@query("s4_front_matter", "SELECT 'p-' || n_nationkey AS slug, n_nationkey % 3 = 2 AS damaged, CASE WHEN n_nationkey % 3 <> 2 THEN 'a,' || n_nationkey ELSE '' END AS tags, '# Body ' || n_nationkey || chr(10) || 'text' AS body FROM nation")
def s4(spark, sf_dir):
    """Header and body apart; a damaged header is an error beside empty fields, and the body stays."""
    tags = F.coalesce(F.from_json(F.get_json_object("meta", "$.tags"), "array<string>"), F.array().cast("array<string>"))
    return _read(spark, sf_dir).select("slug", F.col("error").isNotNull().alias("damaged"), F.array_join(tags, ",").alias("tags"), F.regexp_replace("body", "\n$", "").alias("body"))


def _manifest(spark, sf_dir) -> str:
    """A manifest of the suppliers, as one JSON file; two of its records share a slug."""
    path, k = _folder(spark, "manifest"), F.col("s_suppkey")
    record = F.to_json(F.struct(_say("m-", F.greatest(k, F.lit(2))).alias("slug"), F.when(k % 3 == 0, "failed").otherwise("indexed").alias("status"), F.when(k % 4 == 0, "many").otherwise((k % 7).cast("string")).alias("pages"), F.sha2(k.cast("string"), 256).alias("sha256")))
    one = table(spark, sf_dir, "supplier").agg(F.array_sort(F.collect_list(_say('"', F.lpad(k.cast("string"), 9, "0"), '":', record))).alias("r"))  # one file
    one.select(_say('{"documents":{', F.array_join("r", ","), "}}").alias("value")).coalesce(1).write.text(path)
    return path


@query("s5_manifest_slugs", "SELECT min(s_suppkey) AS id, 'm-' || greatest(s_suppkey, 2) AS slug FROM supplier GROUP BY 2")
def s5(spark, sf_dir):
    """The manifest by slug; of two records the first counts."""
    rows = manifest(spark, _manifest(spark, sf_dir)).select(F.col("id").cast("long").alias("id"), "slug")
    return rows.groupBy("slug").agg(F.min("id").alias("id"))


@query("s6_manifest_counts", "SELECT count(*) AS documents, count(*) FILTER (s_suppkey % 3 <> 0) AS indexed, count(*) FILTER (s_suppkey % 3 = 0) AS failed, CAST(sum(CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey % 7 END) AS BIGINT) AS pages FROM supplier")
def s6(spark, sf_dir):
    """Records by status and the sum of their pages; a page count that is no number is none."""
    rows = manifest(spark, _manifest(spark, sf_dir))
    return rows.agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum(F.coalesce(F.col("pages").try_cast("int"), F.lit(0))).alias("pages"))


def unzipped(path: str, content: bytes, most: int = 100_000_000) -> list[dict]:
    """Members of a ZIP file: refused with a reason if a name leaves the folder, stands twice, or is too large, or its CRC is wrong."""
    out, seen = [], set()
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                problem = None
                if info.filename.startswith("/") or ".." in re.split(r"[\\/]", info.filename):
                    problem = "traversal"
                elif info.filename in seen:
                    problem = "duplicate"
                elif info.file_size > most:
                    problem = "too large"
                seen.add(info.filename)
                body = None
                if problem is None and not info.is_dir():
                    try:
                        body = z.read(info)
                        problem = None if zlib.crc32(body) == info.CRC else "crc"
                    except Exception:
                        problem, body = "crc", None
                out.append({"path": path, "name": info.filename, "size": info.file_size, "problem": problem, "content": body})
    except zipfile.BadZipFile:
        out.append({"path": path, "name": None, "size": None, "problem": "not a zip", "content": None})
    return out


_MEMBERS = "path string, name string, size long, problem string, content binary"


def zipped(files: DataFrame) -> DataFrame:
    """Members of ZIP files (path, content), a file at a time."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(unzipped(path, content), columns=["path", "name", "size", "problem", "content"])

    return files.select("path", "content").mapInPandas(run, _MEMBERS)


def _zips(k: pd.Series) -> pd.Series:
    """A ZIP for each number: a text, and by the number a name that leaves the folder, one that stands twice, or nothing more."""

    def one(n: int) -> bytes:
        import warnings

        if n % 4 == 3:
            return b"no zip"
        buffer = io.BytesIO()
        with warnings.catch_warnings(), zipfile.ZipFile(buffer, "w") as z:
            warnings.simplefilter("ignore")
            z.writestr("a.txt", f"text {n}")
            if n % 4 == 1:
                z.writestr("../b.txt", "x")
            if n % 4 == 2:
                z.writestr("a.txt", "again")
        return buffer.getvalue()

    return k.map(one)


@query("s9_zip_members", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 3 THEN NULL WHEN m = 1 THEN 'a.txt' WHEN n_nationkey % 4 = 1 THEN '../b.txt' ELSE 'a.txt' END AS name, CASE WHEN n_nationkey % 4 = 3 THEN 'not a zip' WHEN m = 2 AND n_nationkey % 4 = 1 THEN 'traversal' WHEN m = 2 THEN 'duplicate' END AS problem, CASE WHEN m = 1 AND n_nationkey % 4 <> 3 THEN 'text ' || n_nationkey END AS text FROM nation, (SELECT unnest([1, 2]) AS m) WHERE m = 1 OR n_nationkey % 4 IN (1, 2)")
def s9(spark, sf_dir):
    k = F.col("n_nationkey")
    files = table(spark, sf_dir, "nation").select(k.cast("string").alias("path"), F.pandas_udf(_zips, "binary")(k).alias("content"))
    return zipped(files).select(F.col("path").cast("int").alias("k"), "name", "problem", F.col("content").cast("string").alias("text"))


def private_address(host: Column) -> Column:
    """Whether a host is this machine, a private network, or a part of the address space that is not for the public."""
    octet = lambda i: F.split_part(host, F.lit("."), F.lit(i)).try_cast("int")
    a, b = octet(1), octet(2)
    four = host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
    reserved = a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
    six = host.rlike("(?i)^\\[?(?:::1|::|f[cd][0-9a-f]{2}:|fe80:)")
    return (four & reserved) | six | (F.lower(host) == "localhost") | F.endswith(F.lower(host), F.lit(".localhost"))


def url_problem(url: Column) -> Column:
    """Why an address may not be fetched; null if it may."""
    scheme, user, host = (F.try_parse_url(url, F.lit(p)) for p in ("PROTOCOL", "USERINFO", "HOST"))
    return F.when(host.isNull() | scheme.isNull(), "no address").when(~F.lower(scheme).isin("http", "https"), "scheme").when(user.isNotNull(), "credentials").when(private_address(host), "private")


@query("s11_url_rules", "SELECT page_id, CASE page_id % 8 WHEN 1 THEN 'scheme' WHEN 2 THEN 'credentials' WHEN 3 THEN 'private' WHEN 4 THEN 'private' WHEN 5 THEN 'private' WHEN 6 THEN 'no address' END AS problem FROM pages")
def s11(spark, sf_dir):
    k = F.col("page_id") % 8
    url = F.when(k == 1, "ftp://a.org/x").when(k == 2, "https://u:p@a.org/").when(k == 3, "http://10.1.2.3/").when(k == 4, "http://172.20.0.1:80/").when(k == 5, "http://a.localhost/").when(k == 6, "nothing").when(k == 7, "http://172.32.0.1/").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", url_problem(url).alias("problem"))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(content: bytes) -> list[dict[str, str]]:
    """Rows of a workbook's first sheet, column letter to text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        out = []
        for row in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iterfind(".//m:row", _NS):
            cells = {}
            for c in row.findall("m:c", _NS):
                value = c.find("m:v", _NS)
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else (value.text if value is not None else None)
                if text is not None:
                    cells[re.match("[A-Z]+", c.get("r"))[0]] = shared[int(text)] if c.get("t") == "s" else text
            out.append(cells)
        return out


def _workbook(k: pd.Series) -> pd.Series:
    """A small workbook for each number: a heading by shared texts, a number, a text in the cell itself."""

    def one(n: int) -> bytes:
        ns = f'xmlns="{_NS["m"]}"'
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Code</t></si><si><r><t>Na</t></r><r><t>me</t></r></si></sst>")
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>{n}</v></c><c r="B2" t="inlineStr"><is><t>N {n}</t></is></c></row></sheetData></worksheet>')
        return buffer.getvalue()

    return k.map(one)


@query("s14_xlsx_rows", "SELECT n_nationkey, CAST(k AS INTEGER) AS row, CASE k WHEN 0 THEN 'Code' ELSE CAST(n_nationkey AS VARCHAR) END AS a, CASE k WHEN 0 THEN 'Name' ELSE 'N ' || n_nationkey END AS b FROM nation, range(2) t(k)")
def s14(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = F.pandas_udf(lambda s: s.map(lambda b: [json.dumps(r) for r in sheet_rows(b)]), "array<string>")
    sheets = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(rows(F.pandas_udf(_workbook, "binary")(k))).alias("row", "cells"))
    return sheets.select("n_nationkey", "row", F.get_json_object("cells", "$.A").alias("a"), F.get_json_object("cells", "$.B").alias("b"))


def security_master(columnar: DataFrame, listed: DataFrame) -> DataFrame:
    """market, code, name of two official lists: columnar (fields array, data array of arrays; the fields must be the known ones) and
    a script (value) with objects of quoted codes and names."""
    expected = F.array(*[F.lit(x) for x in ("cik", "name", "ticker", "exchange")])
    checked = columnar.where(F.when(F.col("fields") == expected, True).otherwise(F.raise_error(F.lit("the list's columns changed")).cast("boolean")))
    us = checked.select(F.explode("data").alias("d")).select(F.lit("US").alias("market"), F.col("d")[2].alias("code"), F.col("d")[1].alias("name"))
    pairs = listed.select(F.explode(F.regexp_extract_all("value", F.lit(r"\{code:'\d{6}',name:'[^']*'\}"), 0)).alias("o"))
    sh = pairs.select(F.lit("SH").alias("market"), F.regexp_extract("o", r"code:'(\d{6})'", 1).alias("code"), F.regexp_extract("o", r"name:'([^']*)'", 1).alias("name"))
    return us.union(sh)


@query("s15_security_master", "SELECT 'US' AS market, 'T' || s_suppkey AS code, s_name AS name FROM supplier UNION ALL SELECT 'SH', lpad(CAST(n_nationkey AS VARCHAR), 6, '0'), n_name FROM nation")
def s15(spark, sf_dir):
    """Securities of a columnar JSON list and of a script."""
    data = F.collect_list(F.array(F.lit("1"), F.col("s_name"), _say("T", F.col("s_suppkey")), F.lit("Nasdaq")))
    path = _folder(spark, "master")
    one = table(spark, sf_dir, "supplier").agg(data.alias("data")).select(F.array(F.lit("cik"), F.lit("name"), F.lit("ticker"), F.lit("exchange")).alias("fields"), "data")
    one.coalesce(1).write.json(path)
    script = table(spark, sf_dir, "nation").agg(_say("var list=[", F.array_join(F.collect_list(_say("{code:'", F.lpad(F.col("n_nationkey").cast("string"), 6, "0"), "',name:'", F.col("n_name"), "'}")), ","), "];").alias("value"))
    return security_master(spark.read.schema("fields array<string>, data array<array<string>>").json(path), script)


def registry_of(spark: SparkSession, folder: str, names: tuple[str, ...] = ("registry", "rules", "relations")) -> dict[str, DataFrame]:
    """Tables of a registry's folder; a file that is not there is an empty table."""
    from pyspark.errors import AnalysisException

    schema = "entity_id string, type string, name string, aliases array<string>"
    out = {}
    for name in names:
        try:
            out[name] = spark.read.schema(schema).json(f"{folder}/{name}")
            out[name].limit(1).count()
        except AnalysisException:
            out[name] = spark.createDataFrame([], schema)
    return out


@query("s16_registry_files", "SELECT unnest(['registry', 'rules', 'relations']) AS name, unnest([(SELECT count(*) FROM nation), 0, 0]) AS rows")
def s16(spark, sf_dir):
    folder, k = _folder(spark, "registry"), F.col("n_nationkey")
    table(spark, sf_dir, "nation").select(_say("entity:n:", k).alias("entity_id"), F.lit("topic").alias("type"), F.col("n_name").alias("name"), F.array(F.col("n_name")).alias("aliases")).write.json(f"{folder}/registry")
    arms = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, rows in registry_of(spark, folder).items()]
    return arms[0].union(arms[1]).union(arms[2])


@query("s19_month_plan", "SELECT CAST(m AS INTEGER) AS month, count(p_partkey) AS reports FROM range(1, 13) t(m) LEFT JOIN part ON p_partkey % 10 + 1 = m GROUP BY 1")
def s19(spark, sf_dir):
    """Reports by month folder, months without any included."""
    k = F.col("p_partkey")
    paths = table(spark, sf_dir, "part").select(_say("reports/2024/", F.lpad((k % 10 + 1).cast("string"), 2, "0"), "/r", k, ".pdf").alias("path"))
    found = paths.select(F.regexp_extract("path", r"/2024/(\d{2})/", 1).cast("int").alias("month")).groupBy("month").agg(F.count("*").alias("n"))
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(found, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("reports"))


def folded_journal(lines: DataFrame, fields: list[str]) -> DataFrame:
    """Fields of each id after a journal (file, n, value: lines by number), a later value over an earlier, missing ones kept. A line that
    is no JSON may be the last of its file; anywhere else it is an error."""
    parsed = lines.withColumn("ok", F.try_parse_json("value").isNotNull())
    last = lines.groupBy("file").agg(F.max("n").alias("_last"))
    # The error is a part of the id, so that no filter on the id comes before it.
    id_ = F.when(F.col("ok"), F.get_json_object("value", "$.id")).when(F.col("n") == F.col("_last"), F.lit(None).cast("string")).otherwise(F.raise_error(F.lit("a line of the journal is damaged")).cast("string"))
    rows = parsed.join(F.broadcast(last), "file").select(id_.alias("id"), F.struct("file", "n").alias("at"), *[F.get_json_object("value", f"$.{f}").alias(f) for f in fields]).where("id is not null")
    return rows.groupBy("id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("at"))).alias(f) for f in fields])


@query("s20_journal_replay", "SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, event_id) AS status, CAST(max(event_id) FILTER (event_id % 3 = 0) AS VARCHAR) AS note FROM events GROUP BY 1")
def s20(spark, sf_dir):
    """A journal of events written as lines, its last line cut off, and replayed."""
    path = _folder(spark, "journal")
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).alias("note")))
    rows = e.select(F.col("event_id").alias("n"), line.alias("value")).union(e.agg((F.max("event_id") + 1).alias("n"), F.lit('{"id": "cut').alias("value")))
    rows.select(F.lit("one").alias("file"), "n", "value").write.parquet(path)
    return folded_journal(spark.read.parquet(path), ["status", "note"])


@query("s22_page_map", "SELECT doc_id, CAST(k AS INTEGER) AS block, CAST(k // 2 + 1 AS INTEGER) AS page, CASE k WHEN 0 THEN 'head ' || doc_id WHEN 1 THEN repeat('x', 500) ELSE 'tail' END AS text FROM documents, range(3) t(k)")
def s22(spark, sf_dir):
    """Blocks of a parser's content list with their pages (counted from 1) and at most 500 characters of text."""
    block = lambda page, text: F.struct(F.lit(page).alias("page_idx"), F.lit("text").alias("type"), text.alias("text"))
    content = F.to_json(F.array(block(0, _say("head ", F.col("doc_id"))), block(0, F.repeat(F.lit("x"), 600)), block(1, F.lit("tail"))))
    parsed = F.from_json(content, "array<struct<page_idx:int,type:string,text:string>>")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parsed).alias("block", "b"))
    return rows.select("doc_id", "block", (F.col("b.page_idx") + 1).alias("page"), F.left("b.text", F.lit(500)).alias("text"))


def rendered(template: Column, values: Column) -> Column:
    """A template with its {{names}} replaced by the values of a map; names without one are left empty."""
    names = F.map_keys(values)
    filled = F.aggregate(names, template, lambda t, k: F.replace(t, F.concat(F.lit("{{"), k, F.lit("}}")), F.coalesce(F.element_at(values, k), F.lit(""))))
    return F.regexp_replace(filled, r"\{\{[^}]*\}\}", "")


@query("s26_templates", "SELECT n_nationkey, '# ' || n_name || ' ()' || chr(10) || 'key ' || n_nationkey AS text FROM nation")
def s26(spark, sf_dir):
    values = F.create_map(F.lit("title"), F.col("n_name"), F.lit("key"), F.col("n_nationkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", rendered(F.lit("# {{title}} ({{none}})\nkey {{key}}"), values).alias("text"))


@query("s27_question_set", "SELECT conv_id AS question, count(*) AS relevant FROM conversations WHERE role = 'user' GROUP BY 1")
def s27(spark, sf_dir):
    """A labelled question set in JSON lines: questions with the ids that answer them."""
    path = _folder(spark, "questions")
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    c.groupBy("conv_id").agg(F.collect_list("turn").alias("ids")).select(F.to_json(F.struct(F.col("conv_id").alias("question"), "ids")).alias("value")).write.text(path)
    back = spark.read.schema("question long, ids array<int>").json(path)
    return back.select("question", F.size("ids").cast("long").alias("relevant"))
