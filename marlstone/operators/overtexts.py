"""The text, date and clean-up functions over the supplied tables' own values, each beside SQL that states its rule.

Their cases by construction (signs, markers and spellings that the supplied texts lack) stand beside the functions; here they
run over documents, raw pages, events, orders and parts as they are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as S
from ..model import PAGES, pages
from ..registry import registry
from ..sources.files import url_problem
from ..views import table
from .cleanup import CATEGORIES, Notices, categorise, cleaned, projected, schema_array, schema_date

QUERIES, SQL, query = registry()
P = f"WITH {PAGES} "


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _steps(start: str, *steps: tuple[str, str], flags: str = "g") -> str:
    """Nested replacements, for DuckDB."""
    for pattern, by in steps:
        start = f"regexp_replace({start}, '{pattern}', '{by}', '{flags}')"
    return start


_SLUG = _steps("lower(strip_accents(substr(text, 1, 80)))", (r"[^\p{Ll}\p{Lm}\p{Lo}\p{M}\p{N}.\s_-]", ""), (r"\s+", "-"), ("-+", "-"), ("^-|-$", ""))


@query("f5_slug_texts", f"SELECT doc_id, {_SLUG} AS slug FROM documents WHERE text IS NOT NULL")
def f5(spark, sf_dir):
    """The beginning of each text as a slug: no accents, no signs, hyphens for white space."""
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", S.slug_segment(F.substring("text", 1, 80)).alias("slug"))


@query("f11_part_keys", "SELECT p_partkey, regexp_replace(lower(p_name || ' & ' || p_brand || ', (' || p_type || ')'), '[\\s.,&''’()-]+', '', 'g') AS key FROM part")
def f11(spark, sf_dir):
    """Parts' names, brands and types as dictionary keys: case, blanks and punctuation do not count."""
    raw = F.concat("p_name", F.lit(" & "), "p_brand", F.lit(", ("), "p_type", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", S.folded_key(raw).alias("key"))


@query("f21_percent_pages", "SELECT page_id, '/wiki/' || url_encode(url) AS path FROM pages")
def f21(spark, sf_dir):
    """Addresses as one segment of a path."""
    encoded = F.replace(F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/wiki/"), F.replace(encoded, F.lit("*"), F.lit("%2A"))).alias("path"))


_TEXT = _steps("regexp_replace(html, '</?(?:sup|sub|em|strong|b|i|span)\\b[^>]*>', '', 'gi')")
_TEXT = f"regexp_replace({_TEXT}, '</?(?:table|thead|tbody|tfoot|tr|td|th|div|p|br|li|ul|ol|h[1-6])\\b[^>]*>', ' ', 'gi')"
for _name, _sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("amp", "&")):
    _TEXT = f"regexp_replace({_TEXT}, '&{_name};', '{_sign}', 'gi')"
_TEXT = f"trim(regexp_replace(translate(regexp_replace({_TEXT}, '\\\\([!\"#$%&''()*+,\\-./:;<=>?@\\[\\]^_`{{|}}~\\\\])', '\\1', 'g'), '‘’“”', '''''\"\"'), '\\s+', ' ', 'g'))"


@query("f14_evidence_pages", f"SELECT page_id, length({_TEXT}) AS n, sha256({_TEXT}) AS hash FROM pages WHERE NOT regexp_matches(html, '&#|&amp;(nbsp|lt|gt|quot|apos|amp|#)')")
def f14(spark, sf_dir):
    """Raw pages as evidence texts: tags gone, entities read, plain quotes, single spaces. (An entity that spells another one is read once;
    numbers are read, too: these are left to the tests, as SQL reads names only, one after another.)"""
    rows = table(spark, sf_dir, "pages").where(~F.col("html").rlike("&#|&amp;(nbsp|lt|gt|quot|apos|amp|#)"))
    t = S.evidence_text(F.col("html"))
    return rows.select("page_id", F.char_length(t).cast("long").alias("n"), F.sha2(t, 256).alias("hash"))


@query("f23_parts_documents", "SELECT doc_id, CAST(k AS INTEGER) AS part, CAST(6000 * k AS INTEGER) AS start, CAST(least(6000 * (k + 1), length(text)) AS INTEGER) AS stop FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 6000.0) AS BIGINT))) AS k FROM documents WHERE text <> '' AND NOT contains(text, chr(10) || chr(10)))")
def f23(spark, sf_dir):
    """Whole texts in parts of 6000 characters at most (texts with blank lines end parts there: see f23_parts)."""
    split = F.pandas_udf(lambda s: s.map(lambda t: [{"start": a, "stop": b} for a, b, _ in S.parts_of(t, 6000)]), "array<struct<start:int,stop:int>>")
    rows = _docs(spark, sf_dir).where((F.col("text") != "") & ~F.contains("text", F.lit("\n\n"))).select("doc_id", F.posexplode(split("text")).alias("part", "p"))
    return rows.select("doc_id", "part", "p.start", "p.stop")


@query("f25_fenced_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_type || chr(10) || event_id AS note FROM events")
def f25(spark, sf_dir):
    """Properties of events with a note that holds a raw line end, in a fence, as a model would answer: repaired and read."""
    raw = F.concat(F.lit("```json\n"), F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "note": "'), "event_type", F.lit("\n"), "event_id", F.lit('"}\n```'))
    fixed = F.pandas_udf(lambda s: s.map(S.repaired), "string")(raw)
    rows = table(spark, sf_dir, "events").select("event_id", fixed.alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.k").alias("k"), F.get_json_object("j", "$.note").alias("note"))


_NUMBER = r"\(?[+-]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)\)?"
_PLAIN = _steps("replace(x, ',', '')", (r"^\((.*)\)$", r"-\1"), (r"^\+", ""), (r"(\.\d*?)0+$", r"\1"), (r"\.$", ""), flags="")


@query("n4_numbers_texts", f"SELECT doc_id, len(w) AS n, sha256(array_to_string(list_transform(w, lambda x: {_PLAIN}), ' ')) AS hash FROM (SELECT doc_id, regexp_extract_all(text, '{_NUMBER}') AS w FROM documents WHERE text IS NOT NULL)")
def n4(spark, sf_dir):
    """All numbers of each text (versions, telephone and card numbers, addresses) in one form."""
    found = S.numbers(F.col("text"))
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.size(found).cast("long").alias("n"), F.sha2(F.array_join(found, " "), 256).alias("hash"))


@query("s11_page_urls", "SELECT page_id, CASE WHEN NOT regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+') THEN 'no address' WHEN NOT regexp_matches(url, '^https?://') THEN 'scheme' WHEN regexp_matches(url, '^[a-z]+://[^/?#]*@') THEN 'credentials' WHEN regexp_matches(url, '^[a-z]+://(localhost|127\\.|10\\.|192\\.168\\.)') THEN 'private' END AS problem FROM pages")
def s11(spark, sf_dir):
    """Which of the pages' own addresses may not be fetched."""
    return table(spark, sf_dir, "pages").select("page_id", url_problem(F.col("url")).alias("problem"))


def _days(spark, sf_dir):
    """Orders with the day as text, and a quote that writes the day, the next one or the day a month later, in four spellings."""
    day = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, day).when(k % 3 == 1, F.date_add(day, 1)).otherwise(F.add_months(day, 1))
    spelt = F.when(k % 4 == 0, F.date_format(said, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(said, "d MMM yyyy")).when(k % 4 == 2, F.date_format(said, "MMMM d, yyyy")).otherwise(F.date_format(said, "yyyy/M/d"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"), said.alias("said"), F.concat(F.lit("On "), spelt, F.lit(" we wrote")).alias("quote"))


@query("d6_order_days", "SELECT o_orderkey, o_orderkey % 3 = 0 AS quoted FROM orders")
def d6(spark, sf_dir):
    """Whether a quote writes the order's day out."""
    return _days(spark, sf_dir).select("o_orderkey", S.date_quoted(F.col("day"), F.col("quote")).alias("quoted"))


@query("d4_order_days", "SELECT o_orderkey, CASE WHEN said >= DATE '2000-01-01' THEN strftime(said, '%Y-%m-%d') END AS date FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN d WHEN 1 THEN d + 1 ELSE CAST(d + INTERVAL 1 MONTH AS DATE) END AS said FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders))")
def d4(spark, sf_dir):
    """Days read from quotes; the forms are those of this century."""
    return _days(spark, sf_dir).select("o_orderkey", F.date_format(S.explicit_date(F.col("quote")), "yyyy-MM-dd").alias("date"))


#: License lines of the supplied texts as a distributor's notices, and a sentence that many documents share.
LICENSES = Notices(["Licensed under the Apache License, Version 2.0.", "All rights reserved.", "Licensed under CC BY-NC 4.0."])
_LINES = "string_split(text, chr(10))"
_CUT = "replace(replace(replace(l, 'Licensed under the Apache License, Version 2.0.', ''), 'All rights reserved.', ''), 'Licensed under CC BY-NC 4.0.', '')"
_KEPT = f"list_transform(range(1, len(w) + 1), lambda i: CASE WHEN {_CUT.replace('(l,', '(w[i],')} <> w[i] AND regexp_full_match({_CUT.replace('(l,', '(w[i],')}, '[\\s#>*_~\\\\，,：:！!。.-]*') THEN '' ELSE {_CUT.replace('(l,', '(w[i],')} END)"


@query("t7_notices_texts", f"SELECT doc_id, len(list_filter(w, lambda l: {_CUT} <> l)) AS removed, sha256(CASE WHEN len(list_filter(w, lambda l: {_CUT} <> l)) > 0 THEN regexp_replace(array_to_string({_KEPT}, chr(10)), '(?:\\r?\\n){{3,}}', chr(10) || chr(10), 'g') ELSE text END) AS hash FROM (SELECT doc_id, text, {_LINES} AS w FROM documents WHERE text <> '' AND NOT regexp_matches(text, '[\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]') AND NOT regexp_full_match(array_to_string(list_transform(string_split(text, chr(10)), lambda l: {_CUT}), ''), '\\s*'))")
def t7(spark, sf_dir):
    """License lines taken out of every text (as a page of its own): how many, and what is left."""
    found = _docs(spark, sf_dir).where("text <> ''").where(~F.col("text").rlike("[\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"))
    mark = "## PDF 第 1 页\n"
    rows = found.select("doc_id", cleaned(F.concat(F.lit(mark), "text"), LICENSES).alias("c")).where(F.startswith("c.body", F.lit(mark)))
    return rows.select("doc_id", F.size("c.removed").cast("long").alias("removed"), F.sha2(F.substring("c.body", len(mark) + 1, 1 << 30), 256).alias("hash"))


@query("b6_blocks_after_cleanup", f"SELECT action, count(*) AS blocks FROM (SELECT CASE WHEN l = {_CUT} THEN 'unchanged' WHEN trim({_CUT}) = '' THEN 'deleted' ELSE 'updated' END AS action FROM (SELECT unnest({_LINES}) AS l FROM documents WHERE text <> '' AND doc_id IN (SELECT min(doc_id) FROM documents WHERE text <> '' GROUP BY text)) WHERE trim(l) <> '' AND (contains(l, 'Licensed') OR contains(l, 'All rights'))) GROUP BY 1")
def b6(spark, sf_dir):
    """What becomes of the stored lines that speak of licences when their texts are cleaned: cut, gone, or as they were."""
    one = _docs(spark, sf_dir).where("text <> ''").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    body = F.concat(F.lit("## PDF 第 1 页\n"), "text")
    rows = one.select("doc_id", body.alias("body"), cleaned(body, LICENSES)["keep"].alias("keep"), F.explode(F.split("text", "\n")).alias("chunk"))
    rows = rows.where((F.trim("chunk") != "") & (F.contains("chunk", F.lit("Licensed")) | F.contains("chunk", F.lit("All rights"))))
    import pandas as pd

    run = F.pandas_udf(lambda b, k, t: pd.Series([projected(x, list(y), z) for x, y, z in zip(b, k, t)]), "string")
    new = run("body", "keep", "chunk")
    action = F.when(new.isNull(), "error").when(F.trim(new) == "", "deleted").when(new == F.col("chunk"), "unchanged").otherwise("updated")
    return rows.select(action.alias("action")).groupBy("action").agg(F.count("*").alias("blocks"))


#: Rules by words of the supplied languages.
_RULES = tuple((where, rf"(?:^|[^\p{{L}}])(?:{words})(?:[^\p{{L}}]|$)", category) for where, words, category in (("head", "the|and", "macro"), ("whole", "der|die|und", "industry"), ("head", "les|que", "theme")))


@query("t5_classify_texts", "SELECT doc_id, CASE WHEN regexp_matches(regexp_extract(t, '^[^:：]*', 0), '(?i)(?:^|[^\\p{L}])(?:the|and)(?:[^\\p{L}]|$)') THEN 'macro' WHEN regexp_matches(t, '(?i)(?:^|[^\\p{L}])(?:der|die|und)(?:[^\\p{L}]|$)') THEN 'industry' WHEN regexp_matches(regexp_extract(t, '^[^:：]*', 0), '(?i)(?:^|[^\\p{L}])(?:les|que)(?:[^\\p{L}]|$)') THEN 'theme' ELSE 'source' END AS category FROM (SELECT doc_id, regexp_replace(substr(coalesce(text, ''), 1, 120), '^\\d{8}[-_][^-_]+[-_]', '') AS t FROM documents)")
def t5(spark, sf_dir):
    """Texts by the first rule that their beginnings meet; the rules are a parameter."""
    from .cleanup import title_category

    assert set(c for *_, c in _RULES) <= set(CATEGORIES)
    found = title_category(F.substring(F.coalesce("text", F.lit("")), 1, 120), _RULES)
    rows = _docs(spark, sf_dir).select("doc_id", F.lit("source").alias("type"), found.alias("category"), F.lit("").alias("title"), F.array().cast("array<string>").alias("topics"))
    return categorise(rows, "doc_id")


@query("t2_metadata_texts", "SELECT doc_id, array_to_string(list_filter(w, lambda x, i: trim(x) <> '' AND list_position(w, x) = i), '|') AS words, strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS day FROM (SELECT doc_id, string_split(substr(coalesce(text, ''), 1, 200), ' ') AS w FROM documents)")
def t2(spark, sf_dir):
    """Words of each text's beginning as a list in its schema, and a time as a day."""
    n = F.col("doc_id")
    stamp = F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 365).cast("int")), "yyyy-MM-dd"), F.lit("T10:00:00Z"))
    words = F.split(F.substring(F.coalesce("text", F.lit("")), 1, 200), " ")
    return _docs(spark, sf_dir).select("doc_id", F.array_join(schema_array(words), "|").alias("words"), schema_date(stamp).alias("day"))


@query("f6_relation_targets", f"{P} SELECT document_id, supported_by AS target FROM pages_ WHERE supported_by IS NOT NULL")
def f6(spark, sf_dir):
    """Targets of the pages' relations, written as links with a label or without one."""
    n = F.col("doc_id")
    link = F.when(n % 2 == 0, F.concat(F.lit("[["), "supported_by", F.lit("|"), "title", F.lit("]]"))).otherwise(F.concat(F.lit("[["), "supported_by", F.lit("]]")))
    return pages(spark, sf_dir).where("supported_by is not null").select("document_id", S.relation_target(link).alias("target"))


def _markdown(spark, sf_dir):
    """Raw pages with their headings and links as marks of a wiki text."""
    body = F.regexp_replace("html", r"<h([1-6])[^>]*>([^<]*)</h[1-6]>", "\n#h$1 $2\n")
    for k in range(1, 7):
        body = F.replace(body, F.lit(f"\n#h{k} "), F.lit("\n" + "#" * k + " "))
    body = F.regexp_replace(body, r'<a href="/([^"<>|\[\]]*)">([^<|\[\]]*)</a>', r"[[$1|$2]]")
    return table(spark, sf_dir, "pages").select("page_id", body.alias("body"))


@query("r6_outline_pages", "SELECT page_id, CAST(i - 1 AS INTEGER) AS at, CAST(regexp_extract(h[i], '^<h([1-6])', 1) AS INTEGER) AS level, regexp_extract(h[i], '>([^<]*)<', 1) AS title FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, list_filter(regexp_extract_all(html, '<h[1-6][^>]*>[^<]*</h[1-6]>'), lambda x: NOT regexp_matches(x, '>\\s*<')) AS h FROM pages))")
def r6(spark, sf_dir):
    """Headings of the raw pages, in order, with their levels."""
    rows = _markdown(spark, sf_dir).select("page_id", F.posexplode(S.headings(F.col("body"))).alias("at", "h"))
    return rows.select("page_id", "at", "h.level", "h.title")


@query("r7_links_of_pages", "SELECT page_id, count(*) AS links, sha256(string_agg(regexp_extract(l, 'href=\"/([^\"]*)\"', 1) || '>' || regexp_extract(l, '>([^<]*)<', 1), ' ' ORDER BY i)) AS hash FROM (SELECT page_id, unnest(l) AS l, unnest(range(len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"/[^\"<>|\\[\\]]*\">[^<|\\[\\]]*</a>') AS l FROM pages)) GROUP BY 1")
def r7(spark, sf_dir):
    """Links of the raw pages: targets and labels, in order."""
    links = F.regexp_extract_all("body", F.lit(r"\[\[([^\]\[]+)\]\]"), 1)
    pairs = F.transform(links, lambda x: F.replace(x, F.lit("|"), F.lit(">")))
    rows = _markdown(spark, sf_dir).select("page_id", pairs.alias("l")).where("size(l) > 0")
    return rows.select("page_id", F.size("l").cast("long").alias("links"), F.sha2(F.array_join("l", " "), 256).alias("hash"))


@query("d3_order_paths", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN strftime(d, '%Y-%m') || '-01' ELSE strftime(d, '%Y-%m-%d') END AS date, CASE o_orderkey % 3 WHEN 0 THEN 'filename' WHEN 1 THEN 'directory' ELSE 'month-directory' END AS source FROM (SELECT o_orderkey, CAST(o_orderdate + INTERVAL 28 YEAR AS DATE) AS d FROM orders)")
def d3(spark, sf_dir):
    """Days of orders (of this century) read from paths: in the name, in a directory, or only the month."""
    k = F.col("o_orderkey")
    day = F.add_months(F.col("o_orderdate").cast("date"), 12 * 28)
    said, month = F.date_format(day, "yyyyMMdd"), F.date_format(day, "yyyy-MM")
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    path = F.when(k % 3 == 0, say("reports/", month, "/", said, "_order", k.cast("string"), ".pdf")).when(k % 3 == 1, say("reports/", F.date_format(day, "yyyy-MM-dd"), "/order", k.cast("string"), ".pdf")).otherwise(say("reports/", month, "/order.pdf"))
    date, source = S.report_date(path, month)
    return table(spark, sf_dir, "orders").select("o_orderkey", date.alias("date"), source.alias("source"))


_SNIP = "replace(html, chr(13), '')"
for _pattern, _by in (
    (r"!\[[^\]]*\]\([^)]*\)", ""), (r"(?i)<img[^>]*>", ""), (r"(?s)\$\$.*?\$\$", " [公式] "), (r"\$\$", " "), (r"(?m)^[^\n]*(\\[a-zA-Z]+\s*[{(]|_ \{|\^ \{)[^\n]*$", "[公式]"), (r"(\[公式\]\s*){2,}", "[公式] "),
    (r"(?m)^#{1,6}\s+", ""), (r"(?m)^>\s?", ""), (r"\*\*|__", ""), (r"[ \t]+", " "), (r"\n{2,}", "\n"),
):
    _SNIP = f"regexp_replace({_SNIP}, '{_pattern}', '{_by}', 'g')"
_SNIP = f"regexp_replace({_SNIP}, '^\\s+|\\s+$', '', 'g')"


@query("f16_snippet_pages", f"SELECT page_id, CASE WHEN length(s) <= 700 THEN s ELSE substr(s, 1, 700) || ' …' END AS snippet FROM (SELECT page_id, {_SNIP} AS s FROM pages)")
def f16(spark, sf_dir):
    """Raw pages as snippets for reading: what looks like formulas is one word, marks and repeated blanks are gone."""
    return table(spark, sf_dir, "pages").select("page_id", S.trimmed_snippet(F.col("html")).alias("snippet"))
