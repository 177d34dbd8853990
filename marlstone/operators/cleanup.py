"""Clean-up of page texts and what follows from it: notices by page, clean bodies, projection onto stored chunks, page lookup,
categories by rule and vote, metadata in its schema."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PAGES, pages
from ..registry import registry
from ..views import table
from .windows import first_per

QUERIES, SQL, query = registry()
P = f"WITH {PAGES} "
_MARK = re.compile(r"^## PDF 第 (\d+) 页\r?$", re.M)
_IMAGE = re.compile(r"!\[[^\]\n]*\]\(([^)\n]+)\)")


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


class Notices:
    """Rules of one distributor's notices: phrases (blanks may stand between their characters), strong signs of a page that
    carries them, lines that go only from such a page (two strong signs or more), and keys of pictures."""

    def __init__(self, phrases=(), strong=(), schedules=(), images=()):
        loose = lambda p: r"[ \t]*".join("[：:]" if c in ":：" else re.escape(c) for c in p)
        self.phrases = [re.compile(loose(p), re.I) for p in sorted(phrases, key=len, reverse=True)]
        self.strong = [re.compile(p) for p in strong]
        self.schedules = {re.sub(r"\s", "", s) for s in schedules}
        self.images = set(images)

    def _line(self, line: str, busy: bool, keep: list[bool], at: int) -> None:
        gone = [m.span() for p in self.phrases for m in p.finditer(line)]
        for a, b in gone:
            keep[at + a : at + b] = [False] * (b - a)
        left = "".join(c for k, c in enumerate(line) if keep[at + k])
        plain = re.sub(r"\s", "", re.sub(r"^\s*#{1,6}\s*", "", left))
        if (busy and plain in self.schedules) or (gone and re.fullmatch(r"[\s#>*_~\\，,：:！!。.-]*", left)):
            keep[at : at + len(line)] = [False] * len(line)

    def clean(self, body: str) -> tuple[str, list[tuple[int | None, str, str]], list[bool]]:
        """Body without notices, what was removed (page, kind, text), and which characters stay. What stands before the first
        page marker is never touched; a page of nothing else goes with its marker."""
        keep, removed = [True] * len(body), []
        marks = [*_MARK.finditer(body)]
        for mark, end in zip(marks, [*(m.start() for m in marks[1:]), len(body)]):
            begin = min(end, mark.end() + 1)
            page, text = int(mark[1]), body[begin:end]
            busy = sum(bool(p.search(text)) for p in self.strong) >= 2
            at = begin
            for line in text.splitlines(keepends=True):
                bare = line.rstrip("\r\n")
                self._line(bare, busy, keep, at)
                if not all(keep[at : at + len(bare)]):
                    removed.append((page, "text", bare))
                at += len(line)
            for m in _IMAGE.finditer(text):
                key = re.search(r"(?:^|/)([0-9a-f]{64})\.(?:jpe?g|png|webp)", m[1], re.I)
                if key and key[1].lower() in self.images:
                    keep[begin + m.start() : begin + m.end()] = [False] * len(m[0])
                    removed.append((page, "image", m[0]))
            if not all(keep[begin:end]) and not "".join(c for k, c in enumerate(text) if keep[begin + k]).strip():
                keep[mark.start() : end] = [False] * (end - mark.start())
                removed.append((page, "empty_page", mark[0]))
        body = "".join(c for c, k in zip(body, keep) if k)
        return (re.sub(r"(?:\r?\n){3,}", "\n\n", body) if removed else body), removed, keep


CLEANED = "struct<body:string,removed:array<struct<page:int,kind:string,text:string>>,keep:array<boolean>>"


def cleaned(body: Column, rules: Notices) -> Column:
    """body, removed, keep of a text column."""

    def run(texts: pd.Series) -> pd.DataFrame:
        found = [rules.clean(t or "") for t in texts]
        removed = [[dict(zip(("page", "kind", "text"), x)) for x in r] for _, r, _ in found]
        return pd.DataFrame({"body": [b for b, _, _ in found], "removed": removed, "keep": [k for _, _, k in found]})

    return F.pandas_udf(run, CLEANED)(body)


#: Rules of the example: two strong signs, a schedule, a picture.
EXAMPLE = Notices(["follow us at: 4711", "ask for more"], [r"4711", r"for more", r"Updated daily"], ["Updated daily at 9"], ["ab" * 32])


def _bodies(spark, sf_dir) -> DataFrame:
    """Pages with notices: in the middle of a line, a schedule beside two strong signs and one beside none, a known picture, and a
    page of nothing else. What stands before the first page is left alone."""
    n = F.col("doc_id")
    one = _say("follow us at: 4711\n## PDF 第 1 页\nbody ", n, " f o l l o w us at： 4711 end\nask for more\nUpdated daily at 9\nlast\n")
    two = _say("## PDF 第 2 页\nUpdated daily at 9\n![x](img/", "ab" * 32, ".png) kept\n")
    three = F.when(n % 2 == 0, "## PDF 第 3 页\nASK FOR MORE\n").otherwise("## PDF 第 3 页\nplain\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(one, two, three).alias("body"))


_CLEAN = "c AS (SELECT doc_id, 'follow us at: 4711' || chr(10) || '## PDF 第 1 页' || chr(10) || 'body ' || doc_id || '  end' || chr(10) || chr(10) || 'last' || chr(10) || '## PDF 第 2 页' || chr(10) || 'Updated daily at 9' || chr(10) || ' kept' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '## PDF 第 3 页' || chr(10) || 'plain' || chr(10) END AS body FROM documents)"


@query("t7_notices", f"WITH {_CLEAN} SELECT doc_id, body, CASE WHEN doc_id % 2 = 0 THEN 6 ELSE 4 END AS removed FROM c")
def t7(spark, sf_dir):
    found = _bodies(spark, sf_dir).select("doc_id", cleaned(F.col("body"), EXAMPLE).alias("c"))
    return found.select("doc_id", "c.body", F.size("c.removed").alias("removed"))


@query("t7_audit", "SELECT doc_id, page, kind, count(*) AS n FROM (SELECT doc_id, unnest([1, 1, 1, 2]) AS page, unnest(['text', 'text', 'text', 'image']) AS kind FROM documents UNION ALL SELECT doc_id, 3, unnest(['text', 'empty_page']) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1, 2, 3")
def t7_audit(spark, sf_dir):
    """What was taken from each page, as rows of their own."""
    removed = _bodies(spark, sf_dir).select("doc_id", F.explode(cleaned(F.col("body"), EXAMPLE)["removed"]).alias("r"))
    return removed.groupBy("doc_id", "r.page", "r.kind").agg(F.count("*").alias("n"))


@query("b5_cleanup_by_kind", "SELECT kind, count(DISTINCT doc_id) AS documents, count(*) AS removed FROM (SELECT doc_id, unnest(['text', 'text', 'text', 'image']) AS kind FROM documents UNION ALL SELECT doc_id, unnest(['text', 'empty_page']) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def b5(spark, sf_dir):
    """What a clean-up of the whole library would take, by kind."""
    removed = _bodies(spark, sf_dir).select("doc_id", F.explode(cleaned(F.col("body"), EXAMPLE)["removed"]["kind"]).alias("kind"))
    return removed.groupBy("kind").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("removed"))


@query("b14_prepared", f"WITH {_CLEAN} SELECT doc_id, sha256(body) AS after, true AS changed FROM c")
def b14(spark, sf_dir):
    """Hashes before and after a clean-up, for the audit."""
    rows = _bodies(spark, sf_dir).select("doc_id", "body", cleaned(F.col("body"), EXAMPLE)["body"].alias("new"))
    return rows.select("doc_id", F.sha2("new", 256).alias("after"), (F.sha2("body", 256) != F.sha2("new", 256)).alias("changed"))


def projected(original: str, keep: list[bool], chunk: str) -> str | None:
    """A chunk of the original (white space aside) without what the clean-up took; null if it is no chunk of it, or stands in
    several places of which different parts were taken."""
    text = [(c, k) for c, k in zip(original, keep) if not c.isspace()]
    plain = "".join(c for c, _ in text)
    bare = "".join(chunk.split())
    if not bare:
        return chunk
    answers, at = set(), plain.find(bare)
    while at >= 0:
        stays = iter(k for _, k in text[at : at + len(bare)])
        answers.add("".join(c for c in chunk if c.isspace() or next(stays)))
        at = plain.find(bare, at + 1)
    if len({"".join(a.split()) for a in answers}) != 1:
        return None
    out = answers.pop() if len(answers) == 1 else min(answers)
    return chunk if "".join(out.split()) == bare else re.sub(r"(?:\r?\n){3,}", "\n\n", out).strip()


@query("t8_projection", "SELECT doc_id, k AS chunk, CASE k WHEN 0 THEN 'body ' || doc_id || ' end' WHEN 1 THEN 'last' WHEN 2 THEN NULL ELSE '' END AS projected FROM documents, range(4) t(k)")
def t8(spark, sf_dir):
    """Stored chunks after the clean-up of their page: cut, unchanged, not of this page, and emptied."""
    n = F.col("doc_id")
    chunks = F.array(_say("body ", n, " f o l l o w us at： 4711\n end"), F.lit("last"), F.lit("nowhere"), F.lit("ask for\nmore"))
    rows = _bodies(spark, sf_dir).select("doc_id", "body", cleaned(F.col("body"), EXAMPLE)["keep"].alias("keep"), F.posexplode(chunks).alias("chunk", "text"))
    run = F.pandas_udf(lambda b, k, t: pd.Series([projected(x, list(y), z) for x, y, z in zip(b, k, t)]), "string")
    return rows.select("doc_id", "chunk", F.regexp_replace(run("body", "keep", "text"), r"\s+", " ").alias("projected"))


@query("b6_chunk_actions", "SELECT doc_id, k AS chunk, CASE k WHEN 0 THEN 'updated' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'error' ELSE 'deleted' END AS action, k = 1 AS keeps_vector FROM documents, range(4) t(k)")
def b6(spark, sf_dir):
    """What becomes of stored chunks, and which keep their vector: only those that did not change."""
    n = F.col("doc_id")
    chunks = F.array(_say("body ", n, " f o l l o w us at： 4711\n end"), F.lit("last"), F.lit("nowhere"), F.lit("ask for\nmore"))
    rows = _bodies(spark, sf_dir).select("doc_id", "body", cleaned(F.col("body"), EXAMPLE)["keep"].alias("keep"), F.posexplode(chunks).alias("chunk", "text"))
    run = F.pandas_udf(lambda b, k, t: pd.Series([projected(x, list(y), z) for x, y, z in zip(b, k, t)]), "string")
    new = run("body", "keep", "text")
    action = F.when(new.isNull(), "error").when(F.trim(new) == "", "deleted").when(new == F.col("text"), "unchanged").otherwise("updated")
    return rows.select("doc_id", "chunk", action.alias("action")).withColumn("keeps_vector", F.col("action") == "unchanged")


def clean_body(body: Column, boundary: str = "<!-- source body -->") -> Column:
    """What counts as the source of a page: behind a reviewed boundary if there is one, else from the first page marker on."""
    behind = F.regexp_extract(body, rf"(?s)(?:^|\n){re.escape(boundary)}\r?\n(.*)$", 1)
    from_page = F.regexp_extract(body, r"(?s)(?:^|\n)(## PDF 第 \d+ 页\r?(?:\n.*)?)$", 1)
    return F.when(F.contains(body, F.lit(boundary)), behind).otherwise(from_page)


@query("t6_clean_body", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'own ' || doc_id WHEN 1 THEN '## PDF 第 1 页' || chr(10) || 'own ' || doc_id ELSE '' END AS body FROM documents")
def t6(spark, sf_dir):
    n = F.col("doc_id")
    raw = F.when(n % 3 == 0, _say("# T\n<!-- source body -->\nown ", n)).when(n % 3 == 1, _say("# T\n## PDF 第 1 页\nown ", n)).otherwise("# T only")
    return table(spark, sf_dir, "documents").select("doc_id", clean_body(raw).alias("body"))


def page_of(body: Column, chunk: Column) -> Column:
    """The page that a chunk stands on: the last marker before the first of its lines (of 24 characters or more) that the body
    holds; else a marker within the chunk."""
    lines = F.filter(F.transform(F.split(chunk, "\r?\n"), lambda x: F.trim(x)), lambda x: (F.char_length(x) >= 24) & ~x.rlike("^[#>]"))
    at = F.get(F.filter(F.transform(lines, lambda x: F.position(F.left(x, F.lit(90)), body)), lambda i: i > 0), 0)
    before = F.regexp_extract_all(F.left(body, F.coalesce(at, F.lit(0)) - 1), F.lit(r"(?m)^## PDF 第 (\d+) 页$"), 1)
    within = F.regexp_extract(chunk, r"(?m)^## PDF 第 (\d+) 页$", 1)
    return F.coalesce(F.try_element_at(before, F.lit(-1)), F.nullif(within, F.lit(""))).cast("int")


@query("t9_chunk_page", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 7 END AS page FROM documents")
def t9(spark, sf_dir):
    n = F.col("doc_id")
    body = _say("# T\n## PDF 第 1 页\nthe first page has this line ", n, "\n## PDF 第 2 页\nthe second page has this line ", n, "\n")
    chunk = F.when(n % 3 == 0, _say("short\nthe second page has this line ", n)).when(n % 3 == 1, _say("> the second page has this line ", n, "\nthe first page has this line ", n)).otherwise("x\n## PDF 第 7 页\ny")
    return table(spark, sf_dir, "documents").select("doc_id", page_of(body, chunk).alias("page"))


#: Categories by title, in order: where (the head before a colon, or the whole), what it holds, the category. A parameter; this is a short set.
RULES = (
    ("head", r"^(?:China|US|Europe|Japan|Global)\s+(?:Watch|Data)", "macro"),
    ("whole", r"纪要|访谈|\b(?:transcript|interview notes|meeting notes)\b", "meeting"),
    ("head", r"估值(?:框架|方法|模型|分析)|\bvaluation (?:framework|model|analysis)\b", "valuation"),
    ("head", r"\(\s*(?:\d{4,6}(?:\.(?:HK|SH|SZ))?|[A-Z]{1,5})\s*\)|\b(?:Inc|Corp|plc)\b", "company"),
    ("head", r"宏观|通胀|央行|\b(?:macro|inflation|GDP|CPI)\b", "macro"),
    ("head", r"策略|资产配置|\b(?:strategy|asset allocation|portfolio)\b", "strategy"),
    ("head", r"行业|半导体|\b(?:sector|industry|semiconductors?)\b", "industry"),
    ("head", r"投资主题|人工智能|\b(?:thematic|robotics)\b", "theme"),
    ("whole", r"业绩|目标价|\b(?:earnings|price target)\b", "company"),
    ("whole", r"宏观|\b(?:macro|inflation|GDP|CPI)\b", "macro"),
    ("whole", r"事件点评|\bevent (?:review|update)\b", "event"),
)
CATEGORIES = ("company", "industry", "macro", "theme", "event", "valuation", "meeting", "strategy", "source")


def title_category(title: Column, rules=RULES) -> Column:
    """The first rule that a title meets; a date and a publisher before it are no part of the subject."""
    whole = F.regexp_replace(title, r"^\d{8}[-_][^-_]+[-_]", "")
    head = F.regexp_extract(whole, "^[^:：]*", 0)
    out = F.lit(None).cast("string")
    for where, pattern, category in reversed(rules):
        cased = pattern if r"\(\s*(?:\d{4,6}" in pattern else f"(?i){pattern}"
        out = F.when((head if where == "head" else whole).rlike(cased), category).otherwise(out)
    return out


def categorise(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, type, category, title, topics): the category of each. A page that is no source is its type; a valid category stands;
    then the title's rules; then the votes of the topics, if one has more than all others."""
    topics = rows.select(key, F.posexplode("topics").alias("_i", "_t")).withColumn("_v", title_category(F.col("_t"))).where("_v is not null")
    votes = topics.groupBy(key, "_v").agg(F.count("*").alias("_n"))
    best = votes.groupBy(key).agg(F.max("_n").alias("_n"))
    won = votes.join(best, [key, "_n"]).groupBy(key).agg(F.count("*").alias("_ties"), F.min("_v").alias("_v")).where("_ties = 1").select(key, "_v")
    given = F.when(F.col("category").isin(*CATEGORIES), F.col("category"))
    found = F.coalesce(F.when(F.col("type") != "source", F.col("type")), given, title_category(F.col("title")), F.col("_v"), F.lit("source"))
    return rows.join(won, key, "left").select(key, found.alias("category"))


@query(
    "t5_classify",
    """SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'note' WHEN 1 THEN 'theme' WHEN 2 THEN 'macro' WHEN 3 THEN 'meeting' WHEN 4 THEN 'company' WHEN 5 THEN 'strategy' WHEN 6 THEN 'company' WHEN 7 THEN 'industry' WHEN 8 THEN 'source' WHEN 9 THEN 'macro' WHEN 10 THEN 'event' ELSE 'source' END AS category FROM documents""",
)
def t5(spark, sf_dir):
    """Categories by every rung: type, given category, title head, whole title, majority of topics, a tie, nothing."""
    titles = ["x", "CPI", "China Watch: Acme Inc", "Q2 results: meeting notes", "20240102-GS-Acme (AAPL): inflation", "Portfolio: sector", "Outlook: earnings of all", "x", "x", "Views: CPI", "Acme: event update", "nothing"]
    k = (F.col("doc_id") % 12).cast("int")
    topics = F.when(k == 7, F.array(F.lit("sector"), F.lit("industry"), F.lit("macro"))).when(k == 8, F.array(F.lit("sector"), F.lit("macro"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, "note").otherwise("source").alias("type"), F.when(k == 1, "theme").when(k == 2, "none").alias("category"), F.get(F.array(*[F.lit(t) for t in titles]), k).alias("title"), topics.alias("topics"))
    return categorise(rows, "doc_id")


def schema_array(values: Column) -> Column:
    """Texts that are not blank, each once, in order; never null."""
    return F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != "")))


def schema_date(value: Column) -> Column:
    """The calendar day that a text begins with; null if it is none."""
    day = F.left(value, F.lit(10))
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(day, "yyyy-MM-dd").isNotNull(), day)


@query("t2_metadata", "SELECT doc_id, 'a|b' AS tags, CASE WHEN doc_id % 3 = 0 THEN '2024-02-29' END AS published_at, 0 AS missing FROM documents")
def t2(spark, sf_dir):
    """Metadata in its schema: lists without blanks and repeats, days or null, an absent list is empty."""
    n = F.col("doc_id")
    raw_day = F.when(n % 3 == 0, "2024-02-29T10:00:00Z").when(n % 3 == 1, "2023-02-29").otherwise("soon")
    tags = F.array(F.lit("a"), F.lit(" "), F.lit(None).cast("string"), F.lit("b"), F.lit("a"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(schema_array(tags), "|").alias("tags"), schema_date(raw_day).alias("published_at"), F.size(schema_array(F.lit(None).cast("array<string>"))).alias("missing"))


#: Prefixes of tags made from entity fields, and of facets.
ENTITY_TAGS = {"companies": "公司", "industries": "行业", "subfields": "领域"}
FACETS = {"institutions": "机构", "authors": "作者", "topic_primary": "主题"}


def _behind(prefix: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.concat(F.lit(prefix), F.trim(x)))


def prefixed(df: DataFrame, prefixes: dict[str, str]) -> Column:
    """Tags of the given fields (lists or single texts), each behind its prefix, blanks left out, each once."""
    kinds = dict(df.dtypes)
    parts = []
    for field, prefix in prefixes.items():
        if field in kinds:
            values = F.col(field) if kinds[field].startswith("array") else F.array(field)
            parts.append(_behind(f"{prefix}:", schema_array(values)))
    return F.array_distinct(F.flatten(F.array(*parts))) if parts else F.array().cast("array<string>")


@query("t4_entity_tags", f"{P} SELECT document_id, array_to_string(list_transform(companies, lambda c: '公司:' || c), '|') AS entity_tags, coalesce('机构:' || institution, '') AS facets FROM pages_")
def t4(spark, sf_dir):
    docs = pages(spark, sf_dir).withColumn("institutions", F.array_compact(F.array("institution")))
    return docs.select("document_id", F.array_join(prefixed(docs, ENTITY_TAGS), "|").alias("entity_tags"), F.array_join(prefixed(docs, FACETS), "|").alias("facets"))


@query("t3_decorated", f"{P} SELECT document_id, array_to_string(list_concat(tags, list_filter(list_transform(companies, lambda c: '公司:' || c), lambda t: NOT list_contains(tags, t))), '|') AS tags, array_to_string(list_concat(tickers, CASE WHEN doc_id % 2 = 0 THEN ['X' || doc_id] ELSE [] END), '|') AS tickers FROM pages_")
def t3(spark, sf_dir):
    """Tags with those of the entity fields, tickers with those of the expectations."""
    docs = pages(spark, sf_dir)
    expected = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(_say("X", F.col("doc_id")).alias("ticker")), F.struct(F.lit(None).cast("string").alias("ticker"))))
    tickers = F.array_union("tickers", F.filter(F.coalesce(F.transform(expected, lambda e: e["ticker"]), F.array().cast("array<string>")), lambda t: t.isNotNull()))
    return docs.select("document_id", F.array_join(F.array_union("tags", prefixed(docs, ENTITY_TAGS)), "|").alias("tags"), F.array_join(tickers, "|").alias("tickers"))


def validated(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Problems (slug, field) of pages (slug, title, type, relations) against the slugs of all pages: no title, a type that does not
    go with the directory, relations to nothing or to pages that are not there."""
    from ..functions.strings import type_of

    bad = F.array_compact(F.array(F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "title"), F.when(F.col("type").isNull() | (F.contains("slug", F.lit("/")) & ~F.col("type").eqNullSafe(type_of(F.col("slug")))), "type")))
    own = rows.select("slug", F.explode(bad).alias("field"))
    targets = rows.select("slug", F.explode("relations").alias("target"))
    lost = targets.join(known.select(F.col("slug").alias("target")).distinct(), "target", "left_anti").select("slug", F.lit("relations").alias("field"))
    return own.union(lost)


@query("t27_page_problems", f"{P} SELECT slug, 'title' AS field FROM pages_ WHERE doc_id % 10 = 0 UNION ALL SELECT slug, 'type' FROM pages_ WHERE starts_with(slug, 'wiki/') OR starts_with(slug, 'notes/') AND doc_id % 4 = 0 UNION ALL SELECT slug, 'relations' FROM pages_ WHERE doc_id % 6 = 0")
def t27(spark, sf_dir):
    docs, n = pages(spark, sf_dir), F.col("doc_id")
    kind = F.when(F.startswith("slug", F.lit("sources/")), "source").when(n % 4 == 0, "paper").otherwise("note")
    relations = F.when(n % 6 == 0, F.array(F.lit("wiki/none"), F.col("slug"))).otherwise(F.array("slug"))
    return validated(docs.select("slug", F.when(n % 10 == 0, " ").otherwise(F.col("title")).alias("title"), kind.alias("type"), relations.alias("relations")), docs)


def merged(cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards (card, hash, tags) of one content are one: redirects (card, keeper) of the others, and each keeper with the tags of all.
    A group whose contents differ has different hashes, so none of it is merged."""
    groups = cards.groupBy("hash").agg(F.min("card").alias("keeper"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("all_tags"))
    redirects = cards.join(groups, "hash").where("card <> keeper").select("card", "keeper")
    return redirects, groups.select(F.col("keeper").alias("card"), F.col("all_tags").alias("tags"))


@query("b10_merged_tags", f"{P}, t AS (SELECT family_id, min(doc_id) AS card, list_sort(list_distinct(flatten(list(tags)))) AS tags FROM pages_ GROUP BY 1) SELECT card, array_to_string(tags, '|') AS tags FROM t")
def b10(spark, sf_dir):
    """Cards that stay, with the tags of those that were merged into them."""
    cards = pages(spark, sf_dir).select(F.col("doc_id").alias("card"), F.col("family_id").alias("hash"), "tags")
    return merged(cards)[1].select("card", F.array_join("tags", "|").alias("tags"))


@query("t20_author_candidates", "SELECT n_nationkey, 'Ann ' || upper(substr(n_region, 1, 1)) || 'lee' AS name FROM (SELECT n_nationkey, 'x' AS n_region FROM nation)")
def t20(spark, sf_dir):
    """Names near an e-mail address whose local part holds their surname: up to four lines above and two below, the first one."""
    page = _say("Some Title\nAnn Xlee, CFA\nSenior Analyst\n+1 222\nann.xlee@bank.com\nOther Person\n", "ask@bank.com")
    lines = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.split(page, "\n")).alias("at", "line"))
    return author_candidates(lines, "n_nationkey").select("n_nationkey", "name")


def author_candidates(lines: DataFrame, key: str) -> DataFrame:
    """Lines (key, at, line) to key, email, name: a join of addresses with the lines around them, the first that fits."""
    strip = F.regexp_replace(F.regexp_replace("line", r"(?i)^(?:By|Authors?|Analysts?)\s*:?\s+", ""), r"(?i)[, ]+(?:CFA|AC|Ph\.?D\.?|CPA|MD|ACA|CA)(?:[, ]+.*)?$", "")
    named = lines.select(key, F.col("at").alias("_at"), F.trim(strip).alias("name"))
    named = named.where(F.col("name").rlike(r"^[A-ZÀ-ž][A-Za-zÀ-ž.'’ -]+$") & F.size(F.split("name", r"\s+")).between(2, 5) & ~F.lower("name").rlike("research|analyst|associate|securities|equity|global|bank|strategy"))
    mails = lines.select(key, "at", F.regexp_extract("line", r"(?i)[a-z0-9._+-]+@[a-z0-9.-]+\.[a-z]{2,}", 0).alias("email")).where("email <> ''")
    near = mails.join(named, key).where("_at between at - 4 and at + 2")
    surname = F.regexp_replace(F.lower(F.element_at(F.split("name", r"\s+"), -1)), "[^a-z]", "")
    local = F.regexp_replace(F.lower(F.split_part("email", F.lit("@"), F.lit(1))), "[^a-z]", "")
    fits = near.where((F.char_length(surname) >= 2) & F.contains(local, surname))
    return first_per(fits, [key, "at"], ["_at"])


@query("t30_parsed_fallback", "SELECT n_nationkey, CAST(k AS INTEGER) AS page, CASE k WHEN 1 THEN n_name ELSE 'page ' || k END AS text FROM nation, range(1, 5) t(k)")
def t30(spark, sf_dir):
    """The first four pages of a parsed text, where the file itself gave none."""
    body = _say("head\n## PDF 第 1 页\n", F.col("n_name"), "\n## PDF 第 2 页\npage 2\n## PDF 第 3 页\npage 3\n## PDF 第 4 页\npage 4\n## PDF 第 5 页\npage 5")
    parts = F.regexp_extract_all(body, F.lit(r"(?s)## PDF 第 \d+ 页\n.*?(?=\n## PDF 第 |$)"), 0)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(parts).alias("p"))
    rows = rows.select("n_nationkey", F.regexp_extract("p", r"第 (\d+) 页", 1).cast("int").alias("page"), F.regexp_extract("p", r"(?s)\n(.*)$", 1).alias("text"))
    return rows.where("page <= 4")


def naming_outcome(rows: DataFrame) -> DataFrame:
    """rows with status and reason of a naming plan, the first obstacle counting: domestic, unreadable, no text, no publisher, a body
    that speaks for another, no title, no day; else ready with its seven-part name."""
    reason = (
        F.when(F.col("domestic"), "domestic-institution").when(F.col("error").isNotNull(), "pdf-unreadable").when(F.coalesce(F.col("letters"), F.lit(0)) <= 200, "needs-text-or-ocr").when(F.col("broker").isNull(), "publisher-not-in-dictionary")
        .when(F.col("body_check") == "mismatch", "publisher-body-mismatch").when(F.col("title").isNull(), "english-title-unresolved").when(F.col("date").isNull(), "full-date-unresolved")
    )
    title = F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace("title", "[^A-Za-z0-9]+", "-"), "^-|-$", ""), F.lit(90)), "-$", "")
    name = F.concat_ws("_", "date", "broker", F.coalesce("analyst", F.lit("research")), F.coalesce("topic", F.lit("Unknown")), F.when(F.size("tickers") > 0, F.array_join(F.slice("tickers", 1, 4), "+")).otherwise("NA"), title, F.concat(F.col("pages").cast("string"), F.lit("p")))
    status = F.when(F.col("domestic"), "excluded").when(reason.isNotNull(), "review").otherwise("ready")
    return rows.withColumn("reason", reason).withColumn("status", status).withColumn("name", F.when(reason.isNull(), name))


def _inventory(spark, sf_dir) -> DataFrame:
    n = F.col("doc_id")
    k = n % 9
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        (k == 0).alias("domestic"),
        F.when(k == 1, "broken").alias("error"),
        F.when(k == 2, 3).otherwise(900).alias("letters"),
        F.when(k != 3, "GS").alias("broker"),
        F.when(k == 4, "mismatch").otherwise("matched").alias("body_check"),
        F.when(k != 5, _say("Acme & Co: up ", n)).alias("title"),
        F.when(k != 6, "2024-03-05").alias("date"),
        F.when(k == 7, "jane-doe").alias("analyst"),
        F.when(k == 7, "Macro").alias("topic"),
        F.when(k == 7, F.array(F.lit("AAPL"), F.lit("0700.HK"))).otherwise(F.array().cast("array<string>")).alias("tickers"),
        F.lit(12).alias("pages"),
    )


_NAMED = "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'excluded' WHEN 7 THEN 'ready' WHEN 8 THEN 'ready' ELSE 'review' END AS status, CASE doc_id % 9 WHEN 0 THEN 'domestic-institution' WHEN 1 THEN 'pdf-unreadable' WHEN 2 THEN 'needs-text-or-ocr' WHEN 3 THEN 'publisher-not-in-dictionary' WHEN 4 THEN 'publisher-body-mismatch' WHEN 5 THEN 'english-title-unresolved' WHEN 6 THEN 'full-date-unresolved' END AS reason, CASE doc_id % 9 WHEN 7 THEN '2024-03-05_GS_jane-doe_Macro_AAPL+0700.HK_Acme-Co-up-' || doc_id || '_12p' WHEN 8 THEN '2024-03-05_GS_research_Unknown_NA_Acme-Co-up-' || doc_id || '_12p' END AS name FROM documents"


@query("t18_report_name", _NAMED)
def t18(spark, sf_dir):
    return naming_outcome(_inventory(spark, sf_dir)).select("doc_id", "status", "reason", "name")


@query("b1_naming_plan_counts", f"SELECT coalesce(reason, status) AS outcome, count(*) AS n FROM ({_NAMED}) GROUP BY 1")
def b1(spark, sf_dir):
    return naming_outcome(_inventory(spark, sf_dir)).groupBy(F.coalesce("reason", "status").alias("outcome")).agg(F.count("*").alias("n"))


@query("t15_typed_metadata", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'T' || doc_id END AS title, CASE WHEN doc_id % 3 = 0 THEN 'a|b' ELSE '' END AS tags, CASE WHEN doc_id % 3 = 0 THEN 2 END AS pages, doc_id % 3 = 2 AS damaged FROM documents")
def t15(spark, sf_dir):
    """A model's JSON read by a typed schema: what does not fit is null, lists are never null, what is no JSON is marked."""
    n = F.col("doc_id")
    raw = F.when(n % 3 == 0, _say('{"title": "T', n, '", "tags": ["a", "", "b", "a"], "pages": 2}')).when(n % 3 == 1, '{"title": null, "tags": null, "pages": "many"}').otherwise("{damaged")
    typed = table(spark, sf_dir, "documents").select("doc_id", F.from_json(raw, "title string, tags array<string>, pages int, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("m"), raw.alias("raw"))
    damaged = F.get_json_object("raw", "$").isNull()
    return typed.select("doc_id", "m.title", F.array_join(schema_array(F.col("m.tags")), "|").alias("tags"), "m.pages", damaged.alias("damaged"))


@query("t16_strict_output", "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'unknown key' WHEN 2 THEN 'missing key' WHEN 3 THEN 'wrong type' END AS problem FROM documents")
def t16(spark, sf_dir):
    """A model's output must have exactly the keys of the schema, each of its type."""
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, '{"title": "t", "pages": 1}').when(k == 1, '{"title": "t", "pages": 1, "more": 0}').when(k == 2, '{"title": "t"}').otherwise('{"title": "t", "pages": "x"}')
    keys = F.json_object_keys(raw)
    wanted = F.array(F.lit("title"), F.lit("pages"))
    wrong = F.get_json_object(raw, "$.pages").cast("string").try_cast("int").isNull()
    problem = F.when(F.size(F.array_except(keys, wanted)) > 0, "unknown key").when(F.size(F.array_except(wanted, keys)) > 0, "missing key").when(wrong, "wrong type")
    return table(spark, sf_dir, "documents").select("doc_id", problem.alias("problem"))
