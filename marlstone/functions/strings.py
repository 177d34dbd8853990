"""More scalar functions: slugs, file names, evidence text, snippets, fuzzy scores, splitting, JSON repair, dates, numbers."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import PAGES, pages
from ..registry import registry
from ..views import table
from .text import is_plain, normalize, query_terms

QUERIES, SQL, query = registry()
P = f"WITH {PAGES} "


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _no_marks(text: pd.Series) -> pd.Series:
    """Without Latin and Hebrew combining marks, lower case."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFD", t) if not ("\u0300" <= c <= "\u036f" or "\u0591" <= c <= "\u05c7"))
        return unicodedata.normalize("NFC", bare).lower()

    return text.map(one)


def slug_segment(text: Column) -> Column:
    """Lower case without accents; letters, marks, digits, . _ and - stay, white space becomes a hyphen. ASCII texts go to Python as
    nulls."""
    plain = text.rlike("^[\\x00-\\x7F]*$")
    bare = F.when(plain, F.lower(text)).otherwise(F.pandas_udf(_no_marks, "string")(F.when(~plain, text)))
    kept = F.regexp_replace(bare, r"[^\p{Ll}\p{Lm}\p{Lo}\p{M}\p{N}.\s_\-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-"), "^-|-$", "")


@query("f5_slug", "SELECT n_nationkey, 'wiki/' || lower(replace(n_name, ' ', '-')) || '-cafe-a_b.c' AS slug FROM nation")
def f5(spark, sf_dir):
    # A Python function may not stand in a lambda over an array: the path's segments are rows here.
    raw = F.concat(F.lit("Wiki//"), "n_name", F.lit("  Café -- A_b.c!.MD"))
    parts = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.split(F.regexp_replace(raw, "(?i)\\.mdx?$", ""), "/")).alias("at", "part"))
    folded = parts.select("n_nationkey", "at", slug_segment(F.col("part")).alias("part")).where("part <> ''")
    joined = folded.groupBy("n_nationkey").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("p"))
    return joined.select("n_nationkey", F.array_join("p.part", "/").alias("slug"))


def relation_target(value: Column) -> Column:
    """The slug in [[slug|label]] or a plain slug."""
    return F.split_part(F.regexp_replace(value, r"^\[\[|\]\]$", ""), F.lit("|"), F.lit(1))


@query("f6_relation_target", "SELECT n_nationkey, 'p-' || n_nationkey AS target FROM nation")
def f6(spark, sf_dir):
    n = F.col("n_nationkey")
    raw = F.when(n % 3 == 0, _say("[[p-", n, "|Label ]] x]]")).when(n % 3 == 1, _say("[[p-", n, "]]")).otherwise(_say("p-", n))
    return table(spark, sf_dir, "nation").select("n_nationkey", relation_target(raw).alias("target"))


#: Types of pages by directory.
DIRECTORIES = {"sources": "source", "papers": "paper", "reports": "report", "claims": "claim", "factors": "factor", "strategies": "strategy", "datasets": "dataset", "notes": "note"}


def type_of(slug_: Column) -> Column:
    """Type by the slug's directory: a note without one, null for one that is not known."""
    return F.when(~F.contains(slug_, F.lit("/")), "note").otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in DIRECTORIES.items() for x in kv]), F.split_part(slug_, F.lit("/"), F.lit(1))))


@query("f7_directory_type", f"{P} SELECT slug, CASE WHEN doc_id % 10 = 0 THEN 'note' WHEN starts_with(slug, 'sources/') THEN 'source' WHEN starts_with(slug, 'notes/') THEN 'note' END AS type FROM pages_")
def f7(spark, sf_dir):
    docs = pages(spark, sf_dir)
    return docs.select("slug", type_of(F.when(F.col("doc_id") % 10 == 0, F.split_part("slug", F.lit("/"), F.lit(2))).otherwise(F.col("slug"))).alias("type"))


@query("f9_no_nul", "SELECT doc_id, length(text) AS n FROM documents")
def f9(spark, sf_dir):
    """NUL characters leave texts, at any depth."""
    raw = F.struct(F.concat(F.lit("\0"), "text", F.lit("\0\0")).alias("t"))
    clean = raw.withField("t", F.translate(raw["t"], "\0", ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length(clean["t"]).cast("long").alias("n"))


def safe_name(name: Column, most: int = 150) -> Column:
    """A file name without directories and signs that file systems refuse; cut before its extension (of up to 16 characters)."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_extract(name, "([^/]*)/*$", 1), r'[<>:"/\\|?*\x00-\x1f]', "_"), "[. ]+$", "")
    suffix = F.regexp_extract(clean, r"^.+(\.[^.]*)$", 1)
    suffix = F.when(F.char_length(suffix) <= 16, suffix).otherwise("")
    stem = F.left(clean, F.lit(most) - F.char_length(suffix))
    cut = F.when(F.char_length(clean) <= most, clean).otherwise(F.concat(F.regexp_replace(stem, "[. ]+$", ""), suffix))
    return F.when(cut == "", "document").otherwise(cut)


@query("f10_safe_name", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a_b' || doc_id || '.pdf' WHEN 1 THEN repeat('x', 146) || '.pdf' ELSE 'document' END AS name FROM documents")
def f10(spark, sf_dir):
    n = F.col("doc_id")
    raw = F.when(n % 3 == 0, _say("dir/sub/a?b", n, ".pdf. .")).when(n % 3 == 1, _say(F.repeat(F.lit("x"), 300), n, ".pdf")).otherwise("dir/ . .")
    return table(spark, sf_dir, "documents").select("doc_id", safe_name(raw).alias("name"))


def folded_key(value: Column) -> Column:
    """Comparison form of a dictionary entry: compatibility form, lower case, without white space and punctuation."""
    return F.regexp_replace(normalize(value), r"[\s.,&'’()\-]+", "")


@query("f11_dictionary_key", "SELECT s_suppkey, 'supplier' || s_suppkey || 'abcoltd' AS key FROM supplier")
def f11(spark, sf_dir):
    raw = _say(" Sup-plier ", F.col("s_suppkey"), " ＡＢ Co., (Ltd.)'’&")
    return table(spark, sf_dir, "supplier").select("s_suppkey", folded_key(raw).alias("key"))


@query("f12_legal_stem", "SELECT s_suppkey, 'supplier#' || s_suppkey || 'coltd' AS format_key, 'supplier#' || s_suppkey AS stem FROM supplier")
def f12(spark, sf_dir):
    """Spellings of a company's name, and its stem without legal endings, however many."""
    from ..operators.mentions import format_key, legal_stem

    raw = _say("Supplier #", F.col("s_suppkey"), " Co., Ltd.")
    return table(spark, sf_dir, "supplier").select("s_suppkey", format_key(raw).alias("format_key"), legal_stem(_say(raw, " Corporation Limited")).alias("stem"))


#: Named entities that evidence texts may hold.
NAMED = {"nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _entities(text: pd.Series) -> pd.Series:
    """HTML entities of a text to their characters."""
    import re

    def one(m):
        name = m[1].lower()
        if not name.startswith("#"):
            return NAMED[name]
        code = int(name[2:], 16) if name[1] == "x" else int(name[1:])
        return chr(code) if 0 < code <= 0x10FFFF else m[0]

    pattern = re.compile(r"&(#x[0-9a-f]+|#\d+|nbsp|amp|lt|gt|quot|apos);", re.I)
    return text.map(lambda t: None if t is None else pattern.sub(one, t))


def evidence_text(text: Column) -> Column:
    """Text as it is compared with a quote: tags and escapes gone, entities read, compatibility form, plain quotes, single spaces."""
    t = F.regexp_replace(text, r"(?i)</?(?:sup|sub|em|strong|b|i|span)\b[^>]*>", "")
    t = F.regexp_replace(t, r"(?i)</?(?:table|thead|tbody|tfoot|tr|td|th|div|p|br|li|ul|ol|h[1-6])\b[^>]*>", " ")
    odd = F.contains(t, F.lit("&"))
    t = F.when(odd, F.pandas_udf(_entities, "string")(F.when(odd, t))).otherwise(t)
    t = F.regexp_replace(t, r"""\\([!"#$%&'()*+,\-./:;<=>?@\[\]^_`{|}~\\])""", "$1")
    plain = is_plain(t)  # in compatibility form already
    t = F.when(plain, t).otherwise(F.pandas_udf(lambda s: s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x)), "string")(F.when(~plain, t)))
    return F.trim(F.regexp_replace(F.translate(t, "‘’“”", "''\"\""), r"\s+", " "))


@query("f14_evidence_text", "SELECT n_nationkey, 'Q' || n_nationkey || '2 rose \"5%\" & <b> it''s AB ' || lower(n_name) AS t FROM nation")
def f14(spark, sf_dir):
    raw = _say("<p>Q", F.col("n_nationkey"), "<sup>2</sup>\n rose “5\\%” &amp; &lt;b&#62;<br/> it’s ＡＢ&nbsp;", F.lower("n_name"), "</td>")
    return table(spark, sf_dir, "nation").select("n_nationkey", evidence_text(raw).alias("t"))


def full_excerpt(body: Column, most: int = 200) -> Column:
    """Readable beginning of a page: no code, scripts, headings, images, rules or source links; links as their labels, marks gone."""
    t = F.regexp_replace(F.regexp_replace(body, r"(?s)```.*?```", ""), r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")
    skipped = lambda x: x.rlike(r"^(#|!\[|\[原始文件\]|>\s*(文献全文|原始证据)|-{3,}$)") | (x == "")
    lines = F.filter(F.transform(F.split(t, "\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\f\x0b]", " "))), lambda x: ~skipped(x))
    t = F.array_join(lines, " ")
    for pattern, by in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"<[^>]+>", ""), (r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"), (r"\[\[([^\]|]+)\]\]", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"^(?:#{1,6}|>|[-+])\s+", ""), (r"[*_`]", ""), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, by)
    t = F.trim(t)
    return F.when(F.char_length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("…"))).otherwise(t)


@query("f15_marked_excerpt", "SELECT n_nationkey, substr('Bold ' || replace(n_name, '_', '') || ' and label and slug plain ' || repeat('x', 300), 1, 200) || '…' AS excerpt FROM nation")
def f15(spark, sf_dir):
    """An excerpt of a page with everything that excerpts leave out."""
    raw = _say("# Head\n```\ncode\n```\n![i](u)\n> 文献全文 x\n---\n- **Bold** ", F.col("n_name"), "\nand [label](u) and [[slug]]<br> _plain_ ", F.repeat(F.lit("x"), 300), "<style>a</style>")
    return table(spark, sf_dir, "nation").select("n_nationkey", full_excerpt(raw).alias("excerpt"))


def trimmed_snippet(text: Column, most: int = 700) -> Column:
    """A found passage for reading: no page markers, images and marks; formulas as one word; links as their labels."""
    steps = [
        ("\r", ""), (r"(?m)^## PDF 第 \d+ 页\s*$", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"(?i)<img[^>]*>", ""), (r"(?s)\$\$.*?\$\$", " [公式] "), (r"\$\$", " "),
        (r"(?m)^[^\n]*(\\[a-zA-Z]+\s*[{(]|_ \{|\^ \{)[^\n]*$", "[公式]"), (r"(\[公式\]\s*){2,}", "[公式] "), (r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"), (r"\[\[([^\]|]+)\]\]", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?m)^#{1,6}\s+", ""), (r"(?m)^>\s?", ""), (r"\*\*|__", ""), (r"[ \t]+", " "), (r"\n{2,}", "\n"),
    ]
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit(" …")))


@query("f16_snippet", "SELECT n_nationkey, 'Head ' || n_name || chr(10) || 'see label [公式] end' || chr(10) || '[公式]' AS snippet FROM nation")
def f16(spark, sf_dir):
    raw = _say("## PDF 第 3 页\n## Head **", F.col("n_name"), "**\n\n> see [[slug|label]] $$a\nb$$ $$c$$ end\n\\frac{a}{b} = c")
    return table(spark, sf_dir, "nation").select("n_nationkey", trimmed_snippet(raw).alias("snippet"))


def around(text: Column, tokens: list[str], radius: int = 220) -> Column:
    """A window around the first token (of two characters or more) that the text holds; its beginning if it holds none."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    at = F.coalesce(*[F.when(F.instr(F.lower(clean), t.lower()) > 0, F.instr(F.lower(clean), t.lower()) - 1) for t in tokens if len(t) >= 2], F.lit(-1))
    n = F.char_length(clean)
    start, end = F.greatest(F.lit(0), at - radius), F.least(n, at + radius)
    window = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(clean, start + 1, end - start), F.when(end < n, "…").otherwise(""))
    plain = F.when(n > 2 * radius, F.concat(F.left(clean, F.lit(2 * radius)), F.lit("…"))).otherwise(clean)
    return F.when(at >= 0, window).otherwise(plain)


@query("f18_window", "WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL), a AS (SELECT *, CASE WHEN strpos(lower(t), 'with') > 0 THEN strpos(lower(t), 'with') - 1 WHEN strpos(lower(t), 'les') > 0 THEN strpos(lower(t), 'les') - 1 ELSE -1 END AS i FROM c) SELECT doc_id, CASE WHEN i < 0 THEN CASE WHEN length(t) > 440 THEN substr(t, 1, 440) || '…' ELSE t END ELSE CASE WHEN i > 220 THEN '…' ELSE '' END || substr(t, greatest(0, i - 220) + 1, least(length(t), i + 220) - greatest(0, i - 220)) || CASE WHEN i + 220 < length(t) THEN '…' ELSE '' END END AS snippet FROM a")
def f18(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", around(F.col("text"), ["with", "les", "x"]).alias("snippet"))


def fuzzy(title: Column, slug_: Column, tags: Column, q: str) -> Column:
    """How well a page answers to q: 100 for the very title; else by place and words in title and slug (0.9), 70 for the very tag."""
    q = " ".join(q.split()).lower()
    parts = [p for unit in query_terms(q) for p in (unit if len(unit) == 1 else ["".join(unit[i : i + 2]) for i in range(len(unit) - 1)])] or [q]

    def score(text: Column) -> Column:
        low = F.lower(text)
        at = F.instr(low, q)
        words = sum((F.contains(low, F.lit(p)).cast("int") for p in parts[1:]), F.contains(low, F.lit(parts[0])).cast("int"))
        return F.when(low == q, 100.0).otherwise(F.when(at > 0, 60 - F.least(at - 1, F.lit(30))).otherwise(0) + words / len(parts) * 40)

    tag = F.when(F.exists(tags, lambda t: F.lower(t) == q), 70.0).otherwise(0.0)
    return F.greatest(score(title), score(slug_) * 0.9, tag)


@query("f19_fuzzy", f"{P} SELECT document_id, round(greatest(CASE WHEN t = 'report 1' THEN 100 ELSE CASE WHEN strpos(t, 'report 1') > 0 THEN 60 - least(strpos(t, 'report 1') - 1, 30) ELSE 0 END + (CAST(contains(t, 'report') AS INTEGER) + CAST(contains(t, '1') AS INTEGER)) / 2.0 * 40 END, 0.9 * ((CAST(contains(slug, 'report') AS INTEGER) + CAST(contains(slug, '1') AS INTEGER)) / 2.0 * 40)), 6) AS score FROM (SELECT *, lower(title) AS t FROM pages_) ORDER BY score DESC, document_id LIMIT 30")
def f19(spark, sf_dir):
    docs = pages(spark, sf_dir).select("document_id", F.round(fuzzy(F.col("title"), F.col("slug"), F.col("tags"), " Report  1"), 6).alias("score"))
    return docs.orderBy(F.desc("score"), "document_id").limit(30)


@query("f21_percent_encode", "SELECT n_nationkey, '/wiki/a%20b%2F%E9%A1%B5%3F' || n_nationkey || '%2B~' AS path FROM nation")
def f21(spark, sf_dir):
    """A path segment, percent-encoded: blanks are %20, not +."""
    raw = _say("a b/页?", F.col("n_nationkey"), "+~")
    encoded = F.replace(F.replace(F.url_encode(raw), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("/wiki/"), encoded).alias("path"))


def parts_of(text: str, most: int = 24_000) -> list[tuple[int, int, int | None]]:
    """(start, end, page at the start) of parts of a text: of most characters, ended at a blank line behind the half."""
    import re

    marks = [(m.start(), int(m[1])) for m in re.finditer(r"^## PDF 第 (\d+) 页$", text, re.M)]
    out, start = [], 0
    while start < len(text):
        end = min(start + most, len(text))
        if end < len(text) and (gap := text.rfind("\n\n", 0, end + 2)) > start + most / 2:
            end = gap + 2
        out.append((start, end, next((page for at, page in reversed(marks) if at <= start), None)))
        start = end
    return out


@query("f23_parts", "SELECT n_nationkey, k AS part, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1002 ELSE 2002 END AS start, CASE k WHEN 0 THEN 1002 WHEN 1 THEN 2002 ELSE 2002 + n_nationkey + 1 END AS stop, CASE WHEN k = 0 THEN NULL ELSE 1 END AS page FROM nation, range(3) t(k)")
def f23(spark, sf_dir):
    """Parts of 1000 characters, the first ended at a blank line two characters behind them."""
    body = _say("x\n## PDF 第 1 页\n", F.repeat(F.lit("a"), 985), "\n\n", F.repeat(F.lit("b"), 1000), F.repeat(F.lit("c"), F.col("n_nationkey") + 1))
    split = F.pandas_udf(lambda s: s.map(lambda t: [{"start": a, "stop": b, "page": p} for a, b, p in parts_of(t, 1000)]), "array<struct<start:int,stop:int,page:int>>")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(split(body)).alias("part", "p"))
    return rows.select("n_nationkey", "part", "p.start", "p.stop", "p.page")


def repaired(text: str | None) -> str | None:
    """JSON whose strings hold raw control characters, with these escaped; a fence around it goes; null if it is no JSON then."""
    import re

    if text is None:
        return None
    text = re.sub(r"\s*```\s*$", "", re.sub(r"^\s*```(?:json)?\s*", "", text, flags=re.I))
    inside, escaped, out = False, False, []
    for c in text:
        if inside and not escaped and ord(c) < 32:
            out.append(f"\\u{ord(c):04x}")
            continue
        out.append(c)
        if escaped:
            escaped = False
        elif inside and c == "\\":
            escaped = True
        elif c == '"':
            inside = not inside
    fixed = "".join(out)
    try:
        json.loads(fixed)
    except ValueError:
        return None
    return fixed


@query("f25_json_repair", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 4 THEN n_name || chr(10) || 'x' END AS value FROM nation")
def f25(spark, sf_dir):
    n = F.col("n_nationkey")
    raw = _say("```json\n{\"a\": \"", F.col("n_name"), "\nx\"", F.when(n % 5 == 4, "").otherwise("}"), "\n```")
    fix = F.pandas_udf(lambda s: s.map(repaired), "string")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.get_json_object(fix(raw), "$.a").alias("value"))


@query("d2_local_today", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS today FROM events")
def d2(spark, sf_dir):
    """The calendar day at a place, not in UTC."""
    return table(spark, sf_dir, "events").select("event_id", F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Shanghai"), "yyyy-MM-dd").alias("today"))


_DAY = r"(?<!\d)(20\d{2})[-_.]?(0[1-9]|1[0-2])[-_.]?([0-2]\d|3[01])(?!\d)"


def _day(text: Column) -> Column:
    """The first day that a name tells, if it is one; else null."""
    parts = [F.regexp_extract(text, _DAY, k) for k in (1, 2, 3)]
    day = F.concat_ws("-", *parts)
    return F.when(F.try_to_date(day, "yyyy-MM-dd").isNotNull(), day)


def report_date(path: Column, month: Column) -> tuple[Column, Column]:
    """A report's day and where it comes from: its file name, else the nearest directory that tells one, else its month."""
    parts = F.reverse(F.split(path, r"[\\/]"))
    days = F.transform(parts, _day)
    found = F.filter(days, lambda d: d.isNotNull())
    own = days[0]
    date = F.coalesce(own, F.get(found, 0), F.concat(month, F.lit("-01")))
    return date, F.when(own.isNotNull(), "filename").when(F.size(found) > 0, "directory").otherwise("month-directory")


@query("d3_report_date", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '2024-03-0' || (doc_id % 9 + 1) WHEN 1 THEN '2024-02-1' || (doc_id % 9 + 1) ELSE '2024-05-01' END AS date, CASE doc_id % 3 WHEN 0 THEN 'filename' WHEN 1 THEN 'directory' ELSE 'month-directory' END AS source FROM documents")
def d3(spark, sf_dir):
    n = F.col("doc_id")
    path = F.when(n % 3 == 0, _say("2024-02-11/a_2024030", n % 9 + 1, "_x.pdf")).when(n % 3 == 1, _say("20240101/in_2024.02.1", n % 9 + 1, "/20240230.pdf")).otherwise("05/20241305/x120240506.pdf")
    date, source = report_date(path, F.lit("2024-05"))
    return table(spark, sf_dir, "documents").select("doc_id", date.alias("date"), source.alias("source"))


def explicit_date(text: Column) -> Column:
    """A day written as 2024-3-5, 5 Mar 2024 or March 5, 2024; null if there is none or it is no day."""
    iso = F.regexp_extract(text, r"\b(20\d{2}[-/.]\d{1,2}[-/.]\d{1,2})\b", 1)
    day_first = r"\b(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]{0,6}\.?,?\s+(20\d{2})\b"
    month_first = r"\b([A-Za-z]{3})[A-Za-z]{0,6}\.?\s+(\d{1,2}),?\s+(20\d{2})\b"
    got = lambda p, d, m: F.initcap(F.concat_ws(" ", F.regexp_extract(text, p, d), F.regexp_extract(text, p, m), F.regexp_extract(text, p, 3)))
    return F.when(iso != "", F.try_to_date(F.translate(iso, "/.", "--"), "yyyy-M-d")).when(text.rlike(day_first), F.try_to_date(got(day_first, 1, 2), "d MMM yyyy")).when(text.rlike(month_first), F.try_to_date(got(month_first, 2, 1), "d MMM yyyy"))


@query("d4_explicit_date", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2024-03-0' || (doc_id % 9 + 1) WHEN 1 THEN '2024-09-0' || (doc_id % 9 + 1) WHEN 2 THEN '2024-12-0' || (doc_id % 9 + 1) END AS date FROM documents")
def d4(spark, sf_dir):
    n = F.col("doc_id")
    raw = F.when(n % 4 == 0, _say("on 2024/3/", n % 9 + 1, " we")).when(n % 4 == 1, _say("As of ", n % 9 + 1, " Sept. 2024")).when(n % 4 == 2, _say("DECEMBER ", n % 9 + 1, ", 2024")).otherwise("31 Feb 2024")
    return table(spark, sf_dir, "documents").select("doc_id", F.date_format(explicit_date(raw), "yyyy-MM-dd").alias("date"))


def publication_date(first: Column, header: Column, title: Column, created: Column, upload: Column) -> tuple[Column, Column, Column]:
    """Day, where it is from, and a note, by a ladder: what says First Published with a time in UTC; a header line that is a date and
    nothing else; a title that begins with one; the file's creation in the month of the header's, within a week of the upload.
    A day after the upload is refused; one that lies over 30 days before it is to be looked at."""
    published = F.regexp_extract(first, r"(?i)First Published\s*:?\s*([^\n]{0,90})", 1)
    one = F.when(published.rlike(r"(?i)\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:UTC|GMT)\b"), explicit_date(published))
    rest = F.regexp_replace(header, r"(?i)\b20\d{2}[-/.]\d{1,2}[-/.]\d{1,2}\b|\b\d{1,2}\s+[A-Za-z]{3,9}\.?,?\s+20\d{2}\b|\b[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+20\d{2}\b|\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?|\b(?:ET|EST|EDT|GMT|UTC|HKT)\b|[\s,|]", "")
    two = F.when(rest == "", explicit_date(header))
    three = F.try_to_date(F.regexp_extract(title, r"^\s*(20\d{6})", 1), "yyyyMMdd")
    loaded = F.try_to_date(upload, "yyyy-MM-dd")
    made = F.try_to_date(F.regexp_extract(created, r"^D:(20\d{6})", 1), "yyyyMMdd")
    month = F.try_to_date(F.concat(F.lit("1 "), F.initcap(F.regexp_replace(header, r"^\s*([A-Za-z]{3})[a-z]*\s+(20\d{2})\s*$", "$1 $2"))), "d MMM yyyy")
    four = F.when((F.trunc(made, "month") == month) & (F.datediff(loaded, made).between(0, 7)), made)
    day = F.coalesce(one, two, three, four)
    source = F.when(one.isNotNull(), "first_published_utc").when(two.isNotNull(), "report_header").when(three.isNotNull(), "title").when(four.isNotNull(), "creation_date_same_month")
    late = F.datediff(loaded, day)
    note = F.when(late < -1, "publication-after-upload").when(late > 30, "upload_lag_review")
    return F.when(~F.coalesce(late < -1, F.lit(False)), day), source, note


@query(
    "d5_publication_ladder",
    "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '2024-03-05' WHEN 1 THEN '2024-03-06' WHEN 2 THEN '2024-03-07' WHEN 3 THEN '2024-03-08' WHEN 5 THEN '2024-01-02' END AS day, CASE doc_id % 6 WHEN 0 THEN 'first_published_utc' WHEN 1 THEN 'report_header' WHEN 2 THEN 'title' WHEN 3 THEN 'creation_date_same_month' WHEN 4 THEN 'report_header' ELSE 'report_header' END AS source, CASE doc_id % 6 WHEN 4 THEN 'publication-after-upload' WHEN 5 THEN 'upload_lag_review' END AS note FROM documents",
)
def d5(spark, sf_dir):
    k = F.col("doc_id") % 6
    first = F.when(k == 0, "First Published: 5 Mar 2024 07:30 UTC").otherwise("First Published: 5 Mar 2024")
    header = F.when(k == 1, "March 6, 2024 | 09:30 AM ET").when(k == 4, "March 30, 2024").when(k == 5, "2 January 2024").when(k == 3, "March 2024").otherwise("On 1 March 2024 we said")
    title = F.when(k == 2, "20240307-x").otherwise("x")
    day, source, note = publication_date(first, header, title, F.lit("D:20240308120000"), F.lit("2024-03-10"))
    return table(spark, sf_dir, "documents").select("doc_id", F.date_format(day, "yyyy-MM-dd").alias("day"), source.alias("source"), note.alias("note"))


#: Names of months, their short forms first.
MONTHS = ("Jan(?:uary)?", "Feb(?:ruary)?", "Mar(?:ch)?", "Apr(?:il)?", "May", "Jun(?:e)?", "Jul(?:y)?", "Aug(?:ust)?", "Sep(?:t(?:ember)?)?", "Oct(?:ober)?", "Nov(?:ember)?", "Dec(?:ember)?")


def date_quoted(day: Column, quote: Column) -> Column:
    """Whether a quote writes the day out, as numbers or with the month's name, in any order that is usual."""
    year, month, number = F.substring(day, 1, 4), F.substring(day, 6, 2).cast("int"), F.substring(day, 9, 2).cast("int").cast("string")
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month)
    pattern = _say("(?i)(?<![\\d\\w])(?:", year, "[-/.年]0?", month.cast("string"), "[-/.月]0?", number, "日?|", name, "\\.?\\s+0?", number, "(?:st|nd|rd|th)?,?\\s+", year, "|0?", number, "(?:st|nd|rd|th)?\\s+", name, "\\.?,?\\s+", year, ")(?!\\d)")
    return F.rlike(quote, pattern)


@query("d6_date_quoted", "SELECT doc_id, doc_id % 6 < 4 AS quoted FROM documents")
def d6(spark, sf_dir):
    k = F.col("doc_id") % 6
    quote = F.when(k == 0, "on 2024年3月5日 it").when(k == 1, "Dated March 5th, 2024").when(k == 2, "5 Mar. 2024").when(k == 3, "2024/03/05").when(k == 4, "March 15, 2024").otherwise("12024-03-05")
    return table(spark, sf_dir, "documents").select("doc_id", date_quoted(F.lit("2024-03-05"), quote).alias("quoted"))


def off_peak(at: Column, timeout: int = 600) -> Column:
    """Whether a request of timeout seconds may begin: not on weekdays from 9 to 12 and 14 to 18 in Beijing, nor within the
    request's length and 30 seconds before."""
    local = F.from_utc_timestamp(at, "Asia/Shanghai")
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    reserve = timeout + 30
    busy = F.lit(False)
    for a, b in ((9, 12), (14, 18)):
        busy = busy | ((second >= a * 3600 - reserve) & (second < b * 3600))
    return ~(F.weekday(local).between(0, 4) & busy)


@query("d7_off_peak", "SELECT event_id, NOT (isodow BETWEEN 1 AND 5 AND (s >= 9 * 3600 - 630 AND s < 12 * 3600 OR s >= 14 * 3600 - 630 AND s < 18 * 3600)) AS allowed FROM (SELECT event_id, isodow(ts + INTERVAL 8 HOUR) AS isodow, hour(ts + INTERVAL 8 HOUR) * 3600 + minute(ts + INTERVAL 8 HOUR) * 60 + second(ts + INTERVAL 8 HOUR) AS s FROM events)")
def d7(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", off_peak(F.col("ts").cast("timestamp")).alias("allowed"))


def numbers(text: Column) -> Column:
    """Numbers of a text in one form: no separators of thousands, brackets as a minus sign, no plus, no zeros at the end."""
    found = F.regexp_extract_all(text, F.lit(r"\(?[+-]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)\)?"), 0)
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.translate(x, ",", ""), r"^\((.*)\)$", "-$1"), r"^\+", ""), r"(\.\d*?)0+$", "$1")
    return F.transform(found, lambda x: F.regexp_replace(plain(x), r"\.$", ""))


@query("n4_numbers", "SELECT n_nationkey, '1234' || n_nationkey || '.5 -12.3 7 .5 8' AS numbers FROM nation")
def n4(spark, sf_dir):
    raw = _say("up 1,234", F.col("n_nationkey"), ".50 from (12.30), +7.00 and .5 or 8")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(numbers(raw), " ").alias("numbers"))


@query("n1_reciprocal_rank", "SELECT p_partkey, round(1.0 / (60 + n), 12) AS share FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS n FROM part ORDER BY n LIMIT 120)")
def n1(spark, sf_dir):
    """What a place in a channel is worth to the fusion."""
    from pyspark.sql import Window

    top = table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(120)
    n = F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey"))
    return top.select("p_partkey", F.round(1.0 / (60 + n), 12).alias("share"))


@query("n3_gain", "SELECT conv_id, round(sum(1 / log2(turn + 2)), 9) AS gain FROM conversations WHERE role = 'user' GROUP BY 1")
def n3(spark, sf_dir):
    """The discounted gain of each conversation's user turns: what stands later is worth less."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.round(F.sum(1 / F.log2(F.col("turn") + 2)), 9).alias("gain"))


@query("r2_cosine", "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 1) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), e), 9) AS cosine FROM embeddings, q")
def r2(spark, sf_dir):
    from ..operators.search import cosine

    vectors = table(spark, sf_dir, "embeddings")
    q = vectors.where("vec_id = 1").first()["embedding"]
    return vectors.select("vec_id", F.round(cosine(F.col("embedding"), q), 9).alias("cosine"))


@query("r3_dimensions", "SELECT vec_id, len(embedding) = 64 AND len(embedding) <= 4096 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS sound FROM embeddings")
def r3(spark, sf_dir):
    """A vector may be searched if it has the model's dimensions and finite values only."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return table(spark, sf_dir, "embeddings").select("vec_id", ((F.size("embedding") == 64) & (F.size("embedding") <= 4096) & finite).alias("sound"))


@query("r4_json_paths", "SELECT event_id, CAST(len(json_keys(props)) AS INTEGER) AS keys, event_type || '-x' AS merged, CAST(2 AS INTEGER) AS items FROM events")
def r4(spark, sf_dir):
    """Keys of an object, a field put over another's, elements of a list."""
    over = F.map_concat(F.create_map(F.lit("a"), F.lit("y")), F.create_map(F.lit("b"), F.concat("event_type", F.lit("-x"))))
    items = F.size(F.from_json(F.to_json(F.array(F.lit(1), F.lit(2))), "array<int>"))
    return table(spark, sf_dir, "events").select("event_id", F.size(F.json_object_keys("props")).alias("keys"), F.get_json_object(F.to_json(over), "$.b").alias("merged"), items.alias("items"))


@query("r5_heading_path", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'A|D' WHEN 1 THEN 'B' ELSE 'A|C|E' END AS path FROM nation")
def r5(spark, sf_dir):
    """Headings above the last block: one of each level, the deeper ones gone when a higher one comes."""
    from .text import split_blocks

    k = F.col("n_nationkey") % 3
    body = _say("# A\n### C\n", F.when(k == 0, "## D").when(k == 1, "# B").otherwise("#### E"), "\ntext")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.element_at(split_blocks(body), -1)["section"], "|").alias("path"))


def headings(body: Column) -> Column:
    """Level and text of every heading, and the pages that markers open."""
    found = F.regexp_extract_all(body, F.lit(r"(?m)^(#{1,6} .+?)\r?$"), 1)
    return F.transform(found, lambda h: F.struct(F.char_length(F.split_part(h, F.lit(" "), F.lit(1))).alias("level"), F.regexp_replace(h, "^#+ ", "").alias("title"), F.nullif(F.regexp_extract(h, r"^## PDF 第 (\d+) 页", 1), F.lit("")).cast("int").alias("page")))


@query("r6_outline", "SELECT n_nationkey, CAST(k AS INTEGER) AS at, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS level, CASE k WHEN 0 THEN n_name WHEN 1 THEN 'PDF 第 2 页' ELSE 'Sub' END AS title, CASE WHEN k = 1 THEN 2 END AS page FROM nation, range(3) t(k)")
def r6(spark, sf_dir):
    body = _say("# ", F.col("n_name"), "\ntext # no\n## PDF 第 2 页\n### Sub\n#none\n")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(headings(body)).alias("at", "h")).select("n_nationkey", "at", "h.level", "h.title", "h.page")


@query("r7_wikilinks", "SELECT n_nationkey, CAST(k AS INTEGER) AS at, CASE k WHEN 0 THEN 'p-' || n_nationkey ELSE 'q' END AS target, CASE k WHEN 0 THEN n_name ELSE 'q' END AS label FROM nation, range(2) t(k)")
def r7(spark, sf_dir):
    """Links of a wiki text: target and label (the target's own name without one)."""
    body = _say("see [[p-", F.col("n_nationkey"), "|", F.col("n_name"), "]] and [[q]] but [[]] not")
    links = F.regexp_extract_all(body, F.lit(r"\[\[([^\]\[]+)\]\]"), 1)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(links).alias("at", "l"))
    label = F.when(F.contains("l", F.lit("|")), F.split_part("l", F.lit("|"), F.lit(2))).otherwise(F.col("l"))
    return rows.select("n_nationkey", "at", F.split_part("l", F.lit("|"), F.lit(1)).alias("target"), label.alias("label"))
