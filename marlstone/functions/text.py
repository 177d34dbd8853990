"""Text functions: normalisation, words, slugs, snippets, and the lossless block splitter."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: str | Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).lower())


#: Characters of Latin, Greek, Cyrillic and Han texts that are their own compatibility form, and join with nothing.
_COMPOSED = "[\\x00-\\x7F\\u00A1-\\u00A7\\u00A9\\u00AB-\\u00AE\\u00B0\\u00B1\\u00B6\\u00B7\\u00BB\\u00BF-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u0391-\\u03A9\\u03B1-\\u03C9\\u0400-\\u045F\\u2010\\u2012-\\u2016\\u2018-\\u201E\\u2020-\\u2022\\u20AC\\u4E00-\\u9FFF\\u3001-\\u3011]"


def is_plain(text: Column) -> Column:
    """Whether a text is in compatibility form already (true of most texts), so that folding it needs no Python."""
    return text.rlike(f"^{_COMPOSED}*$")


def _folded(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def normalize(text: str | Column) -> Column:
    """Compatibility form, trimmed, white space collapsed, lower case. Texts in that form go to Python as nulls."""
    text = F.col(text) if isinstance(text, str) else text
    plain = is_plain(text)
    return F.when(plain, _folded(text)).otherwise(F.pandas_udf(_nfkc, "string")(F.when(~plain, text)))


#: Words: a Han character; a number with points or commas inside; a run of letters, marks, digits and _ with apostrophes inside.
_RUN = r"[\p{L}\p{M}\p{N}_&&[^\p{IsHan}]]+"
TERM = rf"\p{{IsHan}}|\p{{Nd}}+(?:[.,]\p{{Nd}}+)+|{_RUN}(?:['’]{_RUN})*"


def terms(text: str | Column) -> Column:
    """Words of a text in order, folded. There is no dictionary of Chinese: each Han character is a word."""
    return F.regexp_extract_all(normalize(text), F.lit(TERM), 0)


_WORDS = r"[[\p{L}\p{M}\p{N}_]--\p{Han}]+"
_ANY = regex.compile(rf"(?V1)\p{{Han}}|\p{{Nd}}+(?:[.,]\p{{Nd}}+)+|{_WORDS}(?:['’]{_WORDS})*")
_ASCII = re.compile(r"[0-9]+(?:[.,][0-9]+)+|[a-z0-9_]+(?:'[a-z0-9_]+)*")
#: For texts of composed characters but Han; of marks, lower case makes only the dot of a Turkish capital.
_LETTERS = re.compile("[0-9]+(?:[.,][0-9]+)+|[\\w\u0307]+(?:['’][\\w\u0307]+)*")
_WESTERN = re.compile(_COMPOSED.replace("\\u4E00-\\u9FFF\\u3001-\\u3011", "") + "*")


def terms_of(text: str) -> list[str]:
    """terms of a text within Python; nearly all texts are matched by a simpler pattern that finds the same in them."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    if _WESTERN.fullmatch(text):
        return _LETTERS.findall(text.lower())
    return _ANY.findall(unicodedata.normalize("NFKC", text).lower())


def query_terms(q: str, most: int = 80) -> list[list[str]]:
    """Units of a query: a word, or the neighbouring Han characters of a phrase; each once, in order."""
    import regex

    found: list[list[str]] = []
    end = -1
    run = r"[[\p{L}\p{M}\p{N}_]--\p{Han}]+"
    for m in regex.finditer(rf"(?V1)\p{{Han}}|\p{{Nd}}+(?:[.,]\p{{Nd}}+)+|{run}(?:['’]{run})*", unicodedata.normalize("NFKC", q).lower()):
        han = regex.fullmatch(r"\p{Han}", m[0])
        if han and m.start() == end:
            found[-1].append(m[0])
        else:
            found.append([m[0]])
        end = m.end() if han else -1
    out: list[list[str]] = []
    for unit in found:
        if unit not in out:
            out.append(unit)
    return out[:most]


def excerpt(text: str, n: int = 200) -> Column:
    """Text without code, headings, images, links and tags, cut to n characters with an ellipsis."""
    t = F.col(text)
    for pattern, by in ((r"(?s)```.*?```", " "), (r"(?dm)^#+ .*$", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]*>", " "), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, by)
    t = F.trim(t)
    return F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


_MARK = re.compile(r"^## PDF 第 (\d+) 页\s*$", re.M)
_FIRST = re.compile(r"## PDF 第 (\d+) 页")
_HEAD = re.compile(r"^(#{1,6}) (.+?)\r?$", re.M)


def _spans(body: str, most: int):
    """Spans of a text without characters beyond the basic plane, or of one spelt in UTF-16 units: start, end, page, headings."""
    starts = sorted({0, *(m.start() for m in _MARK.finditer(body))})
    levels: list[str | None] = [None] * 6
    page = None
    for start, end in zip(starts, [*starts[1:], len(body)]):
        if mark := _FIRST.match(body, start):
            page = int(mark[1])
        while start < end:
            stop = min(end, start + most)
            if stop < end:
                gap = body.rfind("\n\n", 0, stop + 2)
                if gap > start + most / 3:
                    stop = gap + 2
                elif 0xD800 <= ord(body[stop - 1]) <= 0xDBFF:
                    stop -= 1
            for h in _HEAD.finditer(body[start:stop]):
                if not _FIRST.match(h[0]):
                    levels[len(h[1]) - 1 :] = [h[2].strip()] + [None] * (6 - len(h[1]))
            yield start, stop, page, [t for t in levels if t]
            start = stop


def blocks(body: str, most: int = 1800) -> list[tuple[int, int, int | None, list[str], str]]:
    """(start, end, page, heading path, text) of spans whose texts join to body.

    A page marker begins a span; a longer span ends at the last blank line behind a third of its length, else at
    ``most`` UTF-16 units, never inside a surrogate pair. A heading replaces those of its level and below. Offsets count
    code points.
    """
    if not body or ord(max(body)) <= 0xFFFF:
        return [(a, b, page, path, body[a:b]) for a, b, page, path in _spans(body, most)]
    raw = body.encode("utf-16-le", "surrogatepass")
    units = "".join(map(chr, memoryview(raw).cast("H")))
    out, at = [], 0
    whole = lambda t: t.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass")
    for a, b, page, path in _spans(units, most):
        text = whole(units[a:b])
        out.append((at, at + len(text), page, [whole(t) for t in path], text))
        at += len(text)
    return out


BLOCK = "array<struct<start_offset:int,end_offset:int,pdf_page:int,section:array<string>,text:string>>"


def _split(body: pd.Series) -> pd.Series:
    return body.map(lambda t: [dict(zip(("start_offset", "end_offset", "pdf_page", "section", "text"), x)) for x in blocks(t or "")])


def split_blocks(body: Column) -> Column:
    """Blocks of a text column."""
    return F.pandas_udf(_split, BLOCK)(body)


def is_unmarked(body: Column) -> Column:
    """Whether a text has no page marker, heading, blank line or character beyond the basic plane: its blocks are slices."""
    # A search for a few characters leaves little for the patterns, which take far longer.
    heading = F.contains(body, F.lit("# ")) & body.rlike(r"(?m)^#{1,6} ")
    return ~(F.contains(body, F.lit("\n\n")) | heading | ((F.octet_length(body) > F.char_length(body)) & body.rlike(r"[\x{10000}-\x{10FFFF}]")))


def slices(body: Column, most: int = 1800) -> Column:
    """Blocks of a text for which is_unmarked holds, without Python. One pass cuts the text: a substring for each block would count the
    characters before it."""
    pieces = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{most}}}"), F.lit(0))

    def block(text: Column, k: Column) -> Column:
        at = k * most
        return F.struct(at.alias("start_offset"), (at + F.char_length(text)).alias("end_offset"), F.lit(None).cast("int").alias("pdf_page"), F.array().cast("array<string>").alias("section"), text.alias("text"))

    return F.transform(pieces, block).cast(BLOCK)
