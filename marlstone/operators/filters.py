"""The filter language: a tree of all / any / not over leaves {field, op, value}, validated and compiled to a Column.

A leaf is never null: a missing scalar fails eq, in, gte and lte, and a missing list has none of the values, so that
contains_none and not keep rows without the field.
"""

from __future__ import annotations

import re
from datetime import date
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import registry
from ..views import DOCS, documents

QUERIES, SQL, query = registry()

#: Fields of the metadata that may be filtered, and their kinds.
METADATA = {
    "tags": "array",
    "tickers": "array",
    "companies": "array",
    "industries": "array",
    "topic_primary": "string",
    "subfields": "array",
    "institutions": "array",
    "authors": "array",
    "aliases": "array",
    "markets": "array",
    "research_topics": "array",
    "page_type": "string",
    "research_category": "string",
    "document_type": "string",
    "language": "string",
    "research_stage": "string",
    "review_status": "string",
    "region": "string",
    "status": "string",
    "published_at": "date",
    "data_as_of": "date",
    "ingested_at": "date",
    "updated_at": "date",
    "entity_ids": "array",
}
#: These, and what this library's tables have beside them.
FIELDS = METADATA | {"document_id": "string", "title": "string", "lang": "string", "institution": "string"}
_OPS = {"string": {"eq", "in", "exists"}, "date": {"eq", "in", "exists", "gte", "lte"}, "array": {"eq", "in", "exists", "contains_all", "contains_any", "contains_none"}}
DEPTH, NODES, VALUES, LENGTH = 5, 100, 100, 500


class InvalidArgument(ValueError):
    code = "INVALID_ARGUMENT"


def is_date(value: object) -> bool:
    """A real calendar day written YYYY-MM-DD."""
    if not isinstance(value, str) or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        return False
    try:
        return date.fromisoformat(value).isoformat() == value
    except ValueError:
        return False


def validate(node: dict, fields: dict[str, str] = FIELDS) -> None:
    """Raise InvalidArgument unless node is a filter of known fields, operations and values."""
    count = 0

    def strings(value: object) -> list[str]:
        value = value if isinstance(value, list) else [value]
        if not value or len(value) > VALUES or not all(isinstance(v, str) and len(v) <= LENGTH for v in value):
            raise InvalidArgument(f"1 to {VALUES} strings of at most {LENGTH} characters are needed")
        return value

    def visit(node: object, depth: int) -> None:
        nonlocal count
        count += 1
        if depth > DEPTH or count > NODES or not isinstance(node, dict):
            raise InvalidArgument("filter too deep, too large, or not an object")
        keys = set(node)
        if keys in ({"all"}, {"any"}):
            (children,) = node.values()
            if not isinstance(children, list) or not children:
                raise InvalidArgument("a group needs members")
            for child in children:
                visit(child, depth + 1)
        elif keys == {"not"}:
            visit(node["not"], depth + 1)
        elif keys == {"field", "op", "value"}:
            kind = fields.get(node["field"])
            if kind is None or node["op"] not in _OPS[kind]:
                raise InvalidArgument(f"unknown field or operation: {node['field']} {node['op']}")
            if node["op"] == "exists":
                if not isinstance(node["value"], bool):
                    raise InvalidArgument("exists takes true or false")
            else:
                value = strings(node["value"])
                if kind == "date" and not all(map(is_date, value)):
                    raise InvalidArgument("not a calendar day")
        else:
            raise InvalidArgument(f"unknown keys: {sorted(keys)}")

    visit(node, 1)


def compile_filter(node: dict, fields: dict[str, str] = FIELDS) -> Column:
    """The Column of a validated filter."""
    if "all" in node:
        return reduce(and_, [compile_filter(x, fields) for x in node["all"]])
    if "any" in node:
        return reduce(or_, [compile_filter(x, fields) for x in node["any"]])
    if "not" in node:
        return ~compile_filter(node["not"], fields)
    field, op, value = F.col(node["field"]), node["op"], node["value"]
    values = value if isinstance(value, list) else [value]
    false = F.lit(False)
    if fields[node["field"]] == "array":
        wanted = F.array(*[F.lit(v) for v in values])
        if op == "exists":
            return (F.coalesce(F.size(field), F.lit(0)) > 0) == F.lit(value)
        if op == "contains_all":
            return F.coalesce(F.size(F.array_except(wanted, field)) == 0, false)
        some = F.coalesce(F.arrays_overlap(field, wanted), false)
        return ~some if op == "contains_none" else some
    if op == "exists":
        return F.coalesce(field != "", false) == F.lit(value)
    if op in ("eq", "in"):
        return F.coalesce(field.isin(values), false)
    return F.coalesce(field >= value if op == "gte" else field <= value, false)


def tags_filter(all_: list[str] = (), any_: list[str] = (), none: list[str] = ()) -> dict | None:
    """The filter of a tag triple; None if it asks nothing."""
    parts = [{"field": "tags", "op": op, "value": list(v)} for op, v in (("contains_all", all_), ("contains_any", any_), ("contains_none", none)) if v]
    return combine(*parts)


def combine(*filters: dict | None) -> dict | None:
    """All of the given filters, None ignored."""
    found = [f for f in filters if f is not None]
    return None if not found else found[0] if len(found) == 1 else {"all": found}


def asked(node: dict | None) -> set[str]:
    """Fields that a filter reads."""
    if node is None:
        return set()
    if "not" in node:
        return asked(node["not"])
    return {node["field"]} if "field" in node else set().union(*(asked(x) for x in node.get("all", node.get("any"))))


def apply_filter(df: DataFrame, node: dict | None) -> DataFrame:
    """Rows that pass; a known field that df has no column for is missing in every row."""
    if node is None:
        return df
    validate(node)
    absent = sorted(asked(node) - set(df.columns))
    for field in absent:
        df = df.withColumn(field, F.lit(None).cast("array<string>" if FIELDS[field] == "array" else "string"))
    return df.where(compile_filter(node)).drop(*absent)


def _leaf(field: str, op: str, value) -> dict:
    return {"field": field, "op": op, "value": value}


_SOURCES = ["src:src1", "src:src2", "src:src3"]
#: Example filters, one for each operation and group, and their SQL.
_EXAMPLES = {
    "p3_eq": (_leaf("institution", "eq", "src3"), "coalesce(institution = 'src3', false)"),
    "p4_in": (_leaf("institution", "in", ["src1", "src4"]), "coalesce(institution IN ('src1', 'src4'), false)"),
    "p5_gte": (_leaf("published_at", "gte", "2024-07-01"), "coalesce(published_at >= '2024-07-01', false)"),
    "p5_lte": (_leaf("published_at", "lte", "2024-02-15"), "coalesce(published_at <= '2024-02-15', false)"),
    "p6_exists": (_leaf("published_at", "exists", True), "published_at IS NOT NULL AND published_at <> ''"),
    "p6_missing": (_leaf("institution", "exists", False), "institution IS NULL OR institution = ''"),
    "p7_contains_all": (_leaf("tags", "contains_all", ["lang:de", "src:src3"]), "list_has_all(tags, ['lang:de', 'src:src3'])"),
    "p8_contains_any": (_leaf("tags", "contains_any", _SOURCES), "list_has_any(tags, ['src:src1', 'src:src2', 'src:src3'])"),
    "p8_array_eq": (_leaf("tags", "eq", "lang:fr"), "list_contains(tags, 'lang:fr')"),
    "p9_contains_none": (_leaf("tags", "contains_none", ["lang:en"]), "NOT list_contains(tags, 'lang:en')"),
    "p10_not_eq": ({"not": _leaf("institution", "eq", "src3")}, "NOT coalesce(institution = 'src3', false)"),
    "p11_groups": (
        {"all": [{"any": [_leaf("institution", "eq", "src2"), _leaf("published_at", "gte", "2024-11-01")]}, {"not": _leaf("tags", "contains_any", ["lang:es"])}]},
        "(coalesce(institution = 'src2', false) OR coalesce(published_at >= '2024-11-01', false)) AND NOT list_contains(tags, 'lang:es')",
    ),
    "p14_tag_triple": (tags_filter(["lang:en"], ["src:src1", "src:src2"], ["src:src2"]), "list_contains(tags, 'lang:en') AND list_has_any(tags, ['src:src1', 'src:src2']) AND NOT list_contains(tags, 'src:src2')"),
}


def _example(node: dict):
    return lambda spark, sf_dir: apply_filter(documents(spark, sf_dir), node).select("document_id", "institution", "published_at")


for _name, (_node, _where) in _EXAMPLES.items():
    query(_name, f"{DOCS} SELECT document_id, institution, published_at FROM docs WHERE {_where}")(_example(_node))


def contains_text(needle: str, *columns: str) -> Column:
    """Case-insensitive, literal: no pattern characters."""
    return reduce(or_, [F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False)) for c in columns])


@query("p17_text", f"{DOCS} SELECT document_id, title FROM docs WHERE contains(lower(title), 'from src1') OR contains(lower(document_id), '77')")
def p17(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.where(contains_text("FROM SRC1", "title") | contains_text("77", "document_id")).select("document_id", "title")


@query("p19_card", f"{DOCS} SELECT document_id, title, institution, n_chars > 0 AS text_available, '/wiki/' || replace(replace(document_id, ':', '%3A'), ' ', '%20') AS open_url FROM docs WHERE NOT deleted")
def p19(spark, sf_dir):
    """Cards of live documents: default fields, whether there is text, where to open it."""
    url = F.concat(F.lit("/wiki/"), F.replace(F.url_encode("document_id"), F.lit("+"), F.lit("%20")))
    return documents(spark, sf_dir).where(~F.col("deleted")).select("document_id", "title", "institution", (F.col("n_chars") > 0).alias("text_available"), url.alias("open_url"))


@query(
    "p23_review_due",
    "SELECT doc_id, stage, next_review FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'archived' WHEN 1 THEN 'draft' WHEN 2 THEN 'active' END AS stage, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS VARCHAR) AS next_review FROM documents) WHERE coalesce(stage, '') <> 'archived' AND next_review <= '2024-06-30'",
)
def p23(spark, sf_dir, today: str = "2024-06-30"):
    """Due for review: not archived (an unset stage counts) and a date not after today."""
    n = F.col("doc_id")
    pages = documents(spark, sf_dir).select(
        "doc_id",
        F.when(n % 4 == 0, "archived").when(n % 4 == 1, "draft").when(n % 4 == 2, "active").alias("stage"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 365).cast("int")), "yyyy-MM-dd").alias("next_review"),
    )
    return pages.where((F.coalesce("stage", F.lit("")) != "archived") & (F.col("next_review") <= today))
