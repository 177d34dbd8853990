import pytest

from marlstone.functions.text import blocks
from marlstone.operators.catalog import opened, page, token
from marlstone.operators.filters import InvalidArgument, apply_filter, validate

ROWS = [("a", ["代码:00700.HK", "领域:O'Reilly_%"], "2026-08-01"), ("b", ["代码:700.HK"], None), ("c", ["代码:00700.HK"], None)]


def ids(df):
    return sorted(r["document_id"] for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, "document_id string, tags array<string>, published_at string").withColumn("deleted", F.lit(False))


def test_null_algebra(docs):
    leaf = lambda f, op, v: {"field": f, "op": op, "value": v}
    assert ids(apply_filter(docs, leaf("tags", "contains_all", ["代码:00700.HK"]))) == ["a", "c"]
    assert ids(apply_filter(docs, leaf("tags", "contains_none", ["代码:00700.HK"]))) == ["b"]
    assert ids(apply_filter(docs, leaf("published_at", "gte", "2026-07-01"))) == ["a"]
    assert ids(apply_filter(docs, {"not": leaf("published_at", "gte", "2026-07-01")})) == ["b", "c"]
    assert ids(apply_filter(docs, leaf("published_at", "exists", False))) == ["b", "c"]


@pytest.mark.parametrize("bad", [{}, {"all": []}, {"field": "no", "op": "eq", "value": "x"}, {"field": "published_at", "op": "gte", "value": "2026-02-30"}, {"field": "title", "op": "gte", "value": "x"}, {"field": "tags", "op": "exists", "value": "yes"}])
def test_invalid(bad):
    with pytest.raises(InvalidArgument):
        validate(bad)


@pytest.mark.parametrize("descending", [True, False])
def test_keyset_sees_each_row_once(spark, docs, descending):
    request, cursor, seen = {"filters": None, "sort": "published_at", "descending": descending}, None, []
    while True:
        rows = page(docs, descending=descending, limit=1, cursor=cursor).collect()
        seen.append(rows[0]["document_id"])
        if len(rows) == 1:
            break
        cursor = token(request, rows[0].asDict(), "published_at")
    assert seen == ["a", "b", "c"]
    with pytest.raises(InvalidArgument):
        opened(token(request, {"published_at": None, "document_id": "a"}, "published_at"), {"other": 1})


def test_blocks_are_lossless():
    body = "# Head\n\n" + "word " * 900 + "\n\n## PDF 第 2 页\n" + "😀" * 2000 + "\n\n## Sub\ntext"
    found = blocks(body)
    assert "".join(x[4] for x in found) == body
    assert all(len(x[4].encode("utf-16-le")) // 2 <= 1800 for x in found)
    assert found[-1][2] == 2 and found[-1][3][-1] == "Sub"
