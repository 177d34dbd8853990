"""File sources and the service on small fixtures: damaged lines, refused archives, pages by cursor, cut responses."""

import pytest

from marlstone.functions.text import blocks, query_terms
from marlstone.operators.cleanup import Notices, projected
from marlstone.operators.filters import InvalidArgument
from marlstone.plans.service import Service
from marlstone.sources.files import folded_journal, sheet_rows, unzipped

DATA = "/root/testdata/sf0.001"


def journal(spark, *lines):
    return folded_journal(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, n long, value string"), ["a", "b"])


def test_journal_folds_fields(spark):
    rows = journal(spark, '{"id": "x", "a": "1", "b": "2"}', '{"id": "x", "a": "3"}', '{"id": "y", "b": "4"}', '{"id": "x", ').collect()
    assert sorted(tuple(r) for r in rows) == [("x", "3", "2"), ("y", None, "4")]


def test_journal_damaged_in_the_middle(spark):
    with pytest.raises(Exception, match="damaged"):
        journal(spark, '{"id": "x", "a": "1"}', '{"id": ', '{"id": "x", "a": "3"}').collect()


def test_not_a_zip():
    assert unzipped("p", b"nothing")[0]["problem"] == "not a zip"
    with pytest.raises(Exception):
        sheet_rows(b"nothing")


def test_headings_of_one_level_replace_each_other():
    assert [b[3] for b in blocks("### C\n" + "x" * 1800 + "\n## B\n" + "x" * 1800)][-1] == ["B"]
    assert blocks("# A\n### C\n### D\n")[0][3] == ["A", "D"]
    assert blocks("a\n## PDF 第 3 页  \nb")[1][2] == 3


def test_blocks_beyond_the_basic_plane():
    body = "😀" * 1000 + "\n\n" + "x" * 10 + "\n# 😀 head\n"
    found = blocks(body, 1001)
    assert "".join(b[4] for b in found) == body and [b[1] for b in found[:-1]] == [b[0] for b in found[1:]]
    assert all(len(b[4].encode("utf-16-le")) // 2 <= 1003 for b in found) and found[-1][3] == ["😀 head"]


def test_query_units():
    assert query_terms("央行加息 AI") == [["央", "行", "加", "息"], ["ai"]] and query_terms("!") == []


def test_notice_projection_is_ambiguous():
    """One chunk, two places, of which only one is within a removed line."""
    rules = Notices(["add me"], [r"add"], [])
    body = "## PDF 第 1 页\nme too\nadd me\n"
    clean, removed, keep = rules.clean(body)
    assert clean == "## PDF 第 1 页\nme too\n\n" and [r[1] for r in removed] == ["text"]
    assert projected(body, keep, "me") is None and projected(body, keep, "too add me") == "too" and projected(body, keep, "not there") is None


@pytest.fixture(scope="module")
def service(spark):
    return Service(spark, DATA)


def test_envelope_and_cursor(service):
    args, seen = {"filters": {"field": "lang", "op": "eq", "value": "fr"}, "limit": 7, "sort": "title", "direction": "asc"}, []
    while True:
        found = service.execute("query", **args)
        assert found["returned_count"] == len(found["results"]) <= 7 and found["snapshot_id"] == "1"
        seen += [r["document_id"] for r in found["results"]]
        if found["next_cursor"] is None:
            break
        args["cursor"] = found["next_cursor"]
    assert len(seen) == len(set(seen)) == found["total_count"]
    with pytest.raises(InvalidArgument, match="CURSOR_MISMATCH"):
        service.execute("query", **{**args, "direction": "desc", "cursor": service.execute("query", limit=1)["next_cursor"]})


def test_budget_cuts_and_continues(service):
    one = service.execute("query", limit=100, max_response_tokens=512, fields=["revision_id", "family_id"])
    assert one["budget"]["cut"] and one["next_cursor"]
    two = service.execute("query", limit=100, max_response_tokens=512, fields=["revision_id", "family_id"], cursor=one["next_cursor"])
    assert not {r["document_id"] for r in one["results"]} & {r["document_id"] for r in two["results"]}


def test_search_says_why_it_is_empty(service):
    found = service.execute("search", query="zzzzqqqq", mode="lexical", expected_id="doc:3")
    assert found["results"] == [] and found["empty_reason"] == "no_match_in_searched_text" and found["expected"] == {"passes_filters": True, "shortlisted": False}
    none = service.execute("search", query="the", filters={"field": "lang", "op": "eq", "value": "xx"})
    assert none["empty_reason"] == "no_documents_match_filters"


def test_security_master_columns_changed(spark):
    from marlstone.sources.files import security_master

    listed = spark.createDataFrame([("[{code:'600000',name:'N'}]",)], "value string")
    good = spark.createDataFrame([(["cik", "name", "ticker", "exchange"], [["1", "A", "T", "N"]])], "fields array<string>, data array<array<string>>")
    assert sorted(tuple(r) for r in security_master(good, listed).collect()) == [("SH", "600000", "N"), ("US", "T", "A")]
    with pytest.raises(Exception, match="changed"):
        security_master(spark.createDataFrame([(["name"], [["A"]])], "fields array<string>, data array<array<string>>"), listed).collect()
