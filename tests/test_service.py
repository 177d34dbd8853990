"""The operations: snapshots behind cursors, old revisions, truncation, degraded stages, direction, days."""

import shutil

import pytest
from pyspark.sql import functions as F

from marlstone.operators.filters import InvalidArgument
from marlstone.plans.service import Service

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A corpus of its own, which tests may change."""
    path = tmp_path_factory.mktemp("corpus")
    for name in ("supplier", "region", "embeddings"):
        shutil.copy(f"{SOURCE}/{name}.parquet", path / f"{name}.parquet")
    docs = spark.read.parquet(f"{SOURCE}/documents.parquet").where("doc_id < 80")
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path), docs


def refused(service, operation, /, **args):
    with pytest.raises(InvalidArgument) as problem:
        service.execute(operation, **args)
    return str(problem.value).split(":")[0]


@pytest.fixture(scope="module")
def service(spark, corpus, tmp_path_factory):
    return Service(spark, corpus[0], str(tmp_path_factory.mktemp("service")))


def test_every_list_says_when_it_was_cut(service):
    """Following cursors gives each row once, and the last page is whole."""
    for operation, args in (
        ("resolve", {"q": "Report"}), ("describe", {"section": "tags"}), ("describe", {}), ("query", {"group_by": "tags"}), ("query", {"sort": "title"}),
        ("graph", {"group_by": "tag"}), ("read", {"id": "doc:4", "view": "blocks"}), ("search", {"query": "the", "mode": "lexical"}),
    ):
        whole = service.execute(operation, limit=100, max_response_tokens=32_000, **args)
        seen, cursor, pages = [], None, 0
        while True:
            found = service.execute(operation, limit=3, max_response_tokens=32_000, **args, **({"cursor": cursor} if cursor else {}))
            seen += found["results"]
            pages += 1
            assert found["truncated"] == (found["next_cursor"] is not None)
            cursor = found["next_cursor"]
            if cursor is None or pages == 4:
                break
        assert seen == whole["results"][: len(seen)] and (cursor or len(seen) == len(whole["results"])), operation


def test_budget_cuts_and_goes_on(service):
    first = service.execute("query", limit=100, max_response_tokens=512, sort="title", direction="asc")
    assert first["truncated"] and first["budget"]["cut"] and first["returned_count"] < 20
    second = service.execute("query", limit=100, max_response_tokens=512, sort="title", direction="asc", cursor=first["next_cursor"])
    assert second["total"] == first["total"] and second["results"][0] not in first["results"]


def test_cursors(spark, corpus, service):
    found = service.execute("query", limit=2)
    cursor = found["next_cursor"]
    assert refused(service, "query", limit=2, cursor="zzz") == "INVALID_CURSOR"
    assert refused(service, "query", limit=2, cursor=cursor, sort="title") == "CURSOR_MISMATCH"
    assert refused(service, "resolve", q="x", cursor=cursor) == "CURSOR_MISMATCH"
    late = Service(spark, corpus[0], service.snapshots.root, clock=lambda: __import__("time").time() + 700)
    assert refused(late, "query", limit=2, cursor=cursor) == "CURSOR_EXPIRED"


def test_degraded_and_empty(service):
    assert [d["stage"] for d in service.execute("search", query="the")["degraded"]] == ["embedding_or_vector"]
    assert [d["stage"] for d in service.execute("search", query="the", mode="deep")["degraded"]] == ["deep", "embedding_or_vector"]
    vector = [0.1] * 64
    found = service.execute("search", query="the", query_vector=vector, explain=True, expected_id="doc:1")
    assert found["degraded"] == [] and any("vector" in r["channels"] for r in found["results"]) and found["query_plan"]["expected"]["id"] == "doc:1"
    none = {"field": "language", "op": "eq", "value": "xx"}
    assert service.execute("search", query="the", filters=none)["empty_reason"] == "no_documents_match_filters"
    assert service.execute("search", query="zzzzqqq", mode="lexical")["empty_reason"] == "no_match_in_searched_text"
    assert service.execute("search", query="zzzzqqq")["empty_reason"] == "retrieval_incomplete"


def test_timeout(service):
    """A time that is given holds: jobs that take longer are cancelled."""
    assert refused(service, "graph", group_by="entity", timeout_ms=100) == "TIMEOUT"
    assert service.execute("query", limit=1, timeout_ms=60_000)["returned_count"] == 1
    assert refused(service, "query", timeout_ms=99) == "INVALID_ARGUMENT"


def test_direction_types_and_days(service):
    walk = lambda **a: {(r["source"], r["target"]) for r in service.execute("related", id="doc:18", depth=2, **a)["results"]}
    assert walk(direction="outgoing") == {("doc:18", "doc:2")} and ("doc:18", "doc:2") not in walk(direction="incoming")
    seed = {"kind": "entity", "id": "entity:company:7"}
    count = lambda **a: service.execute("graph", operation="neighbors", seed=seed, relation_types=["issued_by"], **a)["total"]
    assert count() == 1 and count(relation_as_of="1900-01-01") == 0 and count(relation_as_of="2024-03-01") == 1
    assert refused(service, "graph", operation="neighbors", seed=seed, relation_types=["likes"]) == "INVALID_ARGUMENT"
    assert refused(service, "related", id="doc:18", depth=3) == "INVALID_ARGUMENT"


def test_pages_are_of_one_snapshot_and_old_revisions_stay(spark, corpus):
    """The corpus changes between two pages: the cursor goes on in its generation; the old text can still be read, by its revision only."""
    path, docs = corpus
    import tempfile

    service = Service(spark, path, tempfile.mkdtemp(prefix="spark-"))
    first = service.execute("query", limit=30, sort="title", direction="asc")
    old = service.execute("read", id="doc:4", view="blocks", limit=1, max_response_tokens=32_000)
    before = docs.withColumn("text", F.when(F.col("doc_id") == 4, "quite another text").otherwise(F.col("text"))).where("doc_id <> 5").collect()
    spark.createDataFrame(before, docs.schema).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    again = service.execute("query", limit=1)
    assert not again["coverage"]["complete"] and again["degraded"][0]["stage"] == "catalog"
    service.publish()
    second = service.execute("query", limit=100, sort="title", direction="asc", cursor=first["next_cursor"], max_response_tokens=32_000)
    assert second["snapshot_id"] == first["snapshot_id"] and first["returned_count"] + second["returned_count"] == first["total"]
    now = service.execute("query", limit=1)
    assert int(now["snapshot_id"]) == int(first["snapshot_id"]) + 1 and now["total"] == first["total"] - 1 and now["degraded"] == []
    fresh = service.execute("read", id="doc:4", view="blocks")
    assert [r["text"] for r in fresh["results"]] == ["quite another text"] and fresh["current_revision"]
    kept = service.execute("read", id="doc:4", view="blocks", limit=1, max_response_tokens=32_000, revision_id=old["revision_id"])
    assert kept["results"] == old["results"] and not kept["current_revision"] and kept["total_blocks"] == old["total_blocks"]
    assert [r["document_id"] for r in service.execute("search", query="quite another text", mode="lexical")["results"]] == ["doc:4"]
    service.publish()
    service.publish()  # the first generation is gone
    assert refused(service, "query", limit=100, sort="title", direction="asc", cursor=first["next_cursor"]) == "CURSOR_EXPIRED"


def test_many_matches_are_counted_and_paged(spark, tmp_path):
    """A name that more than ten thousand documents hold gives a page of them and their number."""
    for name in ("supplier", "region"):
        shutil.copy(f"{SOURCE}/{name}.parquet", tmp_path / f"{name}.parquet")
    docs = spark.range(11_500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = Service(spark, str(tmp_path), str(tmp_path / "service")).execute("resolve", q="Report", limit=3)
    live = docs.where("doc_id % 11 <> 0").count()
    assert found["total"] == live > 10_000 and found["ambiguous"] and found["truncated"]
    assert [r["document_id"] for r in found["results"]] == ["doc:1", "doc:10", "doc:100"]


def test_all_documents_of_an_entity_that_match(spark, tmp_path):
    """More of them than a shortlist (120) holds; the search shows a page of the same documents."""
    for name in ("supplier", "region"):
        shutil.copy(f"{SOURCE}/{name}.parquet", tmp_path / f"{name}.parquet")
    n = F.col("id") * 30 + 3  # documents that name the company of the search
    text = F.when(F.col("id") % 2 == 0, "Of the one").otherwise("of another")
    docs = spark.range(320).select(n.alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(10).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    service = Service(spark, str(tmp_path), str(tmp_path / "service"))
    args = {"query": "the", "entity_name": "Supplier#000000004", "entity_type": "company"}
    every = {r["document_id"] for r in service.matching(**args).collect()}
    assert every == {f"doc:{30 * k + 3}" for k in range(0, 320, 2) if (30 * k + 3) % 11} and len(every) > 120
    shown = service.execute("search", mode="lexical", group_by="passage", limit=100, max_response_tokens=32_000, **args)
    confirmed = {r["document_id"] for r in shown["results"] if r["identity_status"] == "confirmed_membership"}
    assert confirmed and confirmed <= every
    assert service.matching(**args | {"entity_name": "Acme 3"}).isEmpty()
