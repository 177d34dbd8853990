"""Edge cases of the bibliography and maintenance operators on small fixtures."""

from pyspark.sql import functions as F

from marlstone.operators import maintenance, reports


def test_analyst_ids(spark):
    rows = [("Jane Q. Doe, CFA",), ("Ludwig M. van der Berg",), ("Plato",), ("",), ("CFA",), (None,), ("José  Pérez, Ph. D.",)]
    out = spark.createDataFrame(rows, "n string").select("n", reports.analyst_id(F.col("n")).alias("id")).collect()
    assert [r.id for r in out] == ["jane-doe", "ludwig-van-der-berg", "plato", "research", "research", "research", "jose-perez"]


def test_dictionary_scope_and_ambiguity(spark):
    entries = spark.createDataFrame([(1, 10, "A. Smith"), (2, 20, "a smith"), (3, None, "Lee"), (4, 10, None)], "id int, scope int, alias string")
    values = spark.createDataFrame([("ASmith", 10), ("A-Smith", None), ("LEE", 20), ("lee", 20), ("lee", 20), ("", 10), (None, 10)], "value string, scope int")
    found = sorted((r.value or "", r.match) for r in reports.dictionary_match(values, entries).collect())
    assert found == sorted([("ASmith", 1), ("A-Smith", None), ("LEE", 3), ("lee", 3), ("lee", 3), ("", None), ("", None)], key=lambda x: (x[0], x[1] or 0))


def test_file_name_contract(spark):
    good = "2026-02-03_GS_jane-doe_Macro_AAPL+0700.HK_Some-Title_12p.pdf"
    bad = [good.replace("02-03", "02-30"), good.replace("_GS_", "_XX_"), good.replace("Macro", "Weather"), good.replace("12p", "p"), good.replace("Some-Title", "T" * 91), good[:-4], good.replace(".pdf", "_x.pdf"), "é" + good]
    rows = spark.createDataFrame([(n,) for n in [good, *bad]], "n string").select(reports.file_name_ok(F.col("n"), ["GS"]).alias("ok")).collect()
    assert [r.ok for r in rows] == [True] + [False] * len(bad)


def test_resume_keeps_begun_work(spark):
    plan = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    journal = spark.createDataFrame([(1, 1, "intent"), (1, 2, "complete"), (2, 3, "complete"), (2, 4, "intent")], "k int, seq int, state string")
    assert sorted(maintenance.remaining(plan, journal, "k").collect()) == [(2, True), (3, False)]


def test_merge_patch_nulls(spark):
    pages = spark.createDataFrame([(1, {"a": "x", "b": "y"}), (2, None), (3, {"a": "z"})], "k int, fields map<string,string>")
    patches = spark.createDataFrame([(1, {"b": "n", "c": "m"}), (2, {"a": "q"}), (9, {"a": "lost"})], "k int, fields map<string,string>")
    assert {r.k: r.fields for r in maintenance.merge_patch(pages, patches, "k").collect()} == {1: {"a": "x", "b": "n", "c": "m"}, 2: {"a": "q"}, 3: {"a": "z"}}


def test_integrity(spark):
    a = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "k int, size int")
    b = spark.createDataFrame([(1, 5), (2, 4), (4, 1)], "k int, size int")
    assert sorted(maintenance.integrity(a, b, "k", ["size"]).collect()) == [(2, "changed"), (3, "removed"), (4, "added")]
