"""Walks from many seeds against the single walk, and the interval join against all pairs."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest

from marlstone.operators.graph import traverse
from marlstone.operators.intervals import on_days
from marlstone.operators.walk import walk


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(6)
    rows = {(f"n{min(r.randint(0, 59), r.randint(0, 59))}", f"n{r.randint(0, 59)}", r.choice("xy"), r.choice(["p", "q"])) for _ in range(260)}
    rows |= {("hub", f"n{k}", "x", "p") for k in range(60)} | {("n1", "n1", "x", "p")}
    return spark.createDataFrame(sorted(rows), "source string, target string, type string, provenance string").repartition(3).cache()


@pytest.mark.parametrize("direction", ["both", "outgoing", "incoming"])
@pytest.mark.parametrize("depth,nodes,edges", [(1, 100, 300), (2, 12, 300), (2, 400, 9), (3, 30, 25)])
def test_many_seeds_are_single_walks(spark, graph, direction, depth, nodes, edges):
    seeds = ["hub", "n1", "n7", "n33", "nowhere"]
    taken, told = walk(graph, spark.createDataFrame([(s,) for s in seeds], "seed string"), depth, nodes, edges, direction)
    got = defaultdict(set)
    for r in taken.collect():
        got[r["seed"]].add((r["source"], r["target"], r["type"], r["provenance"]))
    counts = {r["seed"]: (r["nodes"], r["edges"], r["truncated"]) for r in told.collect()}
    for s in seeds:
        seen, edges_, cut = traverse(graph, s, depth, nodes, edges, direction)
        assert got[s] == set(edges_) and counts[s] == (len(seen), len(edges_), cut)


def test_direction_on_every_hop(spark):
    g = spark.createDataFrame([("a", "b", "t", ""), ("c", "b", "t", ""), ("b", "d", "t", "")], "source string, target string, type string, provenance string")
    assert [e[:2] for e in traverse(g, "a", 2, direction="outgoing")[1]] == [("a", "b"), ("b", "d")]
    assert [e[:2] for e in traverse(g, "d", 2, direction="incoming")[1]] == [("b", "d"), ("a", "b"), ("c", "b")]


def test_walks_as_of_a_day(spark):
    """Each seed has its own day; undated edges always hold."""
    d = date
    rows = [("a", "b", "t", "1", True, d(2024, 1, 1), None, d(2024, 1, 5)), ("b", "c", "t", "2", True, d(2024, 1, 1), d(2024, 2, 1), d(2024, 1, 1)), ("a", "e", "t", "3", False, None, None, None), ("a", "f", "t", "4", True, None, None, d(2024, 1, 1))]
    g = spark.createDataFrame(rows, "source string, target string, type string, provenance string, dated boolean, valid_from date, valid_to date, observed_at date")
    seeds = spark.createDataFrame([("a", d(2024, 1, 20)), ("b", d(2024, 1, 2)), ("e", d(2024, 3, 1)), ("f", None)], "seed string, day date")
    got = defaultdict(set)
    for r in walk(g, seeds, 2)[0].collect():
        got[r["seed"]].add(r["provenance"])
    assert got == {"a": {"1", "2", "3"}, "b": {"2"}, "e": {"3", "1"}, "f": {"4", "1", "3"}}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_interval_join(spark, keys):
    r, zero = random.Random(1), date(2023, 1, 1)
    day = lambda n: zero + timedelta(days=n)
    rows = []
    for k in range(300):
        a = r.choice([None, r.randint(0, 900)]) if k % 9 == 0 else r.randint(0, 900)
        b = None if a is None or k % 4 == 0 else a + r.choice([0, 1, 3, 40, 700, 70_000, -5])
        rows.append((k, k % 7, a if a is None else day(a), b if b is None else day(b), None if k % 11 == 0 else day(r.randint(0, 900))))
    days = [(n, n % 7, day(r.randint(-20, 1000))) for n in range(80)]
    intervals = spark.createDataFrame(rows, "id long, k long, valid_from date, valid_to date, observed_at date")
    asked = spark.createDataFrame(days, "n long, k long, day date")
    got = on_days(intervals, asked if keys else asked.drop("k"), keys)
    want = {(i, n) for i, k, a, b, o in rows for n, q, x in days if a and a <= x and (b is None or b >= x) and o and o <= x and (not keys or k == q)}
    found = [(x["id"], x["n"]) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() or not keys
