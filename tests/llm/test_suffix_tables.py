"""The suffix sort over tables against sorted suffixes and brute force."""

import random

from marlstone.llm import suffix_tables


def test_order(spark):
    r = random.Random(3)
    text = [r.choice([1, 2]) for _ in range(60)]
    got = suffix_tables.order(spark.createDataFrame(list(enumerate(text)), "pos long, c long"), 9).collect()
    assert sorted(x["place"] for x in got) == list(range(len(text)))
    prefixes = [text[x["pos"] : x["pos"] + 9] for x in sorted(got, key=lambda x: x["place"])]
    assert prefixes == sorted(prefixes)


def test_covered(spark):
    r = random.Random(4)
    line = "a line of some length that several documents share"
    docs = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 12))) + (line if i % 2 else "") + "x" * (i % 3)) for i in range(6)] + [(9, None), (10, "é" * 20)]
    seen, want = {}, set()
    for i, text in docs:
        raw = (text or "").encode()
        for at in range(len(raw) - 11):
            if seen.setdefault(raw[at : at + 12], i) < i:
                want.add((i, at))
    got = suffix_tables.covered(spark.createDataFrame(docs, "doc_id long, text string"), 12).collect()
    assert {(x["doc_id"], x["at"]) for x in got} == want and want
