"""Whitening, spelling variants and packing against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import packing, spelling, whitening
from marlstone.llm.queries import tokenizer_file

CLASH = "n word key root form part component piece start length task place rank v dims a b r node size".split()


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


def embeddings(n, dims, seed=3):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, dims)) @ r.standard_normal((dims, dims)) * 0.3).tolist()


def test_whitening(spark):
    good = embeddings(300, 12)
    rows = list(enumerate(good)) + [(7, good[7]), (None, good[1])]
    kept = [v for _, v in rows]
    rows += [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [1.0] * 11 + [float("nan")]), (904, [float("inf")] * 12), (905, [1.0, 2.0]), (906, [1e300] * 12)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7))
    got = whitening.whiten(df).collect()
    x = np.floor(64 * np.array(kept)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    e, axes = np.linalg.eigh(np.cov((x - total / n).T, bias=True))
    e, axes = e[::-1], axes[:, ::-1]
    assert Counter(r["vec_id"] for r in got) == Counter({i: 12 * c for i, c in Counter(i for i, v in rows[:302]).items()})
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    want = (x - total / n) @ axes / np.sqrt(e)
    deviation = [sum(int(v) ** 2 for v in row) for row in n * x - total]
    for r in got:
        if r["vec_id"] not in (7, None):
            assert abs(abs(r["whitened"]) - abs(want[r["vec_id"], r["component"] - 1])) < 1e-7
            assert r["deviation"] == deviation[r["vec_id"]]
            assert abs(r["explained"] / (e / e.sum())[r["component"] - 1] - 1) < 1e-9


def test_whitening_tree(spark):
    """More factors than are merged at once; the same components as in one task."""
    df = spark.createDataFrame(list(enumerate(embeddings(200, 5))), "vec_id long, embedding array<double>")
    one = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(df.coalesce(1)).collect()}
    many = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(df.repartition(40)).collect()}
    assert one.keys() == many.keys() and max(abs(abs(one[k]) - abs(many[k])) for k in one) < 1e-9


def test_whitening_without_variance(spark):
    """Fewer rows than entries, a constant entry, no rows."""
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0, 5.0]), (2, [2.0, 0.0, 5.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["component"], r["whitened"] is None) for r in got) == [(i, c, c > 1) for i in (1, 2) for c in (1, 2, 3)]
    assert {abs(round(r["whitened"], 9)) for r in got if r["component"] == 1} == {1.0} and max(r["identity_error"] for r in got) < 1e-9
    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).count() == 0


def test_whitening_large_numbers():
    """Integers beyond a long are summed and squared exactly, or null where a long cannot hold them."""
    centre = whitening.Centre(1 << 40, [5, 7])
    d = centre.rows(np.array([[1 << 30, 3]]))
    assert d.tolist() == [[(1 << 70) - 5, 3 * (1 << 40) - 7]] and centre.deviations(d) == [None]


def near_words(docs, least=7, twice=2, factor=10):
    count = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            count[w] += len(w) >= least
    count = {w: n for w, n in count.items() if n >= twice}
    near = defaultdict(set)
    masks = defaultdict(set)
    for w in count:
        for k in range(len(w)):
            masks[w[:k] + "*" + w[k + 1 :]].add(w)
            if (v := w[:k] + w[k + 1 :]) in count:
                near[v].add(w)
                near[w].add(v)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda v: (-count[v], v)) for w in count if near[w]}
    form = {w: v for w, v in best.items() if count[v] >= factor * count[w]}
    out = set()
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, n, len(near[w]), form.get(w), count.get(form.get(w)), root))
    return out


@pytest.mark.parametrize("size", [5, 40, 100_000])
@pytest.mark.parametrize("letters", ["aab", "aéBÿ"])
def test_spelling_pairs(spark, size, letters):
    """Ranges of any size give the pairs of brute force: deletions in runs of one letter, prefixes, siblings."""
    r = random.Random(size)
    table = Counter("".join(r.choice(letters) for _ in range(r.randint(7, 9))).lower() for _ in range(400))
    vocabulary = spark.createDataFrame(list(table.items()), "word string, n long")
    got = [tuple(sorted((x["a"], x["b"]))) for x in spelling.pairs(vocabulary, 7, size).collect()]
    one = lambda a, b: sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else any(max(a, b, key=len)[:k] + max(a, b, key=len)[k + 1 :] == min(a, b, key=len) for k in range(max(len(a), len(b)))) and abs(len(a) - len(b)) == 1
    assert sorted(got) == sorted((a, b) for a in table for b in table if a < b and one(a, b))


def test_spelling(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(6, 10))) for _ in range(40)]
    docs = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(40)], k=80))) for i in range(120)]
    docs += [(None, docs[0][1]), (None, None), (500, ""), (501, "x" * 5000 + " " + "x" * 5001 + " " + "x" * 5000 + "," + "X" * 5001), (501, docs[3][1]), (502, "naïvetés NAÏVETÉS 123abcdefgh456abcdefgh")]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = {tuple(x) for x in spelling.group(df).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == near_words(docs) and any(x[3] for x in got)
    assert spelling.group(df.where("false")).count() == 0


def test_spelling_chain(spark):
    """A form of a form: the root is the last."""
    docs = [(k, w) for k, w in enumerate(["abcdefgh"] * 500 + ["abcdefgx"] * 44 + ["abcdefyx"] * 3)]
    got = {x["word"]: (x["form"], x["root"]) for x in spelling.group(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got["abcdefyx"] == ("abcdefgx", "abcdefgh") and got["abcdefgh"] == (None, "abcdefgh")


def test_plan():
    """Every piece is placed, no sequence is overfull, and few are more than the tokens need."""
    r = np.random.default_rng(5)
    for size, lengths in ((2048, np.clip(r.lognormal(6, 1, 20_000), 1, 2048)), (64, r.integers(1, 65, 3000)), (10, [3] * 7), (8, []), (100, [51] * 9 + [49] * 4)):
        histogram = np.bincount(np.array(lengths, int), minlength=size + 1)
        made = packing.plan(histogram, size)
        used = np.zeros(size + 1, int)
        for times, parts in made:
            assert times > 0 and sum(n * k for n, k in parts) <= size
            for n, k in parts:
                used[n] += times * k
        assert (used == histogram).all()
        least = -(-int((histogram * np.arange(size + 1)).sum()) // size)
        if len(lengths) > 1000:
            assert sum(times for times, _ in made) <= least * 1.015 + 1


def test_packing(spark):
    from tokenizers import Tokenizer

    r = random.Random(2)
    rows = [(k, " ".join(f"w{r.randint(0, 99)}, Tree" for _ in range(r.randint(0, 60)))) for k in range(150)]
    rows += [(None, None), (None, "one"), (7, rows[7][1]), (900, ""), (901, "word\x1fother <|endoftext|> 一"), (902, "long text of words " * 2000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    t = Tokenizer.from_file(tokenizer_file())
    want, ids = Counter(), [(i, [*t.encode(text or "", add_special_tokens=False).ids, 0]) for i, text in rows]
    for i, x in ids:
        for p in range(0, len(x), 256):
            part = x[p : p + 256]
            want[(i, p // 256, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = packing.pack(df, tokenizer_file(), size=256).collect()
    assert Counter(tuple(x)[:5] for x in got) == want
    sequences = defaultdict(list)
    for x in got:
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= -(-sum(len(x) for _, x in ids) // 256) * 1.02 + 1
    assert packing.pack(df.where("false"), tokenizer_file()).count() == 0
