"""Null and repeated doc_ids, very long texts and clashing column names, for every operator and stage."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from marlstone.llm import bpe, minhash, mixing, passages, phrases, resampling, sharding, toxicity, vectors
from marlstone.llm.queries import tokenizer_file

CLASH = "_row _doc _id _key _b _m id kept size score copies target taken source_size node label h shard part n p start row first whole band text_crc32 component_id".split()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    long = " ".join(r.choice(words) for _ in range(60_000))
    base = [" ".join(r.choice(words) for _ in range(50)) for _ in range(5)]
    out = [(5, base[0], "s0"), (5, base[1], "s0"), (9, base[1], "s1"), (None, base[0], "s1"), (None, base[0], None), (7, base[2], "s1"), (7, base[2], "s1"), (11, long, "s2"), (12, long + " end", "s2"), (13, None, "s0"), (13, base[3], "s0"), (20, base[3] + " more", "s0"), (21, "", None)]
    return out + [(100 + k, base[4] + f" x{k}", "s1") for k in range(8)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(docs, rows, width):
    """Rows of one doc_id are one node; rows without one have no links."""
    known = [(i, shingles(t, width)) for i, t, _ in rows if i is not None]
    root = {i: i for i, _ in known}
    for _ in known:
        for i, a in known:
            for j, b in known:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    want = Counter((i, len(s), root[i], root[i] == i) for i, s in known)
    want += Counter((None, len(shingles(t, width)), None, True) for i, t, _ in rows if i is None)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near(docs, width).collect()) == want


@pytest.mark.parametrize("repeated", [False, True])
def test_minhash_row_without_id(spark, repeated):
    """A row without a doc_id has no component, whether or not another doc_id stands twice."""
    text = " ".join(f"w{k}" for k in range(30))
    table = [(1, text), (None, text), (2, "other words here")] + [(2, "other words there")] * repeated
    got = minhash.near(spark.createDataFrame(table, "doc_id long, text string"), 5)
    assert {(r["component_id"], r["kept"]) for r in got.where("doc_id is null").collect()} == {(None, True)}
    assert got.where("doc_id = 1").first()["component_id"] == 1


def test_passages_of_one_id(spark):
    """Rows of one doc_id lose nothing to each other, and the next document loses what either has."""
    a, b = "first passage " * 8, "second passage, quite another " * 4
    table = [(5, a + "x"), (5, a + "y"), (5, b), (6, a), (6, b), (None, b), (None, b)]
    got = passages.remove_repeats(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in got) == sorted([(5, len(a) + 1, 0), (5, len(a) + 1, 0), (5, len(b), len(b)), (6, len(a), len(a)), (6, len(b), len(b)), (0, len(b), 0), (0, len(b), len(b))])


def test_passages(docs, rows):
    """Rows of one doc_id are one document; rows without one are documents of their own before all others, in order of text."""
    seen, want = {}, Counter()
    for k, (i, text, _) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))):
        k = k if i is None else 1000 + i
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for at in range(len(b) - 49):
            if seen.setdefault(hash(b[at : at + 50]), k) < k:
                gone[at : at + 50] = True
        want[(i, len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    got = passages.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.sha2("kept", 256).alias("h"))
    assert Counter(tuple(r) for r in got.collect()) == want


def test_passages_hot_line(spark):
    """A line that all documents share, among many texts of one anchor."""
    line = "the same line stands in every document of this table, all of it, word for word"
    r = random.Random(2)
    table = [(i, f"{r.random()} {line} {r.random()}") for i in range(400)]
    want, seen = {}, {}
    for i, text in table:
        gone = set()
        for k in range(len(text) - 49):
            if seen.setdefault(text[k : k + 50], i) < i:
                gone |= set(range(k, k + 50))
        want[i] = len(gone)
    assert min(list(want.values())[1:]) >= len(line)
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    assert {x["doc_id"]: x["n_removed"] for x in passages.remove_repeats(df).collect()} == want


def test_bpe(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    want = Counter()
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t.decode(ids, skip_special_tokens=False))] += 1
    got = bpe.encode(docs, tokenizer_file()).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("h"), "decoded")
    assert Counter(tuple(r) for r in got.collect()) == want


def test_sharding(docs, rows):
    got = sharding.shard(docs, 3).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got))) for s in range(3))


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((i, s) for i, _, s in rows)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert 0 <= int(own[0]["target"] + 1e-9) - sum(r["taken"] for r in own) < 3  # the repeated rows at a cut may leave a few
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)


def test_phrases(docs, rows):
    got = phrases.neighbours(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t or "")) for i, t, _ in rows)
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert len(by[(7, len(rows[5][1]))]) == 1 and len(by[(None, len(rows[3][1]))]) == 1


def test_resampling_and_toxicity(spark, docs, rows):
    labels = spark.createDataFrame([(i, k % 2, 0) for k, (i, _, _) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = resampling.resample(docs, labels, share=0.5)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(i for i, _, _ in rows)
    scored = toxicity.score(docs.drop("score"), toxicity.fit(["a blockhead", "fine words"] * 5, [1, 0] * 5))
    assert Counter((r["doc_id"], r["size"]) for r in scored.collect()) == Counter((i, "clash") for i, _, _ in rows)


def test_vectors(spark):
    """Vectors of several lengths link among their own; names clash; a vec_id stands twice."""
    r = np.random.default_rng(4)
    data = []
    for n in (64, 3, 8):
        centre = r.standard_normal((4, n))
        data += [(1000 * n + k, [float(x) for x in centre[k % 4] * (1 + k) + 0.001 * r.standard_normal(n)], k % 2) for k in range(24)]
    data += [data[0], (None, data[0][1], 0), (5, [], 0), (6, [1.0], 0), (8, [2.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").select("*", *[F.lit("x").alias(c) for c in ("v", "node", "code", "a", "b", "n", "dims", "copies")])
    got = vectors.near(df).collect()
    assert len(got) == len(data)
    rows = {i: (np.array(v), l) for i, v, l in data if i is not None and v}
    links = {(i, j) for i, (v, l) in rows.items() for j, (w, m) in rows.items() if i < j and l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98}
    degree = Counter(k for pair in links for k in pair)
    assert {r["vec_id"]: r["n_links"] for r in got if r["vec_id"] is not None} == {i: degree[i] for i, _, _ in data if i is not None}


def test_stages_with_clashing_columns(spark, docs, rows, tmp_path):
    path = str(tmp_path)
    table = docs.withColumn("lang", F.lit("en")).withColumn("n_chars", F.char_length("text").cast("long"))
    table.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(k % 2)) for k, (i, _, _) in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    table = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in cp.STAGES[1:4]:
        out = stage(spark, table, path)
        assert out.columns == table.columns and out.where("score <> 'clash' or size <> 'clash' or kept <> 'clash'").count() == 0, name
    out = cp.clean(spark, table, path)
    assert out.columns == table.columns and out.where("score <> 'clash'").count() == 0
    assert cp.run(spark, path).columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded"]
    empty = table.where("false")
    for name, stage in cp.STAGES:
        assert stage(spark, empty, path).count() == 0, name
