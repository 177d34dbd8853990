"""The training-data operators against brute force on small tables with nulls, ties, repeats and clashing columns."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, minhash, mixing, passages, phrases, resampling, sharding, suffixes, toxicity, vectors, warc
from marlstone.llm.queries import tokenizer_file

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu".split()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    base = [" ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(60)) for _ in range(6)]
    out = []
    for i in range(120):
        words = r.choice(base).split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = f"w{r.randint(0, 9)}"
        out.append((i * 3, " ".join(words), "s" + str(i % 4) if i % 9 else None))
    return out + [(1000, None, "s1"), (1001, "", "s2"), (1002, " \n\t ", "s2"), (1003, "one", "s1"), (1004, "One", None), (1005, "é" * 300, "s3"), (1006, out[0][1], "s0"), (1007, out[0][1], "s0")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return df.withColumn("size", F.lit("clash")).withColumn("id", F.lit(7)).withColumn("key", F.lit("x"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(docs, rows, width):
    sets = {}
    for i, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closure(list(sets), links)
    got = minhash.near(docs, width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_passages(docs, rows):
    first, want = {}, {}
    for i, text, _ in sorted(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = True
        want[i] = (len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone]))
    for many in (64, 1):
        passages.MANY, before = many, passages.MANY
        got = passages.remove_repeats(docs).collect()
        passages.MANY = before
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got} == want


def test_suffix_order():
    r = random.Random(1)
    for _ in range(300):
        text = np.array([r.randint(0, r.choice([1, 3])) for _ in range(r.randint(0, 80))] * r.choice([1, 3]), np.int64)
        depth = r.choice([1, 3, 10, 500])
        cut = [text[i : i + depth].tolist() for i in suffixes.suffix_order(text, depth)]
        assert cut == sorted(cut)


def test_bpe(docs, rows, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    r = random.Random(2)
    alphabet = ["a", "b", "é", "e", "́", "1", "'s", " ", "İ", "Σ", "日", "!", "\x1c", "\xa0", "<|endoftext|>", "the"]
    hard = [(2000 + k, "".join(r.choice(alphabet) for _ in range(r.randint(0, 300)))) for k in range(60)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(hard, "doc_id long, text string"))
    for long, piece in ((65536, 32768), (8, 5)):
        got = {x["doc_id"]: (bytes(x["ids"]), x["decoded"]) for x in bpe.encode(table, tokenizer_file(), long, piece).collect()}
        for i, text in [(i, t_) for i, t_, _ in rows] + hard:
            ids = t.encode(text or "", add_special_tokens=False).ids
            assert got[i] == (np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)), repr(text)


def test_sharding(docs, rows):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    place = {}
    for r in got:
        b = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(b) + 1, zlib.crc32(b))
        assert place.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def filled(sizes, most):
    shards = [0]
    for b in sizes:
        if shards[-1] + b > most:
            shards.append(0)
        shards[-1] += b
    return shards


def test_sharding_smallest_capacity(spark):
    """Capacity and cuts against greedy filling of every capacity, with groups of very unequal sizes."""
    r = random.Random(3)
    cases = [(2, [8, 3, 11, 11]), (2, [1, 2, 3, 60, 1]), (4, [5, 40, 2, 9, 33, 1, 1, 28, 7, 36]), (8, [3]), (3, [int(r.lognormvariate(3, 1.5)) + 1 for _ in range(400)] + [2000])]
    for n_shards, sizes in cases:
        hashes = sorted(r.randint(-(2**63), 2**63 - 1) if len(sizes) > 20 else h for h in range(len(sizes)))
        want = next(c for c in range(max(sizes), sum(sizes) + 1) if len(filled(sizes, c)) <= n_shards)
        rows = [(h, part) for h, b in zip(hashes, sizes) for part in ([b // 2, b - b // 2] if b > 3 else [b])]
        most, ends, cuts = sharding.capacity(spark.createDataFrame(rows, "h long, size long"), n_shards)
        shards = [b - a for a, b in zip([0, *cuts], [*cuts, sum(sizes)])]
        assert most == want and shards == filled(sizes, want), sizes
        assert [sum(b for h, b in zip(hashes, sizes) if h <= e) for e in ends] == cuts


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(size), sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        for s in over or free:
            target[s] = 3 * size[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(target[s] + 1e-9) for s in size)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_vectors(spark):
    r = np.random.default_rng(3)
    centre = r.standard_normal((12, 64))
    data = [(i, [float(x) for x in centre[i % 12] + 0.08 * r.standard_normal(64)], i % 3) for i in range(300)]
    data += [(400, None, 1), (401, [0.0] * 64, 1), (402, [float("nan")] + [1.0] * 63, 1), (403, data[0][1], 0), (404, data[0][1], None), (405, [None] + [1.0] * 63, 0), (406, [1.0], 0)]
    x = {i: np.array(v) for i, v, l in data if v and len(v) == 64 and None not in v and np.isfinite(v).all() and np.any(v) and l is not None}
    label = {i: l for i, _, l in data}
    links = [(a, b) for a in x for b in x if a < b and label[a] == label[b] and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.98]
    degree, want = Counter(k for ab in links for k in ab), closure([i for i, _, _ in data], links)
    got = vectors.near(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()
    found = sum(r["n_links"] for r in got)
    assert len(got) == len(data) and found >= 0.9 * 2 * len(links)
    assert all(r["n_links"] <= degree[r["vec_id"]] for r in got)
    assert {r["vec_id"]: r["component_id"] for r in got} == want


def phrase_set(text):
    """Plain incremental parse of 1978, character by character."""
    seen, now = set(), ""
    for c in text:
        now += c
        if now not in seen:
            seen.add(now)
            now = ""
    return seen | ({now} if now else set())


def test_phrases(docs, rows):
    got = {r["doc_id"]: r for r in phrases.neighbours(docs).collect()}
    order = sorted(rows)
    off = []
    for k, (i, t, _) in enumerate(order):
        t, other = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, changed, following = map(phrase_set, (t, edited, other))
        for a, b, near in ((own, changed, r["near_edited"]), (own, following, r["near_next"])):
            assert 0 <= near <= 1 and (near == 1.0 or a != b)
            off.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
        assert (r["fingerprint"] == r["edited_fingerprint"]) >= (own == changed)
        assert r["fingerprint"] == phrases.fingerprint(t).astype(">u4").tobytes().hex()
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.09
    assert len(got) == len(rows) and len({r["fingerprint"] for i, r in got.items() if i in (0, 1006, 1007)}) == 1


def test_phrase_ends():
    """The parse against the plain one, and parts that share a beginning against whole texts."""
    r = random.Random(6)
    for _ in range(200):
        text, other = ("".join(r.choice("abé😀"[: r.randint(1, 4)]) for _ in range(r.randint(0, 90))) for _ in range(2))
        ends, left = phrases.parse(phrases._points(text), {})
        cuts = [0, *ends] + ([len(text)] if left < len(text) else [])
        assert {text[a:b] for a, b in zip(cuts, cuts[1:])} == phrase_set(text)
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        least = phrases.minima(phrases._phrases(text, edited, len(text) - half))
        for tail, whole in ((1, text), (2, edited)):
            assert (phrases.signature(np.minimum(least[0], least[tail])) == phrases.fingerprint(whole)).all()


def test_words_built_against_polynomial_hashes(spark):
    """Two words of many characters whose polynomials agree modulo 2**64 for every base share no shingle."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    table = []
    for n in (1024, 4096):
        table += [(n, word[:n]), (n + 1, word[:n].translate(str.maketrans("ab", "ba")))]
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in minhash.near(df).collect())
    assert len({r["fingerprint"] for r in phrases.neighbours(df).collect()}) == 4


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    urls = ["-", "", "http://x.org/a\tb", "http://x.org/a\nb", None]
    pages = [(i, f"http://www.ex{i % 5}.com/p{i % 40}?q=1#top" if i % 7 else urls[i // 7 % 5], [None, "", "same\r\n\r\nbody", f"<p>é {i}</p>"][i % 4]) for i in range(60)]
    pages += [(None, "http://ex1.com/p1?q=1", "no id"), (None, "http://ex1.com/p1?q=1", "no id"), (77, "http://ex2.com/long", "x<p>" * 1_500_000), (5, pages[5][1], "again"), (5, pages[5][1], "again")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit("clash")).withColumn("file", F.lit(1)).withColumn("sha1", F.lit("x"))
    latest = {}
    for i, _, h in pages:
        if i is not None:
            latest[h or ""] = max(i, latest.get(h or "", -1))
    want = Counter()
    for i, u, h in pages:
        b = (h or "").encode()
        again = i is not None and latest[h or ""] != i
        url = u if u is None else u.replace("\n", "%0A")
        want[(i, url, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", latest[h or ""] if again else None, None if again else h or "")] += 1
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html")
    assert Counter(tuple(r[n] for n in names) for r in warc.archive(df.repartition(3)).collect()) == want
    warc.write(df, f"{tmp_path}/a", archive=1000)
    warc.index(spark, f"{tmp_path}/a", f"{tmp_path}/i")
    assert len(warc._contents(f"{tmp_path}/a")) > 5
    some = spark.createDataFrame([("https://ex3.com/p3?q=1",), ("http://x.org/a\tb",), ("http://nowhere.org/",)], "url string")
    found = sorted(r["page_id"] for r in warc.fetch(f"{tmp_path}/a", f"{tmp_path}/i", some).collect())
    key = lambda u: warc.surt(None if u is None else u.replace("\n", "%0A"))
    assert found == sorted(i for i, u, _ in pages if key(u) in (key("http://ex3.com/p3?q=1"), key("http://x.org/a\tb")))
    assert warc.surt("http://user@WWW.Ex.org:8080/a?b#c") == "org,ex:8080)/a?b"
    with open(next(iter((tmp_path / "a").glob("*.warc.gz"))), "rb") as f:  # any gzip reader can read an archive
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\n")
    least = {r["page_id"]: r["record_type"] for r in warc.archive(df.where("page_id < 60"), least=5).collect()}
    assert all(least[i] == "response" for i in range(60) if i % 4 < 2)


def test_toxicity():
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioutrnsl") for _ in range(r.randint(2, 8)))
    texts, labels = [], []
    for k in range(300):
        w = [word() for _ in range(40)]
        if k % 3 == 0:
            w[r.randrange(40)] = r.choice(["blockhead", "wretch", "numpty"])
        texts.append(" ".join(w))
        labels.append(int(k % 3 == 0))
    model = toxicity.fit(texts, labels)
    clean = " ".join(word() for _ in range(30))
    scores = model.scores([clean, clean + " blockhead", clean + " b.l.o.c.k.h.e.a.d", clean + " bl0ckxhead", clean + " w r e t c h", "", None])
    assert scores[0] < 0.5 < min(scores[1:5]) and scores[5] < 0.5 and scores[6] < 0.5
    assert toxicity.fit([], []).scores(["x"])[0] == 0.0


def test_resampling(spark, docs, rows):
    labels = spark.createDataFrame([(i, int(k % 2 == 0), 0) for k, (i, _, _) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in resampling.resample(docs, labels, share=0.25, buckets=1 << 22).collect()}
    assert len(got) == len(rows) and sum(r["kept"] for r in got.values()) == -(-len(rows) // 4)
    assert [r["doc_id"] for r in sorted(got.values(), key=lambda r: r["place"])] == [r["doc_id"] for r in sorted(got.values(), key=lambda r: (-r["noisy_weight"], r["doc_id"]))]
    assert sorted(r["place"] for r in got.values()) == list(range(len(rows))) and all(r["kept"] == (r["place"] < -(-len(rows) // 4)) for r in got.values())
    # Weights: with so many buckets that no two features share one, the two models are plain counts, one added to each bucket.
    raw, good, own = Counter(), Counter(), {}
    for k, (i, text, _) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        own[i] = Counter([(x,) for x in w] + list(zip(w, w[1:])))
        raw += own[i]
        good += own[i] if k % 2 == 0 else Counter()
    a, b = sum(good.values()) + (1 << 22), sum(raw.values()) + (1 << 22)
    for i, features in own.items():
        weight = sum(n * (np.log((good[f] + 1) / a) - np.log((raw[f] + 1) / b)) for f, n in features.items())
        assert got[i]["n_features"] == sum(features.values()) and abs(got[i]["log_weight"] - weight) < 1e-6
    # The noise: that of the smallest uniform of n is what the hash of doc_id gives on each run; it is finite and differs.
    noise = {i: r["noisy_weight"] - r["log_weight"] for i, r in got.items()}
    assert np.isfinite(list(noise.values())).all() and len({round(x, 9) for x in noise.values()}) == len(rows)
    again = {r["doc_id"]: r["noisy_weight"] for r in resampling.resample(docs.repartition(5), labels, buckets=1 << 22).collect()}
    assert all(abs(again[i] - r["noisy_weight"]) < 1e-6 for i, r in got.items())
    none = labels.withColumn("quality", F.lit(0))
    assert not any(r["kept"] for r in resampling.resample(docs, none).collect())
    assert all(r["kept"] and r["log_weight"] == 0 for r in resampling.resample(docs, labels.where("false")).collect())


def test_empty_tables(spark, empty):
    assert minhash.near(empty).collect() == [] and passages.remove_repeats(empty).collect() == [] and sharding.shard(empty).collect() == []
    assert mixing.mix(empty).collect() == [] and phrases.neighbours(empty).collect() == [] and bpe.encode(empty, tokenizer_file()).collect() == []
    assert vectors.near(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert resampling.resample(empty, labels).collect() == [] and toxicity.score(empty, toxicity.train(empty, labels)).collect() == []


def test_subsequence_kernel():
    """The kernel and its Nystroem features against plain sums over all subsequences of three letters."""
    import itertools

    def counts(word):
        out = Counter()
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if k - i < toxicity.SPAN:
                out[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    def kernel(a, b):
        x, y = counts(a), counts(b)
        both = sum(v * y[c] for c, v in x.items())
        return both / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())), both / sum(v * v for v in y.values())

    marks = ["blockhead", "wretch", "numpty"]
    words = ["blockhead", "bloxckhead", "blockheads", "wretched", "wrech", "nxumptxy", "table", "chair", "head", "stretch"]
    index, rows = toxicity.Kernel(marks)(words)
    for w, row in ((words[i], r) for i, r in zip(index.tolist(), rows)):
        for m, got in zip(marks, row):
            want, share = kernel(w, m)
            assert abs(got - (want if share >= toxicity.NEAR else 0)) < 1e-5, (w, m)
    missing = set(words) - {words[i] for i in index.tolist()}
    assert all(kernel(w, m)[1] < toxicity.NEAR + 1e-9 for w in missing for m in marks) and "table" in missing
    # As many landmarks as there are words: the features' products are the kernel itself.
    index, square = toxicity.Kernel(marks)(marks)
    values, vectors = np.linalg.eigh(square)
    z = square @ (vectors / np.sqrt(values) @ vectors.T)
    assert np.allclose(z @ z.T, square, atol=1e-6)


def test_held_out_labels_are_not_learnt_from(spark):
    r = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "theta", "kappa"]
    table = [(i, ". ".join(" ".join(r.choice(words) for _ in range(8)) for _ in range(3)) + (f" you {r.choice(['blockhead', 'wretch', 'numpty'])}" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    true = [(i, 0, int(i % 4 == 0)) for i, _ in table]
    flipped = [(i, 0, 1 - t if held(i) else t) for i, _, t in true]
    scores = []
    for labels in (true, flipped):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        scores.append({x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()})
    assert scores[0] == scores[1]
    assert all((scores[0][i] >= 0.7) == bool(t) for i, _, t in true if held(i))
    assert {x["doc_id"]: x["h"] for x in docs.select("doc_id", toxicity.held_out("doc_id").alias("h")).collect()} == {i: held(i) for i, _ in table}
