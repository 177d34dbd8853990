"""The pipeline's stages and run() against brute force on a small table."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from marlstone.llm import mixing, toxicity
from marlstone.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu é日".split()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    base = [" ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(60)) for _ in range(10)]
    passage = "a passage that stands in many texts, word for word, and is long: é日é日é日é日 the end"
    texts = []
    for i in range(120):
        words = r.choice(base).split()
        if i % 2:
            r.shuffle(words)
        words[r.randrange(len(words))] = f"w{r.randint(0, 9)}"
        if i % 3 == 0:
            words.insert(r.randrange(len(words)), passage)
        if i % 5 == 0:
            words.insert(r.randrange(len(words)), r.choice(["blockhead", "wretch", "numpty"]))
        texts.append(" ".join(words))
    texts += [None, "", "one", texts[0]]
    return [(7 * i % 211, t, "en", f"s{i % 3}" if i % 11 else None, None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, int(i % 5 == 0)) for i, r in enumerate(rows[:120])]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def found(df):
    return Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect())


def clean(spark, rows, folder):
    model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    return [r for r in rows if model.scores([r[1]])[0] < 0.7]


def distinct(rows):
    """Rows of unique doc_id: the least of each component of shared five-word shingles."""
    sets = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return [r for r in rows if root[r[0]] == r[0]]


def without_repeats(rows):
    """Rows in the order that owns passages: an earlier row's windows of 50 bytes go from the later ones."""
    seen, out = {}, []
    for k, (i, text, lang, source, n) in enumerate(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for at in range(len(b) - 49):
            if seen.setdefault(b[at : at + 50], k) < k:
                gone[at : at + 50] = True
        if gone.any():
            text, at, kept = text or "", 0, []
            for c in text:
                w = len(c.encode())
                if not gone[at : at + w].any():
                    kept.append(c)
                at += w
            text, n = "".join(kept), len(kept)
        out.append((i, text, lang, source, n))
    return out


def mixed(spark, rows):
    """Whole documents as often as the budget of words takes them; the budget is checked against the sources' words."""
    got = mixing.mix(table(spark, rows), keep=("text", "lang", "n_chars")).collect()
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in own) == int(own[0]["target"] + 1e-9)
    out = Counter()
    for r in got:
        out[(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])] += r["copies"]
    return +out


def encoded(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    out = Counter()
    for row, times in Counter(rows).items():
        ids = t.encode(row[1] or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        out[(row[0], len(ids), raw, hashlib.sha256(raw).hexdigest(), t.decode(ids, skip_special_tokens=False))] += times
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: r[0])


def test_clean(spark, rows, folder):
    want = clean(spark, rows, folder)
    assert 0 < len(want) < len(rows)
    assert found(cp.clean(spark, table(spark, rows), folder)) == Counter(want)


def test_distinct(spark, rows, folder):
    want = distinct(rows)
    assert len(want) < len(rows)
    assert found(cp.distinct(spark, table(spark, rows), folder)) == Counter(want)


def test_without_repeats(spark, rows, folder):
    want = without_repeats(by_id(rows))
    assert Counter(want) != Counter(rows)
    assert found(cp.without_repeats(spark, table(spark, rows), folder)) == Counter(want)


def test_mixed(spark, rows, folder):
    assert found(cp.mixed(spark, table(spark, rows), folder)) == mixed(spark, rows)


def test_encoded(spark, rows, folder):
    again = [*rows, rows[0], rows[0]]
    assert found(cp.encoded(spark, table(spark, again), folder)) == encoded(again)


def test_run(spark, rows, folder):
    kept = without_repeats(by_id(distinct(clean(spark, rows, folder))))
    assert found(cp.run(spark, folder)) == encoded(list(mixed(spark, kept).elements()))


@pytest.fixture(scope="module")
def loose(rows):
    """Rows with null and repeated doc_ids: differing texts of one id, exact repeats, and near copies without an id."""
    some = rows[:40]
    nulls = [(None, *r[1:]) for r in (*rows[:4], *rows[50:56], rows[50])]
    twice = [(some[0][0], *rows[60][1:]), (some[3][0], *rows[6][1:]), (some[6][0], *rows[9][1:]), some[9], some[9]]
    return some + nulls + twice + [(None, None, "en", "s1", None), (some[2][0], None, "en", "s1", None)]


def as_numbers(rows, last):
    """Rows in the stage's order, with their place for a doc_id."""
    order = sorted(rows, key=lambda r: ((r[0] is None) == last, r[0] or 0, *((v is not None, v or 0) for v in (r[1], r[2], r[3], r[4]))))
    return order, [(k, *r[1:]) for k, r in enumerate(order)]


def test_distinct_without_ids(spark, loose, folder):
    order, _ = as_numbers(loose, True)
    ids, one = set(), []
    for r in order:
        if r[0] is None or r[0] not in ids:
            one.append(r)
        ids.add(r[0])
    kept = {r[0] for r in distinct([(k, *r[1:]) for k, r in enumerate(one)])}
    want = [r for k, r in enumerate(one) if k in kept]
    assert sum(r[0] is None for r in want) > 1
    assert found(cp.distinct(spark, table(spark, loose), folder)) == Counter(want)


def test_without_repeats_without_ids(spark, loose, folder):
    order, numbers = as_numbers(loose, False)
    want = [(r[0], *w[1:]) for r, w in zip(order, without_repeats(numbers))]
    assert found(cp.without_repeats(spark, table(spark, loose), folder)) == Counter(want)
