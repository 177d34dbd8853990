"""Spelling variants by errata-trie merging: pairs of words one inserted, deleted or replaced code point apart, and the forms
that rare spellings follow.

1. Words are counted in the tasks that read the texts, then summed. Those of at least ``LEAST`` code points and ``TWICE`` occurrences
   are dealt by range, so that the trie's subtrees are runs of sorted words within a range; the few nodes whose words lie in
   several ranges (prefixes of two words at a border) get their children's sizes by one aggregation over all ranges.
2. At each node the child with most words is heavy (ties: the smallest code point), the others light; a word lies in at most
   log2(words) light subtrees. Each light subtree is merged small-to-large into its node and its siblings: a word P c R of the light
   child c of P enters the errata trie with c skipped (P R), with c replaced by the heavy child's code point h (P h R), with h
   put before it (P h c R), and, for its light siblings, with c replaced by a mark. The last code point is skipped at its node, too,
   if its edge is heavy.
3. Entries that coincide with a word's terminal, and words that coincide under one mark (no more than the alphabet has code points),
   are the pairs. Two words part at one node, where at most one of them goes on in the heavy child, so each pair comes once.

A word's form is its near word of most occurrences (ties: the smallest in code-point order) if those are ``FACTOR`` times its own at
least; its root is the last form of the chain. Occurrences grow tenfold with each form, so chains are short, and are followed by
doubling.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one in the checksum; repeated rows count each;
very long texts are read whole and very long words compared whole; an empty table gives an empty result; columns beside
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

LEAST, TWICE, FACTOR, EVERY = 7, 2, 10, 31
#: Words a task counts before it hands them on, and words in a range of the trie.
REMEMBER, RANGE = 400_000, 50_000
_LOWER = {k: k + 32 for k in range(65, 91)}
#: In place of a replaced code point; no word has it.
MARK = "*"
_END = chr(0x10FFFF)


def damaged(prefix: int, word: str) -> str:
    """The word, or without one code point where EVERY divides the checksum (prefix: that of what stands before the word)."""
    h = zlib.crc32(word.encode(), prefix)
    return word if h % EVERY else word[: h % len(word)] + word[h % len(word) + 1 :]


def _counted(least: int):
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)  # matches begin where runs begin, and are whole runs

    def run(batches):
        total: Counter[str] = Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                own = Counter(runs.findall((text.as_py() or "").translate(_LOWER)))
                for word in [w for w in own if not zlib.crc32(w.encode(), prefix) % EVERY]:
                    n, short = own.pop(word), damaged(prefix, word)
                    if len(short) >= least:
                        total[short] += n
                total.update(own)
                if len(total) >= REMEMBER:
                    yield out()
        yield out()

    return run


def words(docs: DataFrame, least: int = LEAST, twice: int = TWICE) -> DataFrame:
    """word, n: words of docs (doc_id, text) with at least least code points and twice occurrences."""
    counted = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(_counted(least), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


def common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def _children(sorted_words: list[str], low: int, high: int, depth: int) -> list[tuple[str, int, int]]:
    """Runs of sorted_words[low:high] (one prefix of depth code points) by the next code point; a word that ends there is in none."""
    out = []
    low += len(sorted_words[low]) == depth
    while low < high:
        c = sorted_words[low][depth]
        end = bisect_right(sorted_words, sorted_words[low][: depth + 1] + _END, low, high)
        out.append((c, low, end))
        low = end
    return out


def _borders(spines: dict[int, tuple[int, int]]):
    """Children of a range's nodes that other ranges share: prefixes of its first word up to one length, of its last up to another."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = sorted(table.column("word").to_pylist())
        first, last = spines[key[0].as_py()]
        nodes = {own[0][:d] for d in range(first + 1)} | {own[-1][:d] for d in range(last + 1)}
        rows = []
        for p in nodes:
            low, high = bisect_right(own, p) - (p in own[:1] or p in own[-1:]), bisect_right(own, p + _END)
            rows += [(p, c, b - a) for c, a, b in _children(own, low, high, len(p))] if low < high else []
        return pa.table({"node": pa.array([r[0] for r in rows], pa.string()), "c": pa.array([r[1] for r in rows], pa.string()), "size": pa.array([r[2] for r in rows], pa.int64())})

    return run


def light(own: list[str], shared: dict[str, str]) -> list[list[tuple[int, str]]]:
    """Of each of the sorted words the light edges on its path: depth of the node and code point of its heavy child.

    shared: heavy children of nodes whose words are not all here (none where a node has one child only)."""
    edges: list[list[tuple[int, str]]] = [[] for _ in own]
    deepest = max(map(len, shared), default=-1)
    stack = [(0, len(own), 0)] if own else []
    while stack:
        low, high, depth = stack.pop()
        fork = common(own[low], own[high - 1])
        for d in range(depth, min(fork, deepest + 1)):  # nodes with one child here, but perhaps with others elsewhere
            heavy = shared.get(own[low][:d])
            if heavy is not None and len(own[low]) > d and heavy != own[low][d]:
                for k in range(low, high):
                    edges[k].append((d, heavy))
        children = _children(own, low, high, fork)
        if not children:
            continue
        heavy = shared.get(own[low][:fork]) if fork <= deepest else None
        if heavy is None:
            heavy = max(children, key=lambda x: (x[2] - x[1], -ord(x[0])))[0]
        for c, a, b in children:
            if c != heavy:
                for k in range(a, b):
                    edges[k].append((fork, heavy))
            if b - a > 1 or deepest > fork:
                stack.append((a, b, fork + 1))
    return edges


def _entries(shared: dict[str, str], least: int):
    """Errata of the words of a range: key, the word, its n, and whether the key holds a mark."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        own, n = table.column("word").to_pylist(), table.column("n").to_pylist()
        keys, of = [], []
        for k, (word, edges) in enumerate(zip(own, light(own, shared))):
            size, last = len(word), len(word) - 1
            for d, h in edges:
                before, c, rest = word[:d], word[d], word[d + 1 :]
                keys += [before + MARK + rest, before + h + rest, before + h + c + rest]
                of += [k, k, k]
                if size > least and rest[:1] != c:
                    keys.append(before + rest)
                    of.append(k)
            if size > least and not (edges and any(d == last for d, _ in edges)):
                keys.append(word[:-1])
                of.append(k)
        of_ = pa.array(of, pa.int64())
        return pa.table({"key": pa.array(keys, pa.string()), "word": pa.array(own, pa.string()).take(of_), "n": pa.array(n, pa.int64()).take(of_)})

    return run


def pairs(vocabulary: DataFrame, least: int = LEAST, size: int = RANGE) -> DataFrame:
    """a, a_n, b, b_n: pairs of near words of vocabulary (word, n; each word once), each pair once."""
    parts = max(1, math.ceil(vocabulary.count() / size))
    dealt = cut(vocabulary.repartitionByRange(parts, "word").withColumn("part", F.spark_partition_id()), "dealt")
    ends = dealt.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last")).orderBy("part").collect()  # two words of each range
    ends = [tuple(r) for r in ends]
    spines = {p: [-1, -1] for p, _, _ in ends}
    for (p, _, last), (q, first, _) in zip(ends, ends[1:]):
        spines[p][1] = spines[q][0] = common(last, first)
    shared = {}
    if len(ends) > 1:
        sizes = dealt.groupBy("part").applyInArrow(_borders({p: tuple(s) for p, s in spines.items()}), "node string, c string, size long")
        sizes = sizes.groupBy("node", "c").agg(F.sum("size").alias("size"))
        heavy = sizes.groupBy("node").agg(F.min_by("c", F.struct(-F.col("size"), F.col("c"))).alias("c"), F.count("*").alias("k")).where("k > 1")
        shared = {r["node"]: r["c"] for r in heavy.collect()}  # nodes on the borders of ranges
    errata = cut(dealt.groupBy("part").applyInArrow(_entries(shared, least), "key string, word string, n long"), "errata")
    found = errata.join(vocabulary.select(F.col("word").alias("key"), F.col("n").alias("b_n")), "key")
    found = found.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("key").alias("b"), "b_n")
    marked = errata.where(F.contains("key", F.lit(MARK)))
    siblings = marked.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("w")).where("size(w) > 1")  # as many as the alphabet has
    siblings = siblings.select("w", F.posexplode("w").alias("at", "x")).select("x", F.explode(F.expr("slice(w, at + 2, size(w))")).alias("y"))
    return found.union(siblings.select("x.word", "x.n", "y.word", "y.n"))


def group(docs: DataFrame, least: int = LEAST, twice: int = TWICE, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of docs (doc_id, text)."""
    vocabulary = cut(words(docs, least, twice), "words")
    near = cut(pairs(vocabulary, least), "pairs")
    both = near.union(near.select("b", "b_n", "a", "a_n")).toDF("word", "n", "near", "near_n")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    told = both.groupBy("word").agg(F.count("*").alias("n_near"), best)
    told = vocabulary.join(told, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best.near_n") >= factor * F.col("n"), F.col("best")).alias("best"))
    told = cut(told.select("word", "n", "n_near", F.col("best.near").alias("form"), F.col("best.near_n").alias("form_n")), "forms")
    most = told.agg(F.max("n")).first()[0] or 1
    chain = told.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(2, math.log(most, factor) + 1)))):  # a chain has at most log(most) forms
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chain = cut(chain.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return told.join(chain, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
