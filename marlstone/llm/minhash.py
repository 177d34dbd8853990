"""MinHash near-dedup by min-max hashing: both the minimum and the maximum of each permutation are kept, so that half
the hash evaluations give a signature of the usual length; bands of the signature propose links, full sets confirm.

1. Every text becomes a set of word shingles (64-bit hashes); texts of equal sets are one class from there on.
2. The signature is cut into bands. Classes that share a band key are compared in a star around the key's most common
   class (the one whose keys have the most members: the text that the others were copied from, if it is there). A sketch
   drops pairs that cannot link: the parities of the shingles by hash value, whose differing bits are never more than the
   shingles that only one of the two has.
3. Shared shingles are counted over the full sets of both documents; components follow from the links.
4. A star leaves out pairs of two leaves. Where the leaves of a key still lie in different components, each leaf
   outside the key's main component is compared with the plausible members of other components, a pair in the first
   key it shares: so no link between components is lost, and no group is expanded into all its pairs.

Bands take the values of 64 permutations, 32 bands of 4 values: a pair of similarity 0.8 is missed with probability 5e-8.
The parities' bound is exact at any size, and tells most up to some 500 shingles.

Defined cases: a text with fewer words than a shingle is one shingle; without words (null, empty, white space) a
document has no shingles and no links; rows of one doc_id are one document for the components, and each row tells the size
of its own set; rows without a doc_id have no links and no component, and are kept; very long texts count whole; an
empty table gives an empty result; columns beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, as_long, buffers, chunks, cut, discard, mix, numbered, words_of
from .components import components

#: Permutations (two values each), and bands.
PERMUTATIONS, BANDS = 64, 32
#: Bits of the parity sketch.
PARITIES = 512
_PARITY = [f"p{k}" for k in range(PARITIES // 64)]
_SEEDS = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_MULTIPLY = _SEEDS[:PERMUTATIONS] | U(1)
_FLIP = _SEEDS[PERMUTATIONS:]


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their row, in order of row and hash."""
    word, row = words_of(data, bounds)
    n = len(bounds) - 1
    count = np.bincount(row, minlength=n)
    out, own = [], []
    if len(word) >= width:
        h = word[: len(word) - width + 1].copy()
        for k in range(1, width):
            h = mix(h * U(0x9E3779B97F4A7C15) + word[k : len(word) - width + 1 + k])
        inside = row[: len(row) - width + 1] == row[width - 1 :]
        out.append(mix(h[inside] + U(width)))
        own.append(row[: len(row) - width + 1][inside])
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):  # the whole sequence is the one shingle
        first = np.searchsorted(row, few)
        h = word[first]
        for k in range(1, width):
            more = count[few] > k
            h = np.where(more, mix(h * U(0x9E3779B97F4A7C15) + word[np.minimum(first + k, len(word) - 1)]), h)
        out.append(mix(h + count[few].astype(U) * U(0xD6E8FEB86659FD93)))
        own.append(few)
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h, own = np.concatenate(out), np.concatenate(own)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]
    return h[new], own[new]


def signatures(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minima and maxima (rows, 2 x PERMUTATIONS) of the sets that begin at starts."""
    out = np.empty((2 * PERMUTATIONS, len(starts)), U)
    for k in range(PERMUTATIONS):
        v = (h ^ _FLIP[k]) * _MULTIPLY[k]
        out[2 * k] = np.minimum.reduceat(v, starts)
        out[2 * k + 1] = np.maximum.reduceat(v, starts)
    return out.T


def parities(h: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Bits (n, PARITIES // 64) that tell of each of PARITIES ranges of hash values if a set has an odd number in it."""
    place = (own[:, None] * PARITIES + (h[:, None] >> U(64 - PARITIES.bit_length() + 1)).astype(np.int64)).ravel()
    odd = (np.bincount(place, minlength=n * PARITIES) & 1).astype(np.uint8).reshape(n, PARITIES)
    return np.packbits(odd, axis=1).view(U)


def _signed(width: int):
    names = ["doc_id", "n_shingles", "d1", "d2", "bands", *_PARITY]

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in chunks(offsets, 1 << 19):
                h, own = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                n = j - i
                count = np.bincount(own, minlength=n).astype(np.int64)
                d1, d2 = np.zeros(n, U), np.zeros(n, U)
                bands, parity = np.zeros((n, BANDS), U), parities(h, own, n)
                full = np.flatnonzero(count)
                if len(full):
                    starts = np.searchsorted(own, full)
                    d1[full] = np.add.reduceat(mix(h), starts)
                    d2[full] = np.add.reduceat(mix(h ^ U(0xA5A5A5A5A5A5A5A5)), starts)
                    rows = mix(np.ascontiguousarray(signatures(h, starts))).reshape(len(full), BANDS, -1)
                    key = np.arange(1, BANDS + 1, dtype=U)[None, :] * U(0x9E3779B97F4A7C15)
                    for k in range(rows.shape[2]):
                        key = mix(key + rows[:, :, k])
                    bands[full] = key
                flat = pa.array(as_long(bands).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS), pa.int32()), flat)
                columns = [pa.array(as_long(x)) for x in (count, d1, d2)]
                bits = [pa.array(as_long(parity[:, k])) for k in range(parity.shape[1])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), *columns, lists, *bits], names)

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in chunks(offsets, 1 << 19):
                h, own = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                ends = np.searchsorted(own, np.arange(j - i + 1)) * 8
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(h.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), packed.cast(pa.binary())], ["node", "hashes"])

    return run


def _shared(batches):
    """Size of the intersection of two sorted sets."""
    for batch in batches:
        found = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            found.append(int((y[at] == x).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.int64())], ["a", "b", "both"])


def near(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row (doc_id, text) of docs.

    Documents link when 100 * shared shingles >= percent * shingles in either. component_id is the smallest doc_id
    reachable by links. width and percent are the shingle's words and the threshold.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _linked(docs, width, percent)
    # Rows are numbered in order of doc_id, so that the smallest row of a component has its smallest doc_id.
    rows = cut(numbered(docs.where("doc_id is not null"), ["doc_id", F.xxhash64("text")], "row"), "rows")
    first = rows.groupBy("doc_id").agg(F.min("row").alias("first"))
    same = cut(rows.join(first, "doc_id").where("row <> first").select("row", "first"), "same")
    found = _linked(rows.select(F.col("row").alias("doc_id"), "text"), width, percent, same)
    ids = rows.select("row", F.col("doc_id").alias("id"))
    named = found.join(ids, F.col("doc_id") == F.col("row")).select("id", "n_shingles", "component_id")
    named = named.join(ids.select("row", F.col("id").alias("least")), F.col("component_id") == F.col("row"))
    rest = _linked(docs.where("doc_id is null"), width, percent)
    return named.select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"), (F.col("id") == F.col("least")).alias("kept")).union(rest)


def _linked(docs: DataFrame, width: int, percent: int, same: DataFrame | None = None) -> DataFrame:
    """near for unique (or null) doc_ids; same holds further links of doc_ids."""
    longs = ", ".join(f"{c} long" for c in _PARITY)
    signed = cut(docs.mapInArrow(_signed(width), f"doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, {longs}"), "signed")
    one = F.min(F.struct("doc_id", "bands", *_PARITY)).alias("one")
    grouped = signed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "d1", "d2").agg(one)
    classes = cut(grouped.select("n_shingles", "d1", "d2", F.col("one.doc_id").alias("node"), "one.bands", *[f"one.{c}" for c in _PARITY]), "classes")
    sketch = classes.select("node", "n_shingles", *_PARITY)
    keyed = classes.select("node", F.posexplode("bands").alias("band", "key"))
    common = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(keyed.join(common, "key"), "members")
    fame = members.groupBy("node").agg(F.sum("n").alias("fame"))
    famed = members.join(fame, "node")
    centres = famed.groupBy("key").agg(F.max_by("node", F.struct("fame", -F.col("node"))).alias("centre"))
    groups = cut(members.select("key", "band", "node").join(centres, "key"), "groups")

    def apart(p: str, q: str) -> Column:
        return reduce(add, [F.bit_count(F.col(f"{p}.{c}").bitwiseXOR(F.col(f"{q}.{c}"))) for c in _PARITY])

    def plausible(p: str, q: str) -> Column:
        sizes = 100 * F.least(f"{p}.n_shingles", f"{q}.n_shingles") >= percent * F.greatest(f"{p}.n_shingles", f"{q}.n_shingles")
        # At the threshold the shingles of one text alone are (100 - percent) / (100 + percent) of both texts' together.
        alone = (100 + percent) * apart(p, q) <= (100 - percent) * (F.col(f"{p}.n_shingles") + F.col(f"{q}.n_shingles"))
        return sizes & alone

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that link."""
        likely = cut(
            pairs.join(sketch.alias("p"), F.col("a") == F.col("p.node"))
            .join(sketch.alias("q"), F.col("b") == F.col("q.node"))
            .where(plausible("p", "q"))
            .select("a", "b", (F.col("p.n_shingles") + F.col("q.n_shingles")).alias("total")),
            "likely",
        )
        with_b = likely.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
        with_a = with_b.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
        counted = with_a.select("a", "b", "x", "y").mapInArrow(_shared, "a long, b long, both long")
        out = cut(counted.join(likely, ["a", "b"]).where(F.col("both") * 100 >= percent * (F.col("total") - F.col("both"))).select("a", "b"), "links")
        discard(likely)
        return out

    # Full sets of all that share a key with another: the texts are shuffled once.
    nodes = groups.select("node").distinct().hint("shuffle_merge")
    sets = cut(docs.join(nodes, F.col("doc_id") == F.col("node")).select("node", "text").mapInArrow(_sets(width), "node long, hashes binary"), "sets")
    starred = groups.where("node <> centre").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    links = confirmed(starred)
    found = cut(components(links), "components")
    # Keys whose members are not all in one component yet.
    member = groups.select("key", "band", "node").join(found, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("c"))
    tally = member.groupBy("key", "c").agg(F.count("*").alias("n"))
    mixed = tally.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("c", F.struct("n", "c")).alias("main")).where("parts > 1").select("key", "main")
    open_ = cut(member.join(mixed, "key").join(classes.drop("d1", "d2"), "node"), "open")
    outside, other = open_.where("c <> main").alias("o"), open_.alias("m")
    first = F.array_position(F.zip_with("o.bands", "m.bands", lambda x, y: x == y), F.lit(True)) == F.col("o.band") + 1
    once = (F.col("m.c") == F.col("m.main")) | (F.col("o.node") < F.col("m.node"))
    cross = outside.join(other, (F.col("o.key") == F.col("m.key")) & (F.col("o.c") != F.col("m.c")) & once & plausible("o", "m") & first)
    pairs = cross.select(F.least("o.node", "m.node").alias("a"), F.greatest("o.node", "m.node").alias("b")).distinct()
    # What the stars have compared already need not be compared again.
    more = confirmed(pairs.join(starred, ["a", "b"], "left_anti"))
    final = cut(components(links.union(more)), "components")
    discard(members, groups, sets, links, more, found, open_)
    named = classes.join(final, "node", "left").select("n_shingles", "d1", "d2", F.coalesce("component", "node").alias("component_id"))
    joined = signed.select("doc_id", "n_shingles", "d1", "d2").join(named, ["n_shingles", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))  # a row without doc_id has none, whatever the others have
    if same is not None:  # links between rows also join the components of what they belong to
        of = cut(joined.select("doc_id", component.alias("c")), "of")
        a, b = same.columns
        ends = same.join(of.toDF(a, "u"), a).join(of.toDF(b, "v"), b).select("u", "v")
        whole = components(ends).toDF("component_id", "whole")
        joined = joined.withColumn("component_id", component).join(whole, "component_id", "left")
        component = F.coalesce("whole", "component_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
