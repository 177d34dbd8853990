"""Document fingerprints from Lempel-Ziv phrases: a text is parsed into dictionary phrases, the phrase set is hashed, and
its signature of minima compares texts much as compression against each other would.

The parse is the incremental one of 1978: each phrase is the shortest that the dictionary does not hold yet. The
dictionary holds every prefix of its phrases, so a phrase's end is sought from the last phrase's length.

The signature is one permutation in 64 ranges: each phrase's hash falls in one range, of which the minimum is kept. Minima of
parts of a text are merged range by range; ranges without a phrase then borrow from ranges that have one, in an order
that depends on the range alone, so that the share of equal values stays an unbiased estimate of the phrases in common.

``neighbours`` also fingerprints each text with its last half replaced by the beginning of the next document's. Rows
are dealt by ranges of doc_id and sorted there; each range also gets a copy of the next range's first row.

Defined cases: null is the empty text, whose phrase set is empty (alike only to the empty set); rows of one doc_id (or
with none, which come first) follow each other by hash of their text; a lone document is its own next; very long texts
are parsed whole, in one task; an empty table gives an empty result; columns beside doc_id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, mix, span_hashes

#: Ranges of the permutation (a power of two).
VALUES = 64
_BITS = VALUES.bit_length() - 1
_NONE = U(0xFFFFFFFFFFFFFFFF)
#: For each range, the ranges it borrows from, in turn: a permutation of its own.
_LENDERS = np.argsort(mix(np.arange(VALUES * VALUES, dtype=U) * U(0xD6E8FEB86659FD93) + U(1)).reshape(VALUES, VALUES), axis=1)


def parse(points: list[int], trie: dict[int, int], begin: int = 0) -> tuple[list[int], int]:
    """Ends of the phrases of code points from place begin on, and where what is left over begins: it is a phrase that the
    dictionary has already. trie (node and code point to node; 0 is the root) grows by a node for each phrase."""
    ends: list[int] = []
    node, top, known = 0, len(trie), trie.get
    for at, point in enumerate(points[begin:] if begin else points, begin + 1):
        key = node << 21 | point
        node = known(key, 0)
        if not node:
            top += 1
            trie[key] = top
            ends.append(at)
    return ends, ends[-1] if ends else begin


def minima(parts: list[tuple[str, list[int]]]) -> np.ndarray:
    """For each part, a text and the ends of phrases that follow each other from its start: the least hash in each of the
    ranges; all ones where none is. All parts are hashed in one go."""
    out = np.full((len(parts), VALUES), _NONE)
    raw, places, base = [], [], 0
    for text, ends in parts:
        at = np.array(ends, np.int64)
        body = text.encode("utf-8", "surrogatepass")
        if len(body) > len(text):  # places in code points to places in bytes
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            at = np.r_[0, np.cumsum(wide)][at]
        raw.append(body)
        places.append(at + base)
        base += len(body)
    count = np.array([len(ends) for _, ends in parts])
    if count.sum():
        end = np.concatenate(places)
        start = np.r_[0, end[:-1]]
        full = np.flatnonzero(count)
        first = (np.cumsum(count) - count)[full]
        start[first] = np.cumsum([0, *map(len, raw)])[full]
        h = span_hashes(np.frombuffer(b"".join(raw), np.uint8), start, end)
        np.minimum.at(out.reshape(-1), np.repeat(np.arange(len(parts)), count) * VALUES + (h >> U(64 - _BITS)).astype(np.int64), h)
    return out


def signature(least: np.ndarray) -> np.ndarray:
    """Values of 32 bits from the minima of the ranges; empty ranges borrow the first value in their order of lenders."""
    empty = least == _NONE
    values = (least >> U(64 - _BITS - 32)).astype(np.uint32)
    if empty.any() and not empty.all():
        holes = np.flatnonzero(empty)
        lender = _LENDERS[holes]
        values[holes] = values[lender[np.arange(len(holes)), np.argmin(empty[lender], axis=1)]]
    return values


def _points(text: str) -> list[int]:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).tolist()


def fingerprint(text: str) -> np.ndarray:
    ends, left = parse(_points(text), {})
    if left < len(text):
        ends.append(len(text))
    return signature(minima([(text, ends)])[0])


def _phrases(text: str, edited: str, same: int) -> list[tuple[str, list[int]]]:
    """Parts and phrase ends of what a text and its edited text begin with alike (same code points), and of the rest of each."""
    trie: dict[int, int] = {}
    ends, cut = parse(_points(text[:same]), trie)
    out = [(text[:same], ends)]
    for whole in (text, edited):
        more, left = parse(_points(whole[cut:]), dict(trie))
        if cut + left < len(whole):
            more.append(len(whole) - cut)
        out.append((whole[cut:], more))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal values, an estimate of the share of phrases in common."""
    return float((a == b).mean())


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Texts and code points whose phrases are hashed in one go.
_TEXTS, _POINTS = 100, 1 << 18


def _walk(batches):
    """Rows in order of bucket and place; a bucket's last row is a copy of the next one's first."""
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    rows: list[tuple] = []  # bucket, tail, doc_id, text; the first may be one whose successor is yet to come

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        """All rows that have their successor among rows; the last row is only a successor."""
        parts, heads = [], []
        for row, following in zip(rows, rows[1:]):
            if row[0] != following[0] or row[1]:
                continue
            text, other = row[3], following[3]
            half = len(text) // 2
            edited = text[: len(text) - half] + other[:half]
            heads.append((row, edited))
            parts += _phrases(text, edited, len(text) - half)
        if not heads:
            return None
        least = minima(parts).reshape(len(heads), 3, VALUES)
        own = [signature(np.minimum(x[0], x[1])) for x in least]
        # Who follows has its own signature already, but for the last row and for copies of the next bucket's first row.
        known = {id(row): s for (row, _), s in zip(heads, own)}
        out = []
        for ((row, edited), mine, x), following in zip(zip(heads, own, least), [f for r, f in zip(rows, rows[1:]) if r[0] == f[0] and not r[1]]):
            changed = signature(np.minimum(x[0], x[2]))
            successor = known.get(id(following))
            if successor is None:
                successor = fingerprint(following[3])
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((row[2], len(row[3]), sha, mine.astype(">u4").tobytes().hex(), changed.astype(">u4").tobytes().hex(), likeness(mine, changed), likeness(mine, successor)))
        return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names)

    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text"))):
            rows.append(row)
            size += len(row[3])
            if len(rows) > _TEXTS or size > _POINTS:
                if (found := flush(rows)) is not None:
                    yield found
                rows, size = rows[-1:], 0
    if (found := flush(rows)) is not None:
        yield found


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    lowest = F.lit(-(1 << 63))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("place", F.coalesce("doc_id", lowest))
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    many = 4 * parts
    cuts = rows.agg(F.percentile_approx("place", [k / many for k in range(1, many)], 20 * many)).first()[0] or []
    cuts = sorted(set(cuts))

    @F.pandas_udf("int")
    def bucket(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, place.to_numpy(), "right").astype(np.int32))

    rows = rows.withColumn("bucket", bucket("place")).withColumn("tail", F.lit(False))
    heads = sorted((r["bucket"], r["first"]) for r in rows.groupBy("bucket").agg(F.min("place").alias("first")).collect())  # one per bucket
    if heads:
        before = {first: heads[k - 1][0] for k, (_, first) in enumerate(heads)}  # the first range follows the last
        target = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
        tails = rows.where(F.col("place").isin([f for _, f in heads])).withColumn("bucket", target[F.col("place")]).withColumn("tail", F.lit(True))
        rows = rows.unionByName(tails)
    placed = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", "place", F.xxhash64("text"))
    return placed.select("bucket", "tail", "doc_id", "text").mapInArrow(_walk, _FIELDS)
