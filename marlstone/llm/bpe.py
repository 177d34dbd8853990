"""BPE encoding and decoding with a public tokenizer file, exactly as its library does, long texts by tree concatenation.

A text is encoded word by word (a word ends at white space, which no token of these files crosses), and each worker
keeps the words it has met. A long text is cut in halves until a piece has at most ``piece`` characters; the pieces are
dealt out and encoded in parallel, wherever the cuts fall, and joined again pair by pair: around each join a window
is encoded anew and grown until it agrees with the left side and with the right side, ids and places both, at two
pre-tokens in a row.

Defined cases: null and empty texts have no tokens; a null doc_id stays null; repeated rows each get their row; very long texts
are cut and joined; an empty table gives an empty result; columns beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters from which a text is cut, and the most in a piece: a shorter text takes a few milliseconds as a whole.
LONG, PIECE = 65_536, 32_768
#: Words a worker remembers; beyond it the memory starts anew (a matter of speed alone).
REMEMBER = 200_000
#: New words that are encoded as one text.
EACH = 100
#: White space for Python's split that is none for the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")


class Encoder:
    """One tokenizer in one worker."""

    made: dict[str, "Encoder"] = {}

    @classmethod
    def at(cls, path: str) -> "Encoder":
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def decode(self, ids) -> str:
        return self.tokenizer.decode(list(ids), skip_special_tokens=False)

    def _learn(self, words: list[str]) -> None:
        """Encode new words, a hundred to a text with blanks between them (a text's cost grows faster than its length), and tell their
        ids apart by their places."""
        for k in range(0, len(words), 100 * EACH):
            parts = [words[i : i + EACH] for i in range(k, min(k + 100 * EACH, len(words)), EACH)]
            for part, found in zip(parts, self.tokenizer.encode_batch([" ".join(p) for p in parts], add_special_tokens=False)):
                starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
                at = np.searchsorted(starts, np.cumsum([0, *(len(w) + 1 for w in part)])).tolist()
                packed, tokens = np.array(found.ids, "<u4").tobytes(), found.tokens
                for word, a, b in zip(part, at, at[1:]):
                    self.young[word] = (packed[4 * a : 4 * b], " ".join(tokens[a:b]))

    def texts(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Of each text the ids as little-endian words of 32 bits, and the decoded text."""
        if len(self.young) > REMEMBER:
            self.young, self.old = {}, self.young
        parts = [None if _ODD.search(t) else t.split() for t in texts]
        new = []
        for word in set().union(*(p for p in parts if p is not None)) - self.young.keys():
            if word in self.old:
                self.young[word] = self.old[word]
            else:
                new.append(word)
        if new:
            self._learn(new)
        known, out = self.young.__getitem__, []
        for text, words in zip(texts, parts):
            if words is None:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append((np.array(ids, "<u4").tobytes(), self.decode(ids)))
            else:
                found = list(map(known, words))
                out.append((b"".join([x for x, _ in found]), " ".join([x for _, x in found if x])))
        for word in new:
            if len(word) > 200:
                del self.young[word]
        return out

    def text(self, text: str) -> tuple[bytes, str]:
        return self.texts([text])[0]

    def piece(self, text: str, at: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """Pre-tokens: start and end in the whole text, ids."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        out: list[tuple[int, int, tuple[int, ...]]] = []
        last = None
        for i, (a, b), word in zip(found.ids, found.offsets, found.word_ids):
            if word is not None and word == last:
                out[-1] = (out[-1][0], max(out[-1][1], b + at), (*out[-1][2], i))
            else:
                out.append((a + at, b + at, (i,)))
            last = word
        return out

    def join(self, text: str, begin: int, cut: int, end: int, left: list, right: list) -> list:
        """Pre-tokens of text[begin:end] from those of its two sides."""
        width = 64
        while True:
            low, high = max(begin, cut - width), min(end, cut + width)
            window = self.piece(text[low:high], low)
            i = self._agree(window, left, low, cut, begin == low, True)
            j = self._agree(window, right, cut, high, end == high, False)
            if i is not None and j is not None and i[0] <= j[0]:
                return [*left[: i[1]], *window[i[0] : j[0]], *right[j[1] :]]
            if low == begin and high == end:
                return window
            width *= 2

    @staticmethod
    def _agree(window: list, side: list, low: int, high: int, whole: bool, left: bool):
        """Where window and side can be exchanged: index in window and in side. None if they do not yet agree.

        whole: the window reaches to the far end of this side, so that the window may stand for all of it.
        """
        if whole:
            return (0, 0) if left else (len(window), len(side))
        places = {x: k for k, x in enumerate(side)}
        order = range(len(window) - 2, 0, -1) if left else range(1, len(window) - 1)
        for k in order:  # nearest the cut first; the window's outermost pre-token may itself be cut
            inside = window[k][1] < high and window[k + 1][1] < high if left else window[k][0] > low and window[k - 1][0] > low
            pair = (k, k + 1) if left else (k - 1, k)
            if inside and window[pair[0]] in places and places.get(window[pair[1]]) == places[window[pair[0]]] + 1:
                return (k, places[window[k]])
        return None

    def tree(self, texts: list[str], pieces: list[list]) -> list:
        """Join neighbouring pieces pair by pair."""
        text, at = "".join(texts), 0
        spans = []
        for t, p in zip(texts, pieces):
            spans.append((at, at + len(t), p))
            at += len(t)
        while len(spans) > 1:
            spans = [
                (a[0], b[1], self.join(text, a[0], a[1], b[1], a[2], b[2])) if b else a
                for a, b in ((spans[k], spans[k + 1] if k + 1 < len(spans) else None) for k in range(0, len(spans), 2))
            ]
        return spans[0][2] if spans else []


def _short(path: str):
    def run(batches):
        encoder = Encoder.at(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for k in range(0, len(ids), 200):
                found = encoder.texts([t or "" for t in texts.slice(k, 200).to_pylist()])
                yield pa.RecordBatch.from_arrays([ids.slice(k, 200), pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.string())], ["doc_id", "ids", "decoded"])

    return run


def _pieces(path: str):
    def run(batches):
        encoder = Encoder.at(path)
        for batch in batches:
            for k in range(0, len(batch), 50):
                part = batch.slice(k, 50)
                found = [encoder.piece(t, 0) for t in part.column("piece").to_pylist()]
                packed = [np.array([(a, b, len(i)) for a, b, i in p], "<i4").tobytes() for p in found]
                ids = [np.array([i for *_, x in p for i in x], "<u4").tobytes() for p in found]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "at", "piece", "times")), pa.array(packed, pa.binary()), pa.array(ids, pa.binary())], ["row", "doc_id", "at", "piece", "times", "spans", "ids"])

    return run


def _joined(path: str):
    def run(batches):
        encoder = Encoder.at(path)
        for batch in batches:
            for doc_id, parts in zip(batch.column("doc_id").to_pylist(), batch.column("parts")):
                parts = sorted(parts.as_py(), key=lambda p: p["at"])
                pieces, begin = [], 0
                for p in parts:
                    spans, ids, k = np.frombuffer(p["spans"], "<i4").reshape(-1, 3), np.frombuffer(p["ids"], "<u4").tolist(), 0
                    own = []
                    for a, b, n in spans.tolist():
                        own.append((a + begin, b + begin, tuple(ids[k : k + n])))
                        k += n
                    begin += len(p["piece"])
                    pieces.append(own)
                ids = [i for *_, x in encoder.tree([p["piece"] for p in parts], pieces) for i in x]
                packed, decoded = pa.array([np.array(ids, "<u4").tobytes()], pa.binary()), pa.array([encoder.decode(ids)], pa.string())
                for _ in range(parts[0]["times"]):
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), packed, decoded], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit words), decoded, n_tokens of every row (doc_id, text) of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = "doc_id long, ids binary, decoded string"
    short = docs.where(F.char_length("text") < long).mapInArrow(_short(path), kind)
    chars = F.char_length("text")
    halves = F.pow(F.lit(2), F.ceil(F.log2(chars / F.lit(piece)))).cast("int")
    cuts = (
        docs.where(chars >= long)
        .withColumn("row", F.xxhash64("doc_id", "text"))
        .withColumn("n", F.ceil(chars / F.greatest(F.lit(1), halves)).cast("int"))
        .withColumn("at", F.explode(F.sequence(F.lit(0), chars - 1, F.col("n"))))
        .select("row", "doc_id", "at", F.substring("text", F.col("at") + 1, F.col("n")).alias("piece"))
    )
    # Repeated rows have the same pieces, each as often as there are rows: joined once, and the result repeated.
    same = cuts.groupBy("row", "doc_id", "at", "piece").agg(F.count("*").alias("times"))
    encoded = same.mapInArrow(_pieces(path), "row long, doc_id long, at int, piece string, times long, spans binary, ids binary")
    joined = encoded.groupBy("row", "doc_id").agg(F.collect_list(F.struct("at", "piece", "times", "spans", "ids")).alias("parts")).mapInArrow(_joined(path), kind)
    return short.union(joined).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
