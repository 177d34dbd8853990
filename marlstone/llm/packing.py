"""Best-fit packing by patterns: documents as pieces of tokens, put into as few sequences of bounded length as can be.

1. Each document is encoded as the public tokenizer's library does and ends with ``end``; one longer than a sequence is cut into
   pieces of exactly that length, the last of which may be shorter. Pieces are written without their ids, each with its
   place among the pieces of its length in its task.
2. The histogram of lengths (at most as many numbers as a sequence has tokens, whatever the corpus) decides the plan: patterns of
   one to three lengths that fill a sequence exactly are enumerated, repeat counts x >= 0 are fitted to the histogram by
   least squares (columns join where the gradient asks for them; coordinate descent), rounded down and held to
   what is there. What is left is packed by best fit, longest first, many equal pieces at once, into new sequences. A few
   shares of the counts are tried, as exact patterns may use up what longer pieces need beside them.
3. A piece's rank among its length follows from counts by task and length; the plan says which sequence and offset that rank has.
   Rows are not sorted, and no task or group holds all pieces of a length.

Defined cases: null and empty texts have ``end`` alone; a null doc_id stays null; repeated rows are packed each; very long texts are
encoded whole and cut; equal lengths are told apart by their place in the written table alone; an empty table gives an empty
result; columns beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import cut

SIZE, END = 2048, 0
#: Words a worker remembers, in each of two generations (a matter of speed alone).
REMEMBER = 400_000
#: New words that are encoded as one text.
EACH = 100
#: Rounds in which columns join the fit, and sweeps of coordinate descent in each.
ROUNDS, SWEEPS = 12, 12
#: Fits at most, each to what rounding left of the one before.
FITS = 4
#: Shares of the fitted counts that are tried, in percent.
SHARES = (100, 90, 75, 50)


#: How a tokenizer's file says that it lower-cases, and that runs of letters and runs of signs are pre-tokens of their own.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Ids:
    """Ids of whole texts, word by word, as in ``bpe``: columns are split and their distinct words found by Arrow."""

    def __init__(self, path: str):
        self.tokenizer = Encoder.at(path).tokenizer
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        made = json.loads(self.tokenizer.to_str())
        self.plain = made["normalizer"] == NORMALIZER and made["pre_tokenizer"] == PRE_TOKENIZER
        self.signs = {c: self._encoded(c) for c in ".,;:!?"} if self.plain else {}

    def _encoded(self, word: str) -> bytes:
        """Ids of a word of ASCII letters, or a sign, straight from the model: it is one pre-token that nothing changes."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode new words, a few to a text (its cost grows faster than its length), and tell their ids apart by their places."""
        young = self.young
        if self.plain and sys.byteorder == "little":
            rest = []
            for word in words:
                if word.isascii() and word.isalpha():
                    young[word] = self._encoded(word)
                elif (tail := self.signs.get(word[-1:])) is not None and (base := word[:-1]).isascii() and base.isalpha():
                    young[word] = (young.get(base) or self._encoded(base)) + tail
                else:
                    rest.append(word)
            words = rest
        for k in range(0, len(words), 100 * EACH):
            parts = [words[i : i + EACH] for i in range(k, min(k + 100 * EACH, len(words)), EACH)]
            for part, found in zip(parts, self.tokenizer.encode_batch([" ".join(p) for p in parts], add_special_tokens=False)):
                starts = np.fromiter((x for x, _ in found.offsets), np.int64, len(found.offsets))
                at = np.searchsorted(starts, np.cumsum([0, *(len(w) + 1 for w in part)])).tolist()
                packed = np.array(found.ids, "<u4").tobytes()
                for word, i, j in zip(part, at, at[1:]):
                    young[word] = packed[4 * i : 4 * j]

    def _known(self, words: list[str]) -> list[bytes]:
        if len(self.young) > REMEMBER:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        young[""] = b""
        found = list(map(young.get, words))
        new = []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            if (ids := old.get(words[k])) is None:
                new.append(k)
            else:
                found[k] = young[words[k]] = ids
        self._learn([words[k] for k in new])
        for k in new:
            found[k] = young[words[k]] if len(words[k]) <= 200 else young.pop(words[k])
        return found

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and how many each text has. ASCII capitals are the same to this tokenizer as small letters;
        texts with its special tokens, or with white space that is none for it, are encoded whole."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]|<[|]")
        words = pc.utf8_split_whitespace(pc.ascii_lower(pc.if_else(odd, "", texts)))
        flat = words.flatten().dictionary_encode()
        found = self._known(flat.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        lists = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(size)], pa.array(np.frombuffer(b"".join(found), "<u4")))
        ids = lists.take(flat.indices).flatten().to_numpy()
        bounds = words.offsets.to_numpy()
        ends = np.r_[0, np.cumsum(size[flat.indices.to_numpy()])][bounds - bounds[0]]
        count = np.diff(ends)
        if pc.any(odd).as_py():
            own = np.split(ids, ends[1:-1])
            for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                own[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, count = np.concatenate(own), np.array([len(x) for x in own], np.int64)
        return ids, count


def _pieces(path: str, size: int, end: int):
    """Pieces of documents: doc_id, piece, start, length, checksum, task, and place among those of one length in the task."""

    def run(batches):
        encoder, task, seen = Ids(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            ids, count = encoder.texts(batch.column(1))
            ids = np.insert(ids, np.cumsum(count), end).astype("<u4")  # each document ends with end
            total = count + 1
            base = np.cumsum(total) - total
            pieces = -(-total // size)
            doc = np.repeat(np.arange(len(total)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * size
            length = np.minimum(size, total[doc] - start)
            at, raw = 4 * (base[doc] + start), memoryview(ids.tobytes())
            crc = np.array([zlib.crc32(raw[a : a + n]) for a, n in zip(at.tolist(), (4 * length).tolist())], np.int64)
            order = np.argsort(length, kind="stable")
            by = length[order]
            place = np.empty(len(by), np.int64)
            place[order] = np.arange(len(by)) - np.searchsorted(by, by) + seen[by]
            seen += np.bincount(length, minlength=size + 1)
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(doc), task, np.int32)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

    return run


def patterns(present: np.ndarray, size: int) -> np.ndarray:
    """All multisets of at most three of these lengths that sum to size, as rows (a >= b >= c), zeros where there are fewer."""
    there = np.zeros(size + 1, bool)
    there[present] = True
    there[0] = True  # no document
    found = []
    for a in present[::-1]:
        b = np.arange(min(a, size - a), -1, -1)
        c = size - a - b
        keep = (c <= b) & there[b] & there[np.clip(c, 0, size)]
        found.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def fit(histogram: np.ndarray, columns: np.ndarray) -> dict[int, float]:
    """Repeat counts x >= 0 of columns (numbers of patterns) for which the lengths used come near the histogram in the sense of
    least squares. In each round the column of steepest descent joins for each longest length, and coordinates descend."""
    left = histogram.astype(float).tolist()
    x: dict[int, float] = {}
    work: dict[int, tuple[list[tuple[int, int]], int]] = {}
    for _ in range(ROUNDS if len(columns) else 0):
        r = np.array(left)
        r[0] = 0.0
        gain = r[columns].sum(1)
        order = np.lexsort((-gain, columns[:, 0]))
        best = order[np.r_[True, np.diff(columns[order, 0]) != 0]]
        joined = [int(k) for k in best[gain[best] > 0.5] if int(k) not in x]
        for k in joined:
            lengths = [int(v) for v in columns[k] if v]
            parts = [(v, lengths.count(v)) for v in dict.fromkeys(lengths)]
            x[k], work[k] = 0.0, (parts, sum(m * m for _, m in parts))
        for _ in range(SWEEPS):
            moved = 0.0
            for k, (parts, norm) in work.items():
                now = x[k]
                to = max(0.0, now + sum(m * left[v] for v, m in parts) / norm)
                if to != now:
                    x[k] = to
                    moved += abs(to - now)
                    for v, m in parts:
                        left[v] -= m * (to - now)
            if moved < 0.5:
                break
        if not joined:
            break
    return x


def _patterned(left: np.ndarray, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fillings by fitted patterns, as many as left has; what they use goes from left. Each fit is to what rounding left of the one before."""
    out: list[tuple[int, list[tuple[int, int]]]] = []
    for _ in range(FITS):
        columns = patterns(np.flatnonzero(left > 0), size)
        counts, before = fit(np.array(left, float), columns), len(out)
        for k in sorted(counts, key=lambda k: (-columns[k, 0], -columns[k, 1])):
            lengths = [int(v) for v in columns[k] if v]
            parts = [(v, lengths.count(v)) for v in dict.fromkeys(lengths)]
            times = min(int(counts[k]), *(left[v] // m for v, m in parts))
            if times > 0:
                out.append((int(times), parts))
                for v, m in parts:
                    left[v] -= times * m
        if len(out) == before:
            break
    return out


def _best_fit(left: np.ndarray, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Longest first, each into the sequence with least room that holds it: groups of sequences filled alike, by the room they have left."""
    room: dict[int, list[tuple[tuple, int]]] = {}
    spaces: list[int] = []

    def put(space: int, filling: tuple, times: int) -> None:
        if times:
            if space not in room:
                room[space] = []
                insort(spaces, space)
            room[space].append((filling, times))

    for length in range(size, 0, -1):
        count = int(left[length])
        while count:
            at = bisect_left(spaces, length)
            space = spaces[at] if at < len(spaces) else size
            each = space // length
            filling, times = room[space].pop() if at < len(spaces) else ((), -(-count // each))
            if at < len(spaces) and not room[space]:
                del room[space], spaces[at]
            full = min(times, count // each)
            put(space - each * length, (*filling, (length, each)), full)
            count -= full * each
            times -= full
            if times and count:
                put(space - count * length, (*filling, (length, count)), 1)
                count, times = 0, times - 1
            put(space, filling, times)
    return [(times, list(filling)) for groups in room.values() for filling, times in groups]


def plan(histogram: np.ndarray, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, pieces of it in each)]): how often each filling is used. histogram[n] pieces of length n.

    Patterns take short pieces that the rest may need beside long ones: of a few shares of the fitted counts, that with the fewest
    sequences in all is used."""
    left = histogram.astype(object).copy()
    whole = [(int(left[size]), [(size, 1)])] if left[size] else []
    left[size] = 0
    fitted, best = _patterned(left.copy(), size), None
    for share in SHARES:
        used = [(times * share // 100, parts) for times, parts in fitted]
        used = [x for x in used if x[0]]
        rest = left.copy()
        for times, parts in used:
            for v, m in parts:
                rest[v] -= times * m
        made = used + _best_fit(rest, size)
        if best is None or sum(t for t, _ in made) < sum(t for t, _ in best):
            best = made
    return whole + best


def _slots(plan_: list[tuple[int, list[tuple[int, int]]]], size: int) -> dict[str, np.ndarray]:
    """For each length and each run of ranks: where it begins, its first sequence, pieces in each sequence, first offset."""
    used, rows, base = [0] * (size + 1), [], 0
    for times, parts in plan_:
        offset = 0
        for length, each in parts:
            rows.append((length, used[length], base, each, offset))
            used[length] += times * each
            offset += length * each
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"first": np.searchsorted(table[:, 0], np.arange(size + 2)), "table": table}


def _placed(slots: dict[str, np.ndarray]):
    first, table = slots["first"], slots["table"]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            slot = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                slot[own] = first[n] + np.searchsorted(table[first[n] : first[n + 1], 1], rank[own], "right") - 1
            k = rank - table[slot, 1]
            each = table[slot, 3]
            columns = [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(table[slot, 2] + k // each), pa.array(table[slot, 4] + k % each * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row (doc_id, text) of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = cut(docs.mapInArrow(_pieces(path, size, end), f"{kind}, task int, place long"), "pieces")
    counts = cut(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row for each length at most
        histogram[r["length"]] = r["n"]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    ranked = pieces.join(counts.select("task", "length", before.alias("before")).hint("merge"), ["task", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(_placed(_slots(plan(histogram, size), size)), f"{kind}, sequence_id long, offset long")
