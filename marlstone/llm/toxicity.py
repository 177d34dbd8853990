"""Toxicity: a support vector machine on a gapped subsequence kernel, through Nystroem landmarks.

The kernel of two words counts their common subsequences of three letters, each occurrence weighed by decay to the
power of the characters it spans (six at most), normalised to 1 for equal words: an insult with characters put in or
left out stays near its plain form. Words are folded first (case, letters written as digits or signs), punctuation
inside a word is dropped, and a run of single letters is read as one word.

Training sees the sentences of labelled documents, a bounded sample of ``sample`` documents of each label. Landmarks are the
words that separate the labels best. Subsequences do not cross words, so a sentence's kernel with a landmark is that of its
nearest word; these values, whitened (Nystroem), are the sentence's features. A document carries its label as a whole, so the
positive instances are each toxic document's most telling sentence under the current model (a few rounds), and the negative
ones are all sentences of clean documents with a word near any landmark. A document scores as its most toxic sentence does; a
logistic curve fitted on the sample turns that into 0 to 1.

Defined cases: null and empty texts have no words and score as clean; very long texts are scored whole, sentence by sentence;
repeated rows score alike; rows without a label or a doc_id are not trained on; labels that differ for one doc_id count as toxic;
with no toxic or no clean label at all, every document scores the share of toxic labels (0 if there are none); an empty table
gives an empty result. Columns beside text are carried along, whatever their names; one called score gives way.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import smallest

DECAY, SPAN = 0.75, 6
#: Documents of each label to train on, at most; landmarks, at most.
SAMPLE, LANDMARKS = 1000, 96
#: A word whose common subsequences weigh less than this share of a landmark's own counts as unlike it.
NEAR = 0.3
#: Letters of a window over a longer run of letters, and the step of the windows.
WIDTH, STEP = 24, 12
_SIGNS = str.maketrans("013457@$!", "oieastasi")
_RUN = re.compile(r"(?<!\S)(?:\w\W{1,2}){2,}\w(?!\w)")
_GAPS = [(g, h) for g in range(1, SPAN - 1) for h in range(1, SPAN - g)]
_LETTERS = 32


#: A sentence ends at a line's end, or at a stop behind a word of two letters or more.
_SENTENCE = re.compile(r"(?<=\w\w[.!?])\s+|\n+")


def sentences(text: str) -> list[str]:
    return _SENTENCE.split(text)


def fold(text: str) -> set[str]:
    """The distinct folded words of a text."""
    text = text.lower()
    found = {w for w in text.split()}
    found.update(re.sub(r"\W", "", r) for r in _RUN.findall(text))
    return found


def plain(word: str) -> list[str]:
    """A word with signs as letters and nothing but letters, in windows if it is long."""
    bare = word.strip(".,;:?\"'()|-")  # none of these stands for a letter
    if bare.isascii() and bare.isalpha() and len(bare) <= WIDTH:  # most words
        return [bare]
    word = "".join(c for c in word.translate(_SIGNS) if c.isalpha())
    return [word] if len(word) <= WIDTH else [word[i : i + WIDTH] for i in range(0, len(word) - STEP, STEP)]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every three-letter subsequence of each word: word, code, weight."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 5)
    length = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), length)
    own, code, weight = [], [], []
    for g, h in _GAPS:
        if len(points) > g + h:
            same = owner[: -(g + h)] == owner[g + h :]
            c = (letter[: -(g + h)] * _LETTERS + letter[g : len(letter) - h]) * _LETTERS + letter[g + h :]
            own.append(owner[: -(g + h)][same])
            code.append(c[same])
            weight.append(np.full(int(same.sum()), DECAY ** (g + h + 1)))
    if not own:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(own), np.concatenate(code), np.concatenate(weight)


def _gathered(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _codes, with the weights of equal codes of a word added."""
    own, code, weight = _codes(words)
    key, inverse = np.unique(own * _LETTERS**3 + code, return_inverse=True)
    return key // _LETTERS**3, key % _LETTERS**3, np.bincount(inverse, weight, len(key))


class Kernel:
    """Kernel of words with fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        own, code, weight = _gathered(landmarks)
        self.norm = np.bincount(own, weight**2, len(landmarks))
        self.row = np.zeros(_LETTERS**3, np.int32)  # 0: in no landmark
        known = np.unique(code)
        self.row[known] = np.arange(1, len(known) + 1)
        self.table = np.zeros((len(known) + 1, len(landmarks)), np.float32)
        self.table[self.row[code], own] = weight

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words near any landmark, and their normalised kernel rows."""
        if not words or not self.landmarks:
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)))
        own, code, weight = _codes(words)
        hit = self.row[code]
        keep = hit > 0
        own, hit, weight = own[keep], hit[keep], weight[keep]
        # Few words share much with any landmark: first a bound from all their hits together.
        reach = np.bincount(own, weight * self.table.max(1)[hit], len(words))
        near = reach >= NEAR * self.norm.min()
        index = np.flatnonzero(near)
        keep = near[own]
        own, hit, weight = np.searchsorted(index, own[keep]), hit[keep], weight[keep]
        sums = np.zeros((len(index), len(self.landmarks)), np.float32)
        order = np.argsort(own, kind="stable")
        own, hit, weight = own[order], hit[order], weight[order]
        for a in range(0, len(index), 4096):
            i, j = np.searchsorted(own, [a, a + 4096])
            if i < j:
                part = self.table[hit[i:j]] * weight[i:j, None].astype(np.float32)
                starts = np.flatnonzero(np.r_[True, own[i + 1 : j] != own[i : j - 1]])
                sums[own[i:j][starts]] = np.add.reduceat(part, starts)
        close = (sums >= NEAR * self.norm).any(1)
        index, sums = index[close], sums[close].astype(float)
        if not len(index):
            return index, sums
        own, _, weight = _gathered([words[k] for k in index])
        norm = np.bincount(own, weight**2, len(index))
        sums = np.where(sums >= NEAR * self.norm, sums, 0) / np.sqrt(np.maximum(norm, 1e-12)[:, None] * self.norm)
        return index, sums


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps on the active set."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        active = y * (x @ w) < 1
        a = x[active]
        new = np.linalg.solve(ridge + a.T @ (a * cost[active, None]) * 2, 2 * a.T @ (y[active] * cost[active]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = 0.5 * (w + new)
    return w[:-1], float(w[-1])


class Model:
    """What a worker needs to score: landmarks, weights per landmark, bias, logistic curve."""

    def __init__(self, landmarks=(), weights=None, bias=-1.0, slope=1.0, shift=0.0, base=None):
        self.kernel, self.weights = Kernel(list(landmarks)), weights
        self.bias, self.slope, self.shift, self.base = bias, slope, shift, base
        self.seen: dict[str, np.ndarray] = {}  # kernel rows of words near a landmark
        self.alone: dict[str, float] = {}  # their margins as sentences of one word
        self.clean: set[str] = set()

    def _learn(self, words: list[str]) -> None:
        parts = [(w, p) for w in words for p in plain(w) if len(p) >= 3]
        index, rows = self.kernel([p for _, p in parts])
        for i, row in zip(index.tolist(), rows):
            word = parts[i][0]
            self.seen[word] = np.maximum(row, self.seen[word]) if word in self.seen else row
        for word in {parts[i][0] for i in index.tolist()}:
            self.alone[word] = float(self.seen[word] @ self.weights + self.bias)
        self.clean.update(w for w in words if w not in self.seen)

    def _sentence(self, near: set[str]) -> float:
        if len(near) == 1:
            return self.alone[next(iter(near))]
        return float(np.max([self.seen[w] for w in near], axis=0) @ self.weights + self.bias)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Margin of each text's most toxic sentence; the bias where no word is near a landmark."""
        if len(self.clean) > 400_000 or len(self.seen) > 50_000:
            self.clean.clear()
            self.seen.clear()
            self.alone.clear()
        bags = [fold(t or "") for t in texts]
        new = list(set().union(*bags) - self.clean - self.seen.keys()) if bags else []
        self._learn(new)
        keys, out = self.seen.keys(), []
        for text, bag in zip(texts, bags):
            near = keys & bag
            best = self.bias
            if len(near) == 1:
                best = max(best, self._sentence(near))
            elif near:
                left = set(near)
                for sentence in sentences((text or "").lower()):
                    if here := near.intersection(sentence.split()):
                        best = max(best, self._sentence(here))
                        left -= here
                best = max([best, *(self.alone[w] for w in left)])  # words spelt letter by letter, which may cross sentences
            out.append(best)
        return np.array(out)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.base is not None:
            return np.full(len(texts), self.base)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -40, 40)))


def fit(texts: list[str], labels: list[int], landmarks: int = LANDMARKS, rounds: int = 4) -> Model:
    """A model from labelled texts."""
    y = np.array(labels) == 1
    if not y.any() or y.all():
        return Model(base=float(y.mean()) if len(y) else 0.0)
    one: dict[str, str] = {}  # each word is one object, however many documents have it
    bags = [{one.setdefault(p, p) for w in fold(t or "") for p in plain(w) if len(p) >= 3} for t in texts]
    count = {True: {}, False: {}}
    for bag, label in zip(bags, y):
        own = count[bool(label)]
        for w in bag:
            own[w] = own.get(w, 0) + 1
    pos, neg = int(y.sum()), int((~y).sum())
    # Stems count as words of their own: inflected insults are rare one by one.
    stems = {w[:k] for w in count[True] if not count[False].get(w) for k in range(4, min(8, len(w)))} - count[True].keys()
    for bag, label in zip(bags, y):
        own = count[bool(label)]
        for stem in {w[:k] for w in bag for k in range(4, min(8, len(w)))} & stems:
            own[stem] = own.get(stem, 0) + 1
    gain = {w: n / pos * np.log(((n + 0.1) / pos) / ((count[False].get(w, 0) + 0.5) / neg)) for w, n in count[True].items() if n >= 2}
    ranked = sorted((w for w in gain if gain[w] > 0), key=lambda w: (-gain[w], w))[: 20 * landmarks]
    chosen: list[str] = []
    for w in ranked:
        if len(chosen) == landmarks:
            break
        index, rows = Kernel(chosen)([w])
        if not len(index) or rows.max() < 0.95:
            chosen.append(w)
    if not chosen:
        return Model(base=float(y.mean()))
    kernel = Kernel(chosen)
    values, vectors = np.linalg.eigh(_square(kernel, chosen))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    words = sorted(set().union(*bags))
    index, rows = kernel(words)
    at = {words[i]: k for k, i in enumerate(index.tolist())}
    gains = np.array([gain.get(words[i], 0.0) for i in index.tolist()])
    known: dict[tuple[int, ...], int] = {}  # sentences by the words in them that are near a landmark
    near = []
    for text, bag in zip(texts, bags):
        own, spoken = at.keys() & bag, set()
        for sentence in sentences((text or "").lower()) if own else ():
            if here := {at[p] for w in fold(sentence) for p in plain(w) if p in own}:
                spoken.add(known.setdefault(tuple(sorted(here)), len(known)))
        near.append(np.array(sorted(spoken), np.int64))
    z = np.array([rows[list(k)].max(0) for k in known]).reshape(len(known), len(chosen)) @ whiten
    value = np.array([gains[list(k)].max() for k in known])
    clean = np.unique(np.concatenate([n for n, label in zip(near, y) if not label] or [np.zeros(0, np.int64)]).astype(np.int64))
    weights, bias = np.zeros(len(chosen)), -1.0
    for _ in range(rounds):
        witness = np.array([n[np.argmax(value[n])] for n, label in zip(near, y) if label and len(n)], np.int64)
        x = np.r_[z[witness], z[clean], np.zeros((1, z.shape[1]))]
        t = np.r_[np.ones(len(witness)), -np.ones(len(clean) + 1)]
        cost = np.r_[np.full(len(witness), 1.0 / max(1, len(witness)) * 500), np.full(len(clean) + 1, 1.0)]
        weights, bias = _svm(x, t, cost)
        value = z @ weights + bias
    margins = np.array([max([bias, *value[n]]) for n in near])
    slope, shift = _logistic(margins, y)
    return Model(chosen, whiten @ weights, bias, slope, shift)


def _square(kernel: Kernel, landmarks: list[str]) -> np.ndarray:
    index, rows = kernel(landmarks)
    full = np.zeros((len(landmarks), len(landmarks)))
    full[index] = rows
    return (full + full.T) / 2


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, with smoothed targets."""
    pos, neg = y.sum(), (~y).sum()
    target = np.where(y, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.c_[margin, np.ones(len(margin))], np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 0)), float(w[1])


def held_out(doc_id) -> F.Column:
    """True where the row's label must not be learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most sample documents of each label (smallest hash first), none held out."""
    labelled = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for label in (0, 1):
        part = smallest(labelled.where(F.col("toxic") == label), F.xxhash64("doc_id"), sample)
        chosen = part if chosen is None else chosen.union(part)
    # The ids of the sample are few and bounded; they prune the scan of the texts.
    ids = {r["doc_id"]: r["toxic"] for r in chosen.collect()}
    known = docs.sparkSession.createDataFrame(list(ids.items()) or [(-1, 0)], "doc_id long, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic").collect() if ids else []
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return fit([r["text"] or "" for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and text's score for every row; columns beside doc_id and text are carried along."""
    shared = docs.sparkSession.sparkContext.broadcast((model.kernel.landmarks, model.weights, model.bias, model.slope, model.shift, model.base))
    rest = [c for c in docs.columns if c != "score"]
    place = rest.index("text")

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.scores(part.column(place).to_pylist()), pa.float64())], [*rest, "score"])

    schema = docs.select(*rest).schema
    return docs.select(*rest).mapInArrow(run, schema.add("score", "double"))
