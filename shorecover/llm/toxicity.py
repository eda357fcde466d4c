"""Toxicity: a subsequence-kernel SVM over the words of a text.

The kernel counts common subsequences of `ORDER` letters, gaps allowed, each weighted by
DECAY to the power of the length it spans, over a word with a mark at either end; it is
normalised. So an insult with letters put in or drawn out stays near its plain form. Landmarks
give Nystroem features, a squared-hinge SVM separates them, and as it is linear in the kernel,
its decision folds into one weight for each letter triple. A text's score is the calibrated
decision of its worst word; runs of single letters ("s c u m") count as a word too.

Labels belong to texts, so words are labelled in rounds (MI-SVM): words that toxic training
texts hold far more often than clean ones, and that explain most of them, start as positive;
words of clean texts are negative, those nearest to the margin before others; then telling
words that the model takes for positive join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import runs

ORDER, DECAY = 3, 0.6
#: The score at the decision that parts the classes best.
THRESHOLD = 0.7
#: Longer words are judged in overlapping pieces of this many letters.
PIECE = 20
#: Bounds of the labelled sample that fits the model, by smallest hash of the id.
MAX_TOXIC, MAX_CLEAN = 1000, 2500
_SINGLES = re.compile(r"(?<!\S)\w(?:[\s.*_-]+\w(?!\w)){2,}")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_CODES = 48
#: Signs read as letters.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def units(text: str) -> set[str]:
    """The distinct words of a text in lower case without outer punctuation, and joined runs of single letters."""
    text = text.lower()
    found = {_EDGE.sub("", w) if not w.isalpha() else w for w in set(text.split())}
    found |= {"".join(filter(str.isalnum, w)) for w in found if not w.isalpha()}
    found |= {"".join(filter(str.isalnum, m[0])) for m in _SINGLES.finditer(text)}
    found.discard("")
    return {p for w in found for p in _pieces(w)}


def _pieces(word: str) -> list[str]:
    if len(word) <= PIECE:
        return [word]
    return [word[k : k + PIECE] for k in range(0, len(word) - PIECE // 2, PIECE // 2)]


@lru_cache(200_000)
def _code(c: str) -> int:
    """1 to 26: a to z, and digits and signs that stand for them; others by their number; 0 and 47 are the marks at the ends."""
    c = LOOKALIKE.get(c, c)
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 20


@lru_cache(64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(list(combinations(range(n), ORDER)), np.int64)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


def _coded(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, codes) of the words of each length; words shorter than a triple with its marks have none."""
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(len(w), []).append(k)
    for n, index in by.items():
        codes = np.zeros((len(index), n + 2), np.int64)
        codes[:, 1:-1] = [[_code(c) for c in words[k]] for k in index]
        codes[:, -1] = _CODES - 1
        yield np.array(index), codes


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the triples, their normalised weights) of words of one length; equal triples of a word stay apart, the norm joins them."""
    at, weight = _triples(codes.shape[1])
    u = (codes[:, at[:, 0]] * _CODES + codes[:, at[:, 1]]) * _CODES + codes[:, at[:, 2]]
    order = np.argsort(u, axis=1, kind="stable")
    sorted_u, sums = np.take_along_axis(u, order, 1), np.cumsum(weight[order], axis=1)
    last = np.ones(u.shape, bool)
    last[:, :-1] = sorted_u[:, 1:] != sorted_u[:, :-1]
    ends = np.where(last, sums, 0.0)
    before = np.maximum.accumulate(np.concatenate((np.zeros((len(u), 1)), ends[:, :-1]), 1), axis=1)
    norm = np.sqrt((np.where(last, sums - before, 0.0) ** 2).sum(1))
    return u, weight / norm[:, None]


def _landmarks(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the triples that the words hold, ascending; the words' normalised features over these)."""
    parts = [(index, *_features(codes)) for index, codes in _coded(words)]
    triples = np.unique(np.concatenate([u.ravel() for _, u, _ in parts]))
    return triples, _over(triples, words)


def _over(triples: np.ndarray, words: list[str]) -> np.ndarray:
    """The words' normalised features over the given triples alone."""
    out = np.zeros((len(words), len(triples)))
    for index, codes in _coded(words):
        u, v = _features(codes)
        at = np.minimum(np.searchsorted(triples, u), len(triples) - 1)
        hit = triples[at] == u
        np.add.at(out, (np.broadcast_to(index[:, None], u.shape)[hit], at[hit]), v[hit])
    return out


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """The normalised subsequence kernel of each word of a with each of b."""
    triples, z = _landmarks(b)
    return _over(triples, a) @ z.T


@dataclass
class Model:
    """weights: of each letter triple; bias: of the decision; slope, shift: of the calibration of a text's worst word."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def decisions(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for index, codes in _coded(words):
            step = max(1, 100_000 // max(1, len(_triples(codes.shape[1])[0])))
            for k in range(0, len(index), step):
                if codes.shape[1] >= ORDER:
                    u, v = _features(codes[k : k + step])
                    out[index[k : k + step]] += (self.weights[u] * v).sum(1)
        return out

    def scores(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, cost: float) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge SVM with balanced classes, by Newton steps."""
    x = np.hstack((x, np.ones((len(x), 1))))
    c = np.where(y > 0, cost / max(1, (y > 0).sum()), cost / max(1, (y < 0).sum())) * len(y) / 2
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        inside = y * (x @ w) < 1
        xs, cs = x[inside], c[inside]
        new = np.linalg.solve(ridge + 2 * (xs * cs[:, None]).T @ xs, 2 * xs.T @ (cs * y[inside]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _inserted(words: list[str], rng: np.random.Generator, copies: int = 2) -> list[str]:
    """Copies of the longer words with a letter put in or drawn out."""
    out = []
    for w in words:
        for k in range(copies if len(w) > 3 else 0):
            at = int(rng.integers(1, len(w)))
            out.append(w[:at] + (w[at - 1] if k % 2 else chr(97 + int(rng.integers(26)))) + w[at:])
    return out


def _fit_words(positive: list[str], negative: list[str], landmarks: int, rng: np.random.Generator) -> Model:
    positive = positive + _inserted(positive, rng)
    own = positive if len(positive) <= landmarks else [positive[k] for k in rng.choice(len(positive), landmarks, False)]
    marks = own + negative[:landmarks]
    triples, z = _landmarks(marks)
    value, vector = np.linalg.eigh(z @ z.T)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    turn, every = z.T @ root, positive + negative
    del z
    features = np.vstack([_over(triples, every[k : k + 200]) @ turn for k in range(0, len(every), 200)])
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    w = _svm(features, y, 10.0)
    weights = np.zeros(_CODES**ORDER, np.float32)
    weights[triples] = turn @ w[:-1]
    return Model(weights, float(w[-1]), 1.0, 0.0)


def _cover(texts: list[set[str]], times: int = 3) -> list[str]:
    """Few words that explain the texts: again and again the one in most texts that are explained fewer than `times` times, down to three texts."""
    found, left = [], [(words, 0) for words in texts]
    while left:
        count = Counter(w for words, _ in left for w in words)
        w, n = max(count.items(), key=lambda x: (x[1], x[0]), default=("", 0))
        if n < max(3, 0.004 * len(texts)):
            break
        found.append(w)
        left = [(words - {w}, k + (w in words)) for words, k in left]
        left = [(words, k) for words, k in left if words and k < times]
    return found


def _constant(n_toxic: int, n: int) -> Model:
    share = (n_toxic + 1) / (n + 2)
    return Model(np.zeros(_CODES**ORDER, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))


def fit(texts: list[tuple[str, int]], landmarks: int = 192, negatives: int = 2500, rounds: int = 3, seed: int = 7) -> Model:
    """texts: (text, label 0 or 1), a bounded sample. With one class alone, every score is that class's share."""
    # a word of many texts is held once; each text has the numbers of its words
    index: dict[str, int] = {}
    each = [np.fromiter((index.setdefault(w, len(index)) for w in units(t)), np.int32) for t, _ in texts]
    names, y = list(index), np.array([y for _, y in texts], float)
    n_toxic = int(y.sum())
    if not n_toxic or n_toxic == len(each):
        return _constant(n_toxic, len(each))
    held = np.arange(len(each)) % 5 == 0
    toxic, clean = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for k in np.flatnonzero(~held):
        (toxic if y[k] else clean)[each[k]] += 1
    n1, n0 = max(1, int((~held & (y > 0)).sum())), max(1, int((~held & (y == 0)).sum()))
    odds = {k: np.log((toxic[k] + 0.1) / n1) - np.log((clean[k] + 0.1) / n0) for k in np.flatnonzero(toxic >= 3).tolist() if len(names[k]) > 1}
    telling = {k for k, x in odds.items() if x > 3}
    positive = _cover([{names[k] for k in telling.intersection(each[i].tolist())} for i in np.flatnonzero(~held & (y > 0))])
    if not positive:
        positive = [names[k] for k in sorted(np.flatnonzero(toxic).tolist(), key=lambda k: (-odds.get(k, 0) * toxic[k], names[k]))[:20]]
    rng = np.random.default_rng(seed)
    pool = sorted({names[k] for k in np.flatnonzero(clean)} - set(positive))
    if not positive or not pool:
        return _constant(n_toxic, len(each))
    negative = [pool[k] for k in rng.permutation(len(pool))[:negatives]]
    for _ in range(rounds):
        model = _fit_words(positive, negative, landmarks, rng)
        part = [pool[k] for k in rng.permutation(len(pool))[: 25 * negatives]]
        hard = model.decisions(part)
        negative = list(dict.fromkeys(negative[: negatives // 2] + [part[k] for k in np.argsort(-hard)[: negatives // 2]]))
        rest = sorted({names[k] for k in telling} - set(positive))
        positive += [w for w, x in zip(rest, model.decisions(rest), strict=True) if x > 0.5]
    model = _fit_words(positive, negative, landmarks, rng)
    every = np.concatenate([model.decisions(names[k : k + 10_000]) for k in range(0, len(names), 10_000)])
    worst = np.array([every[words].max() if len(words) else model.bias for words in each])
    if len(set(y[held])) < 2:
        held[:] = True
    model.slope, model.shift = _calibrated(worst[held], y[held])
    return model


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve: THRESHOLD where F1 is highest (amid the gap there), nearly 1 at the median of the toxic texts beyond."""
    order = np.argsort(-x)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(x) + 1) + y.sum())
    k = int(f1.argmax())
    top = x[order][k]
    low = x[order][k + 1] if k + 1 < len(x) else top - 1
    cut = (top + low) / 2
    beyond = x[(y > 0) & (x >= top)]
    slope = 5 / max(1e-3, float(np.median(beyond)) - cut) if len(beyond) else 5.0
    return slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut)


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the labelled rows of docs: at most max_toxic and max_clean of them, by the smallest hashes of the id.

    labels: id_col, label_col (0 or 1); other labels and null ids are left out; of several labels of an id the largest
    counts, of several texts the smallest. Null texts teach nothing, repeated rows count once, very long texts are
    read whole; other columns are ignored, whatever their names. An empty table of either kind gives a model that
    finds nothing toxic.
    """
    labels = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    ranked = labels.select("id", "y", F.xxhash64("id").alias("h"))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).distinct()
    ranked = ranked.join(ids, "id", "left_semi")
    chosen = [ranked.where(F.col("y") == y).orderBy("h", "id").limit(n).collect() for y, n in ((1, max_toxic), (0, max_clean))]
    label = {r["id"]: r["y"] for rows in chosen for r in rows}
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    # one text for each id before the driver sees any: an id may have any number of rows
    rows = texts.where(F.col("id").isin(list(label))).groupBy("id").agg(F.min("t").alias("t")).collect() if label else []
    seen = {r["id"]: r["t"] for r in rows}
    return fit([(seen[i], label[i]) for i in sorted(seen)])


class _Judge:
    """Scores texts in a task; each distinct word is judged once (at most 600,000 are remembered)."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def scores(self, texts: list[str]) -> np.ndarray:
        each = [units(t) for t in texts]
        if len(self.known) > 600_000:
            self.known.clear()
        new = list({w for words in each for w in words if w not in self.known})
        self.known.update(zip(new, self.model.decisions(new).tolist(), strict=True))
        worst = [max(map(self.known.__getitem__, words), default=self.model.bias) for words in each]
        return self.model.scores(np.array(worst))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, score (0 to 1), a row for each row of docs, repeated ones and null ids included.

    A null text counts as empty; an empty text has the score of a text without any telling word.
    Texts are read whole, a run of about 1 MB at a time; equal texts have equal scores. Other
    columns are ignored, whatever their names; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(sent.value)
        for batch in batches:
            for row, texts in runs(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array(judge.scores(texts.to_pylist()))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores below the threshold; a null text counts as empty.

    All columns stay, whatever their names; repeated rows share one fate, an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(sent.value)
        for batch in batches:
            for row, texts in runs(batch.column(at).cast(pa.string())):
                yield batch.slice(row, len(texts)).filter(pa.array(judge.scores(texts.to_pylist()) < threshold))

    return docs.mapInArrow(work, docs.schema)
