"""Hard negatives of anchor rows, by Fagin's threshold algorithm over blocks of candidates.

Scores are integer inner products of quantised vectors. Anchors meet all rows in blocks: a task has
a block of candidates and one of anchors, sorts its candidates once along each dimension, and for
each anchor reads the lists from the end that its component's sign favours. Every row met is scored
in full. The sum of the components' products at the present depth bounds all rows not met yet; the
search of a window ends once this threshold lies strictly below its kth score, or below the window.
Blocks give their best k a window, and the best of these are the result, so nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

#: Rows of a block of candidates, and of one of anchors; places of each list read at first, twice as many each time after.
CANDIDATES, ANCHORS, DEPTH = 8192, 1024, 32
#: A component larger than this after quantisation counts as this, so that scores of 500 dimensions stay in 64 bits.
LARGEST = 1 << 27


def quantised(rows: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """id, label, v (whole numbers floor(scale * x)) of the rows that take part.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part.
    Vectors of fewer components count as zero in the rest. Of rows that share an id the smallest
    (label, vector) stands for it.
    """
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.least(F.greatest(F.floor(c * F.lit(float(scale))), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    taking = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(sound)
    taking = taking.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), v.alias("v")).where("label is not null")
    return taking.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


@dataclass
class Lists:
    """A block of candidates (ids ascending) with its list of each dimension."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray  # float32 or float64 where sums are exact in it, else int64
    order: np.ndarray  # [dimension, place]: rows by falling component

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Lists:
        at = np.argsort(ids, kind="stable")
        vectors = vectors[at]
        most = float(np.abs(vectors).max(initial=1)) ** 2 * vectors.shape[1]
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        return cls(ids[at], labels[at], vectors.astype(kind), np.argsort(-vectors, axis=0, kind="stable").T.astype(np.int32))


@dataclass(frozen=True)
class Want:
    """A window of an anchor: the first k rows that `fits` admits with a score of low to high."""

    low: int | None
    high: int | None
    k: int


def search(lists: Lists, anchor: np.ndarray, fits: np.ndarray, windows: list[Want], depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows of the block, scores) of each window, best first, ties by place (the smaller id)."""
    n = len(lists.ids)
    dims = np.flatnonzero(anchor)
    q = anchor.astype(lists.vectors.dtype)
    met = np.zeros(n, bool)
    rows, scores, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    falling = q[dims] > 0
    while True:
        # the next places of each list, from its end where the anchor's component is negative
        places = np.arange(at, min(at + depth, n))
        at, depth = at + len(places), 2 * depth
        fresh = np.zeros(n, bool)
        if len(dims):
            fresh[lists.order[dims[:, None], np.where(falling[:, None], places, n - 1 - places)]] = True
            fresh &= ~met
        else:  # an anchor of zeros scores zero with all
            fresh[:], at = True, n
        met |= fresh
        fit = np.flatnonzero(fresh & fits)
        rows = np.concatenate((rows, fit))
        scores = np.concatenate((scores, (lists.vectors[fit] @ q).astype(np.int64)))
        if at >= n or met.all():
            break
        edge = lists.order[dims, np.where(falling, at - 1, n - at)]
        threshold = int((lists.vectors[edge, dims] * q[dims]).sum())
        if all(_over(scores, w, threshold) for w in windows):
            break
    found = []
    for w in windows:
        inside = np.flatnonzero(_inside(scores, w))
        if len(inside) > w.k:  # only what reaches the kth score is sorted
            inside = inside[scores[inside] >= _kth(scores[inside], w.k)]
        best = inside[np.lexsort((rows[inside], -scores[inside]))][: w.k]
        found.append((rows[best], scores[best]))
    return found


def _inside(scores: np.ndarray, w: Want) -> np.ndarray:
    """By the integers 100 * score, as bounds are not whole scores."""
    inside = np.ones(len(scores), bool)
    if w.low is not None:
        inside &= 100 * scores >= w.low
    if w.high is not None:
        inside &= 100 * scores <= w.high
    return inside


def _over(scores: np.ndarray, w: Want, threshold: int) -> bool:
    """Whether no row that is still unmet can be among the first k of the window."""
    if w.low is not None and (100 * threshold < w.low or w.high < w.low):
        return True
    inside = scores[_inside(scores, w)]
    return len(inside) >= w.k and threshold < _kth(inside, w.k)


def _kth(scores: np.ndarray, k: int) -> int:
    """The kth largest of at least k scores."""
    return np.partition(scores, len(scores) - k)[len(scores) - k]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as one matrix of `width` columns, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


Windows = Callable[[dict], list[Want]]
FOUND = "id long, window int, other long, score long"


def _blocks(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to every pair of a block of candidates (a) and one of anchors (b), by a hash of the id."""
    a, b = max(1, -(-n_rows // CANDIDATES)), max(1, -(-n_anchors // ANCHORS))
    at = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return rows.withColumns({"a": at(a), "b": every(b)}), anchors.withColumns({"b": at(b), "a": every(a)})


def _searched(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], width: int, same: bool, windows: Windows) -> DataFrame:
    """For each anchor and window: id (the anchor's), window (its number), other, score of each block's best."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            lists = Lists.of(left["id"].to_numpy(), left["label"].to_numpy(), _matrix(left["v"], width))
            queries = _matrix(right["v"], width)
            for k, r in enumerate(right.drop_columns(["v"]).to_pylist()):
                fits = (lists.labels == r["label"]) == same
                if same:
                    fits &= lists.ids != r["id"]
                for number, (at, scores) in enumerate(search(lists, queries[k], fits, windows(r))):
                    found += [(r["id"], number, int(lists.ids[i]), int(s)) for i, s in zip(at, scores, strict=True)]
        columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["id", "window", "other", "score"])

    a, b = _blocks(rows, anchors, *sizes)
    return a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInArrow(work, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each window over all blocks, with their rank."""
    order = Window.partitionBy("id", "window").orderBy(F.col("score").desc(), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: as quantised() gives them. anchors: which ids are anchors. An anchor's positives are its
    first `positives` other rows of the same label; for each, the first `negatives` rows of
    another label with low * positive_score <= 100 * negative_score <= high * positive_score, by
    falling score, ties to the smaller id. A window without rows has none; an empty table, or one
    without anchors, gives an empty result. Memory of a task is bounded by two blocks.
    """
    rows = cut(rows)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    asked = cut(rows.where(anchors))
    sizes = (n, asked.count())
    best = _searched(rows, asked, sizes, width, True, lambda r: [Want(None, None, positives)])
    best = cut(_first(best, positives).select("id", F.struct("rank", "other", "score").alias("p")))
    given = best.groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    # the nth window of an anchor is that of its nth positive
    windows = lambda r: [Want(low * p["score"], high * p["score"], negatives) for p in r["p"]]
    met = _searched(rows, asked.join(given, "id"), sizes, width, False, windows)
    p = best.select("id", (F.col("p.rank") - 1).alias("window"), F.col("p.other").alias("positive_id"), F.col("p.score").alias("positive_score"))
    found = _first(met, negatives).join(p, ["id", "window"])
    return found.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_embeddings(embeddings: DataFrame, every: int = 100, moved: int = 7, labels: int = 10) -> DataFrame:
    """mine() with every hundredth vector as an anchor; where vec_id is divisible by `moved` the label is moved on by one of `labels` first, which makes known wrong labels."""
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("long")
    return mine(quantised(embeddings, label), F.col("id") % every == 0)
