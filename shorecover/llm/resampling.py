"""Importance resampling towards a target distribution, with an exact cut at a share of the documents.

Words are runs of [0-9a-z] and of characters beyond ASCII after A-Z are lowered; features are runs
of 1 to 3 words joined by one space, hashed into buckets by CRC-32. A bucket's gain is the floored
logarithm of how much likelier the target has it; a document's weight is the sum over its features,
and its score adds a Gumbel number drawn from its id, so that the highest scores are a sample
without replacement in proportion to exp(weight). The cut is found by weighted medians of the
medians of partitions; the drawn rows alone are sorted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .tables import cut

BUCKETS, LONGEST = 10_000, 3
WORD, BREAK = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Keys of a partition when the remaining ones are written anew.
KEYS = 1_000_000
#: A null id stands behind all others.
NO_ID = (1 << 63) - 1


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text cut between words, so that a very long one is not split into words at once."""
    at = 0
    while len(text) - at > PIECE and (end := BREAK.search(text, at + PIECE)):
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def buckets(text: bytes, n_buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) of each piece of a UTF-8 text."""
    before: list[bytes] = []
    for piece in _pieces(text):
        words = WORD.findall(piece.lower())
        if not words:
            continue
        known, every = len(before), before + words
        spaced = [b" " + w for w in every]
        # the CRC of a run goes on from that of the run without its last word
        crc = list(map(crc32, every))
        found = crc[known:]
        for k in range(1, longest):
            crc = list(map(crc32, spaced[k:], crc))
            found += crc[max(0, known - k) :]
        before = every[-(longest - 1) :] if longest > 1 else []
        yield len(words), np.array(found, np.uint32) % n_buckets


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[bytes]:
    for batch in batches:
        for text in batch.column(column).cast(pa.large_binary()):
            yield text.as_py() or b""


def feature_counts(docs: DataFrame, text_col: str = "text", n_buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, n: how often the features of all texts fall in each bucket; buckets without any are absent.

    A null text has no features. A task sends at most one row a bucket.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_buckets, np.int64)
        for text in _texts(batches, 0):
            for _, found in buckets(text, n_buckets, longest):
                n += np.bincount(found, minlength=n_buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + n_buckets) / ((s + 1)(T + n_buckets)))) for each bucket, from the counts of both sides: 80 KB."""
    s, t = np.zeros(n_buckets), np.zeros(n_buckets)
    for n, counts in ((s, raw), (t, target)):
        for r in counts.collect():  # a row a bucket
            n[r["bucket"]] = r["n"]
    high, low = s.sum() + n_buckets, t.sum() + n_buckets
    return np.array([math.floor(1000 * math.log((t[k] + 1) * high / ((s[k] + 1) * low))) for k in range(n_buckets)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row; a text without words has 0 of each."""
    size = len(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in _texts(iter([batch]), 1):
                n_words = n_features = weight = 0
                for words, found in buckets(text, size, longest):
                    n_words, n_features, weight = n_words + words, n_features + len(found), weight + int(gain[found].sum())
                rows.append((n_words, n_features, weight))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, id_col: str = "doc_id") -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))) with h the first 8 hex digits of SHA-256 of "seed:id"; a null id counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


@dataclass(frozen=True, order=True)
class Key:
    """A place in the order of the draw: higher scores first, then smaller ids."""

    rank: int  # the score with its sign turned
    id: int

    def compare(self, op: str) -> Column:
        """Keys that stand before this one (<), or up to it (<=)."""
        score, here = F.col("score"), F.lit(-self.rank)
        id_ = F.coalesce("doc_id", F.lit(NO_ID))
        return (score > here) | ((score == here) & (id_ < self.id if op == "<" else id_ <= self.id))


def _medians(keys: DataFrame, nth: int | None = None) -> list[tuple[Key, int]]:
    """(a key, number of keys) of each partition: its median, or its nth key from 0. One row a partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(-b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if parts:
            rank, id_ = (np.concatenate(c) for c in zip(*parts, strict=True))
            k = (len(rank) - 1) // 2 if nth is None else nth
            least = np.partition(rank, k)[k]
            same = np.sort(id_[rank == least])
            found = same[k - np.count_nonzero(rank < least)]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (least, found, len(rank))], ["rank", "id", "n"])

    found = keys.select("score", F.coalesce("doc_id", F.lit(NO_ID)).alias("id")).mapInArrow(work, "rank long, id long, n long")
    return [(Key(r["rank"], r["id"]), r["n"]) for r in found.collect()]


def cutoff(keys: DataFrame, k: int, per_partition: int = KEYS) -> Key:
    """The kth key (from 1) of (score, doc_id) in the order of the draw; there must be k of them.

    Each round takes the median of each partition's remaining keys and the median of these,
    weighted by how many keys remain: at least a quarter of all remaining keys stand on either
    side of it, and the side without the kth goes. When three quarters are gone the rest is
    written anew, a million keys a partition, so all rounds together read a small multiple of the
    first; one partition left gives its own kth key. The driver sees a row a partition.
    """
    left, want, held = keys.select("score", "doc_id"), k - 1, None
    while True:
        medians = sorted(_medians(left))
        n = sum(m for _, m in medians)
        if len(medians) == 1:
            return _medians(left.coalesce(1), want)[0][0]
        upto = np.cumsum([m for _, m in medians])
        pivot = medians[int(np.searchsorted(upto, (n + 1) // 2))][0]
        before, to = left.agg(F.count_if(pivot.compare("<")), F.count_if(pivot.compare("<="))).first()
        if before <= want < to:
            return pivot
        if want < before:
            left, n = left.where(pivot.compare("<")), before
        else:
            left, n, want = left.where(~pivot.compare("<=")), n - to, want - to
        held = held or n
        if n <= per_partition or 4 * n <= held:
            left, held = cut(left.coalesce(max(1, math.ceil(n / per_partition)))), n


def draw(scored: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """scored (doc_id, n_words, score and others) with rank: 1, 2, 3 ... for the floor(percent of N / 100) highest scores of the N rows with at least least_words words, else null.

    Ties go to the smaller id, a null id last; of rows that share score and id any may be drawn
    first, equal in all columns or not, by a hash of their columns.
    """
    scored = cut(scored)
    fit = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    k = percent * scored.where(fit).count() // 100
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    upto = fit & cutoff(scored.where(fit), k).compare("<=")
    drawn = ranked(scored.where(upto), [], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank", "__all")
    # rows that share the last key may be more than are wanted
    drawn = drawn.drop("__all").withColumn("rank", F.when(F.col("rank") < k, F.col("rank") + 1))
    return scored.where(~upto).withColumn("rank", F.lit(None).cast("long")).unionByName(drawn)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs, drawn towards the texts of target.

    Null and empty texts have no features: weight 0, never drawn unless least_words is 0. Texts
    are worked on whole, in pieces. Repeated rows each have a place of their own; a null id is
    drawn as the empty text, behind all ids. Other columns are left out. An empty target makes
    all gains follow the corpus alone; empty docs give an empty table.
    """
    gain = gains(feature_counts(docs, text_col), feature_counts(target, target_col))
    rows = weights(docs, gain, id_col, text_col)
    return draw(rows.withColumn("score", F.col("weight") + gumbel(seed)), percent, least_words)


def drawn_texts(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs whose id is drawn, with all their columns and their rank (a column of that name is replaced). Rows that share a drawn id all pass, with its best rank; rows without an id don't."""
    rank = resample(docs, target, id_col=id_col, **how).where("rank is not null and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("rank").alias("rank"))
    return docs.drop("rank").join(rank, docs[id_col].cast("long") == F.col("__id")).drop("__id")
