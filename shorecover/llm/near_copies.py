"""SimHash near-dedup at a similarity of 0.8: long fingerprints, blocks of their bits, Hamming verified.

The similarity is the one that SimHash estimates, the cosine of the sets of five-word shingles
(0.8 is a Jaccard likeness of 2/3). Fingerprints of 64 bits can't tell it. Here a fingerprint has
BITS bits: each is 1 if it is set in over half the hashes of the text's distinct shingles. Texts
of cosine c differ in a share acos(c)/pi of the bits, 0.205 for 0.8. LIMIT is that share of BITS
and MARGIN deviations more, so a pair at 0.8 fails it with a probability of 0.02; pairs down to
about 0.75 may pass. Blocks are drawn choices of `width` bits, such that a block value has about 32
to 64 unrelated fingerprints. Fingerprints that differ in a share p of bits agree in a block with
a probability (1-p)^width; as many blocks are taken as let a pair at 0.8 miss all of them with a
probability of MISS (at a Jaccard likeness of 0.8: about 10^-4).

The first 64 bits name a fingerprint: texts that agree in them are one class (a Jaccard likeness
of 0.9 does so with a probability of 10^-3, unrelated texts never). Each block is searched whole. In
a block of at most SMALL fingerprints all pairs are held against each other, by 128 bits first and
all bits then. One with more near pairs than members in them (a group of copies), and a larger one,
is searched for a spanning forest by all bits, so many copies give a link each and no pairs. One beyond CROWD is cut into parts, and every two parts are searched as one,
so no task holds more than two parts and no pair is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .fingerprints import shingles
from .simhash import by_key, first_rows, tiles
from .tables import cut

LANES, SIZE, SIMILARITY, MISS, MARGIN = 16, 5, 0.8, 0.02, 2.0
BITS = 64 * LANES
#: Up to SMALL fingerprints of a block are paired; more are searched, in parts of about CROWD.
SMALL, CROWD = 256, 8192
_SEEDS = np.random.default_rng(64).integers(1, 2**63, LANES, dtype=np.uint64)


def limit(similarity: float, bits: int = BITS, margin: float = MARGIN) -> int:
    """The number of bits in which texts of a similarity differ on average, and `margin` deviations."""
    share = math.acos(similarity) / math.pi
    return math.floor(bits * share + margin * math.sqrt(bits * share * (1 - share)))


def blocks(n: int, similarity: float = SIMILARITY, miss: float = MISS) -> np.ndarray:
    """The bit numbers of each block, for n fingerprints; the first blocks of a width are always the same."""
    width = max(10, math.ceil(math.log2(max(n, 2) / 64)))
    meet = (1 - math.acos(similarity) / math.pi) ** width
    count = math.ceil(math.log(miss) / math.log(1 - meet))
    rng = np.random.default_rng(width)
    return np.array([np.sort(rng.choice(BITS, width, False)) for _ in range(count)])


def _majority(h: np.ndarray) -> np.ndarray:
    """The fingerprint of distinct hashes, counted eight bits at a time."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 255):
        bits = np.unpackbits(W.mix(h[k : k + 255, None] ^ _SEEDS).view(np.uint8), axis=1, bitorder="little")
        ones += bits.view(np.uint64).sum(0).view(np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def prints(texts: pa.Array, size: int = SIZE) -> np.ndarray:
    """uint64[texts, LANES]; zero for a text without words. A-Z count as lower case."""
    h, at = shingles(texts, size, lower=True)
    out = np.zeros((len(at) - 1, LANES), np.uint64)
    for k in np.flatnonzero(np.diff(at)):
        out[k] = _majority(np.unique(h[at[k] : at[k + 1]]))
    return out


def fingerprints(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, fp (long: the first 64 bits), wide (binary: all bits). A null text has no words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in W.runs(batch.column(1)):
                wide = prints(texts, size)
                columns = [batch.column(0).slice(row, len(texts)), pa.array(wide[:, 0].view(np.int64)), pa.array([x.tobytes() for x in wide], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "wide"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, fp long, wide binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, LANES)


def _pairs(k: np.ndarray, fp: np.ndarray, more: np.ndarray, part: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """The indexes of all pairs of one k, at most SMALL to a k, and of two parts that differ in at most `near` of 128 bits. k is sorted."""
    none = np.zeros(0, np.int64)
    a, b = [none], [none]
    for lag in range(1, SMALL):
        same = np.flatnonzero(k[lag:] == k[:-lag])
        if not len(same):
            break
        same = same[part[same] != part[same + lag]]
        apart = np.bitwise_count((fp[same] ^ fp[same + lag]).view(np.uint64)).astype(np.int16) + np.bitwise_count((more[same] ^ more[same + lag]).view(np.uint64))
        met = same[apart <= near]
        a.append(met)
        b.append(met + lag)
    return np.concatenate(a), np.concatenate(b)


def _few_strangers(fp: np.ndarray, more: np.ndarray, part: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The pairs of a block as by _pairs(), if but SMALL of its members are outside its largest part; else None."""
    values, at, n = np.unique(part, return_inverse=True, return_counts=True)
    others = np.flatnonzero(at != n.argmax())
    if len(others) > SMALL:
        return None
    none = np.zeros(0, np.int64)
    a, b = [none], [none]
    for k in others:
        apart = np.bitwise_count((fp ^ fp[k]).view(np.uint64)).astype(np.int16) + np.bitwise_count((more ^ more[k]).view(np.uint64))
        met = np.flatnonzero((apart <= near) & (part != part[k]))
        a.append(np.full(len(met), k))
        b.append(met)
    return np.concatenate(a), np.concatenate(b)


def _sparse(k: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each pair is of a k with no more pairs than members in pairs, the members of the other k)."""
    block = np.cumsum(np.concatenate(([0], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    members = np.unique(np.concatenate((a, b)))
    n = int(block[-1]) + 1 if len(k) else 0
    few = np.bincount(block[a], minlength=n) <= np.bincount(block[members], minlength=n)
    return few[block[a]], members[~few[block[members]]]


def _forest(fp: np.ndarray, wide: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is connected within `most` bits."""
    heads, tails = [fp[:0]], [fp[:0]]
    while len(fp):
        queue, fp, wide = [(fp[0], wide[0])], fp[1:], wide[1:]
        while queue and len(fp):
            name, bits = queue.pop()
            near = np.bitwise_count(wide ^ bits).sum(1, dtype=np.int64) <= most
            if near.any():
                heads.append(np.full(int(near.sum()), name))
                tails.append(fp[near])
                queue.extend(zip(fp[near], wide[near], strict=True))
                fp, wide = fp[~near], wide[~near]
    return np.concatenate(heads), np.concatenate(tails)


def links(distinct: DataFrame, n: int, similarity: float = SIMILARITY) -> DataFrame:
    """distinct: fp, wide (n rows, fp distinct). Columns a, b: verified links that connect what the blocks bring together.

    A quarter of the blocks is searched first. What they link is one part, and the other blocks
    are searched for links between different parts only: a group of copies is worked off once and
    not in every block, and no link to a text outside it is lost.
    """
    chosen = blocks(n, similarity)
    first = max(1, len(chosen) // 4)
    found = cut(_searched(distinct.select("fp", "wide", F.col("fp").alias("part")), chosen[:first], similarity, 0))
    roots = components(found)
    parts = cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "wide", F.coalesce("root", "fp").alias("part")))
    return found.unionAll(_searched(parts, chosen[first:], similarity, first)) if first < len(chosen) else found


def _searched(distinct: DataFrame, chosen: np.ndarray, similarity: float, number: int) -> DataFrame:
    """The links (a, b) between different parts that the chosen blocks bring together; distinct: fp, wide, part. number: of the first block."""
    most = limit(similarity)
    # 3.5 deviations beyond the mean of the first 128 bits
    share = most / BITS
    near = math.floor(128 * share + 3.5 * math.sqrt(128 * share * (1 - share)))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 2048):
                rows = batch.slice(row, 2048)
                wide = _matrix(rows.column(1))
                bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
                k = np.zeros((len(bits), len(chosen)), np.uint64)
                for place in range(chosen.shape[1]):
                    k = (k << np.uint64(1)) | bits[:, chosen[:, place]]
                k = W.mix(k ^ W.mix(np.arange(number + 1, number + len(chosen) + 1, dtype=np.uint64)))
                each = [np.repeat(x, len(chosen)) for x in (rows.column(0).to_numpy(), wide[:, 1].view(np.int64), rows.column(2).to_numpy())]
                yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1).view(np.int64)), *map(pa.array, each)], ["k", "fp", "more", "part"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """k, a, b: the pairs of blocks, without k; each fingerprint of a block that is searched by all bits as a, without b."""
        for table, dense in by_key(batches, CROWD):
            k, fp, more, part = (table[c].to_numpy() for c in ("k", "fp", "more", "part"))
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            sizes = np.diff(np.append(starts, len(k)))
            small = np.flatnonzero(np.repeat((sizes <= SMALL) & (not dense), sizes))
            i, j = (small[x] for x in _pairs(k[small], fp[small], more[small], part[small], near))
            crowded = np.repeat((sizes > SMALL) | dense, sizes)
            for s, n in zip(starts, sizes):
                few = None if n <= SMALL or dense else _few_strangers(fp[s : s + n], more[s : s + n], part[s : s + n], near)
                if few is not None:
                    i, j = np.concatenate((i, s + few[0])), np.concatenate((j, s + few[1]))
                    crowded[s : s + n] = False
            keep, members = _sparse(k, i, j)
            a, b = fp[i[keep]], fp[j[keep]]
            crowded[members] = True
            k, fp = k[crowded], fp[crowded]
            none = pa.nulls(len(a), pa.int64()), pa.nulls(len(fp), pa.int64())
            yield pa.RecordBatch.from_arrays([none[0], pa.array(a), pa.array(b)], ["k", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp), none[1]], ["k", "a", "b"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in by_key(batches, 1 << 62):
            k, fp, wide = table["tile"].to_numpy(), table["fp"].to_numpy(), _matrix(table["wide"])
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            for s, e in zip(starts, np.append(starts[1:], len(k)), strict=True):
                order = s + np.argsort(fp[s:e])
                a, b = _forest(fp[order], wide[order], most)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.bitwise_count(_matrix(batch.column(2)) ^ _matrix(batch.column(3))).sum(1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(apart <= most))

    keyed = distinct.select("fp", "wide", "part").mapInArrow(keys, "k long, fp long, more long, part long")
    found = cut(keyed.repartition("k").sortWithinPartitions("k").mapInArrow(met, "k long, a long, b long"))
    pairs = found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a = distinct.select(F.col("fp").alias("a"), F.col("wide").alias("wa"))
    b = distinct.select(F.col("fp").alias("b"), F.col("wide").alias("wb"))
    near_pairs = pairs.join(a, "a").join(b, "b").select("a", "b", "wa", "wb").mapInArrow(verified, "a long, b long")

    crowded = found.where("b is null").select("k", F.col("a").alias("fp"))
    dealt = tiles(crowded, CROWD).join(distinct.select("fp", "wide"), "fp").select("tile", "fp", "wide").repartition("tile").sortWithinPartitions("tile")
    return near_pairs.unionAll(dealt.mapInArrow(searched, "a long, b long"))


def near_copies(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, component_id (the smallest doc_id reachable by links) for every row.

    Texts without words, null among them, are copies of each other. Null ids do not count as
    smallest; a component of null ids alone has a null component_id. Repeated rows keep a row each.
    A text is fingerprinted whole, a few hundred hashes at a time, whatever its length. Other
    columns are ignored, also those named like columns of the result; an empty table gives none.
    """
    each = cut(fingerprints(docs, size, id_col, text_col))
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("wide").alias("wide")))
    roots = components(links(distinct, distinct.count(), similarity))
    named = distinct.select("fp", "least").join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return each.select("doc_id", "fp").join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "component_id")


def keep_one(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each component the row of the smallest id.

    Rows that share an id are one document: one of them stays at most, that of the smallest hash
    of its text. Rows with a null id take no part and stay. All columns stay, whatever their names;
    an empty table stays empty.
    """
    named = docs.where(F.col(id_col).isNotNull())
    return first_rows(docs, near_copies(named, size, similarity, id_col, text_col), id_col, text_col)


def brute_force(rows: list[tuple[int | None, str | None]], size: int = SIZE, similarity: float = SIMILARITY, margin: float = MARGIN) -> list[tuple]:
    """(id, component) by comparing all fingerprints with each other, over a small list; for tests."""
    wide = np.concatenate([prints(texts, size) for _, texts in W.runs(pa.array([t for _, t in rows], pa.string()))])
    group = np.arange(len(rows))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(wide[:i] ^ wide[i]).sum(1, dtype=np.int64) <= limit(similarity, margin=margin)):
            group[group == group[i]] = group[j]
    least = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in group}
    return [(r[0], least[g]) for r, g in zip(rows, group, strict=True)]
