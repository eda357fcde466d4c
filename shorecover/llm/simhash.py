"""SimHash near-dedup: fingerprints of word shingles, linked by pigeonhole blocks.

A fingerprint bit is 1 if it is set in over half the shingles' XXH64. If 64 bits are cut into b
blocks, two fingerprints that differ in at most r bits share at least b - r whole blocks. So each
distinct fingerprint joins on every choice of b - r blocks, and pairs that meet are verified. b
grows with the number of distinct fingerprints, so that a choice has about as many values.
Equal fingerprints are one class before any join. Within one bucket, links are a spanning
forest found by a search over the bucket, never all pairs; a bucket of many near copies shrinks as
fast as it is found. A bucket of over DENSE fingerprints is cut into parts, and every two parts are
searched as one, each in a task that holds no more than these.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .tables import cut
from .words import SPACE, runs


#: Fingerprints of a bucket that one task searches alone.
DENSE = 16384
#: Shingles of a text that are hashed at once.
PIECE = 65536


def shingle_hashes(text: str, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each run of `size` words, repeats included, in pieces of at most PIECE; of the whole sequence if it is shorter; nothing without words."""
    data = np.frombuffer(text.encode().lower(), np.uint8)
    word = ~SPACE[data]
    kept = word.copy()
    kept[1:] |= word[:-1]
    joined = np.where(word, data, np.uint8(32))[kept].tobytes().strip()
    if not joined:
        return
    h = xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    ends = np.append(gaps, len(joined))[size - 1 :]
    if not len(ends):
        yield np.array([h(joined, 42)], np.uint64)
    for at in range(0, len(ends), PIECE):
        to = ends[at : at + PIECE].tolist()
        starts = (gaps[max(at - 1, 0) : at + PIECE - 1] + 1).tolist()
        yield np.fromiter((h(joined[x:y], 42) for x, y in zip(starts if at else [0, *starts], to, strict=False)), np.uint64, len(to))


def fingerprint(text: str, size: int) -> int:
    """The 64 bits of a text, summed piece by piece: beside the text a task holds some ten bytes a character of it and one piece."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, size):
        n += len(h)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, fp (long: the 64 bits). A text without words, or null, has fingerprint zero."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in runs(batch.column(1)):
                fp = np.array([fingerprint(t.as_py(), size) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, fp long")


def block_masks(n_blocks: int, radius: int) -> list[int]:
    """A mask of the bits of every choice of n_blocks - radius blocks, as signed 64-bit numbers."""
    edges = [64 * k // n_blocks for k in range(n_blocks + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(blocks[k] for k in chosen) for chosen in combinations(range(n_blocks), n_blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is connected within `radius` bits among distinct fingerprints."""
    left, heads, tails = fp, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                heads.append(np.full(len(found), x))
                tails.append(found)
                queue.extend(found)
                left = left[~near]
    none = np.zeros(0, fp.dtype)
    return np.concatenate([none, *heads]), np.concatenate([none, *tails])


def _bucket_links(k: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal k. Small runs: by distance in the run, all runs at once."""
    starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    sizes = np.diff(np.append(starts, len(k)))
    a, b = [], []
    for s, n in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
        x, y = _forest(np.unique(fp[s : s + n]), radius)
        a.append(x)
        b.append(y)
    small = np.repeat(sizes <= 16, sizes)
    k, fp = k[small], fp[small]
    for lag in range(1, 16):
        same = np.flatnonzero(k[lag:] == k[:-lag]) if len(k) > lag else np.zeros(0, int)
        if not len(same):
            break
        x, y = fp[same], fp[same + lag]
        near = (np.bitwise_count(x ^ y) <= radius) & (x != y)
        a.append(x[near])
        b.append(y[near])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(distinct: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """distinct: fp (n distinct longs). Columns a, b: links that connect all fingerprints within `radius` bits."""
    n_blocks = radius + 2
    while 64 * (n_blocks - radius) / n_blocks < np.log2(max(n, 2)) and n_blocks < 2 * radius:
        n_blocks += 1
    masks = block_masks(n_blocks, radius)
    keys = distinct.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("k"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """k, a, b: the links of a bucket, without k; each fingerprint of a dense one as a, without b."""
        for table, dense in by_key(batches, DENSE):
            k, fp = table["k"].to_numpy(), table["fp"].to_numpy()
            if dense:
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp), pa.nulls(len(k), pa.int64())], ["k", "a", "b"])
            else:
                a, b = _bucket_links(k, fp.view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["k", "a", "b"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in by_key(batches, 1 << 62):
            k, fp = table["tile"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            for s, e in zip(starts, np.append(starts[1:], len(k)), strict=True):
                a, b = _forest(np.unique(fp[s:e]), radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    found = cut(keys.select("k", "fp").repartition("k").sortWithinPartitions("k").mapInArrow(work, "k long, a long, b long"))
    dense = tiles(found.where("b is null").select("k", F.col("a").alias("fp")), DENSE)
    return found.where("b is not null").select("a", "b").unionAll(dense.repartition("tile").sortWithinPartitions("tile").mapInArrow(searched, "a long, b long"))


def by_key(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, bool]]:
    """The rows of batches sorted by their first column, in tables of whole keys. A key of over `most` rows comes in tables of its own of about so many, each marked True."""
    rest: list[pa.RecordBatch] = []
    key, dense = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy()
        at = int(np.searchsorted(k, key, "right")) if key is not None else 0
        if at:
            rest.append(batch.slice(0, at))
        if at < len(k):
            if rest:
                yield pa.Table.from_batches(rest), dense
            last = int(np.searchsorted(k, k[-1]))
            if last > at:
                yield pa.Table.from_batches([batch.slice(at, last - at)]), False
            rest, key, dense = [batch.slice(last)], k[-1], False
        if rest and sum(x.num_rows for x in rest) > most:
            dense = True
            yield pa.Table.from_batches(rest), True
            rest = []
    if rest:
        yield pa.Table.from_batches(rest), dense


def tiles(dense: DataFrame, size: int) -> DataFrame:
    """dense: k, fp. Columns tile, fp: the fingerprints of a k in parts of about `size`, each two parts as one tile, so that every pair of a k meets in one."""
    parts = dense.groupBy("k").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    own = dense.join(parts, "k").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # each part meets every other one; a sole part meets itself
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("own <> other or parts = 1")
    return each.select(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "fp")


def classes(prints: DataFrame, radius: int = 4) -> DataFrame:
    """prints: doc_id, fp. Columns doc_id, fp, component_id: the smallest doc_id reachable by links.

    Null ids do not count as smallest; a component of null ids alone has a null component_id.
    """
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), distinct.count(), radius))
    each = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = each.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(each.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, fp, component_id for every row, repeated ones included; see fingerprints() and classes().

    Null, empty and blank texts have fingerprint zero and are linked like any other; a text is
    hashed whole, whatever its length. Other columns are ignored, whatever their names; an empty
    table gives none.
    """
    return classes(cut(fingerprints(docs, size, id_col, text_col)), radius)


def first_rows(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component in found (doc_id, component_id).

    Rows that share an id are one document: one of them stays at most, that of the smallest hash
    of its text. Rows with a null id take no part and stay.
    """
    # the lists of ids are written first: Spark then knows their size and moves them instead of the texts where that is less
    copies = cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct())
    shared = cut(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col))
    kept = docs.where(F.col(id_col).isNotNull()).join(copies, id_col, "left_anti")
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))
    one = kept.join(shared, id_col, "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    alone = kept.join(shared, id_col, "left_anti")
    return alone.select(*docs.columns).unionAll(one.select(*docs.columns)).unionAll(docs.where(F.col(id_col).isNull()))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple[int | None, str | None]], size: int = 4, radius: int = 4) -> list[tuple]:
    """The same by definition, over a small list; for tests."""
    import re

    prints = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sh = [" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
        hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hs) > len(hs)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return [(rows[i][0], f"{prints[i]:016x}", least[group[i]]) for i in range(len(rows))]
