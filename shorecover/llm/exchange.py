"""Questions of texts about the whole corpus, asked in packed blobs.

Texts lie in groups bounded in bytes. Each group sends a blob to each bucket of hashes of which it
has any; a bucket sees every blob of its hashes and answers each; a group reads its answers beside
its texts. The texts are shuffled once (both uses read one exchange), and a hash costs about its own
entropy instead of a row. There are never more blobs than hashes, and up to GROW times GROW GB of
text the size of a group follows the square root of the input, so that their number grows in
proportion. Beyond, groups keep their size, and blobs travel both ways through relays, each between
a range of groups and a range of buckets: a row then is all that a group has for a range of
buckets, so rows grow as groups times the root of the buckets and stay large, and a task holds
about as much as a group sends. Groups of one id, or of no id, are split like any other.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a group for 1 GB of text; beyond, the root of the GB, at most GROW, times as many.
GROUP_BYTES, GROW = 8 << 20, 8
#: More groups than this (some 64 GB of text) ask through relays.
DIRECT = 1024

Blobs = list[tuple[int, bytes]]


@dataclass
class Grouped:
    """texts: id, text, g (the group), o (smaller for smaller ids, equal for groups that share an id); dealt: the same before the shuffle."""

    texts: DataFrame
    groups: int
    partitions: int
    dealt: DataFrame | None = None


def _rows(docs: DataFrame, id_col: str, text_col: str, group_bytes: int) -> tuple[DataFrame, int, int]:
    """(id, text; bytes of text; number of groups)."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = group_bytes * min(GROW, max(1.0, math.sqrt(n_bytes / 1e9)))
    return docs, n_bytes, max(1, math.ceil(n_bytes / size))


def spread(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> Grouped:
    """Groups in no order: rows go to them by a hash of id and text; rows equal in both share a group."""
    docs, _, groups = _rows(docs, id_col, text_col, group_bytes)
    g = F.pmod(F.xxhash64("id", "text"), F.lit(groups))
    return Grouped(docs.withColumns({"g": g.cast("int"), "o": F.lit(0)}).repartition(2 * groups, "g"), groups, 2 * groups)


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> Grouped:
    """Groups in the order of (id, hash of the text); null ids come first.

    Bounds are quantiles of the ids in which a row counts by its bytes, so a run of long texts
    makes as many groups as its bytes need; they are one number a group. An id that fills whole
    groups alone, and the null id, are split by the hash of the text.
    """
    docs, n_bytes, groups = _rows(docs, id_col, text_col, group_bytes)
    weights = docs.select("id", (1 + F.floor(F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) * groups * 64 / max(1, n_bytes))).cast("int").alias("n"))
    firsts, bounds, subs = [0], [], [1]
    if groups > 1:
        shares = [k / groups for k in range(1, groups)]
        # a row counts 1 for each 64th of a group that it fills, and 1 more
        each = weights.withColumn("_", F.explode(F.sequence(F.lit(1), "n")))
        found, none, every = each.agg(F.percentile_approx("id", shares, max(10_000, 20 * groups)), F.count_if(F.col("id").isNull()), F.count("*")).first()
        often = Counter(found or [])
        bounds = sorted(set(often) | {b - 1 for b, n in often.items() if n > 1})
        # ranges: no id; then up to and with each bound; then the rest
        subs = [1 + round(groups * none / max(1, every)), *[often[b] + 1 if often[b] > 1 else 1 for b in bounds], 1]
        firsts = [0, *accumulate(subs)][:-1]
    at = F.lit(0)
    if bounds:
        steps = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])
        known = F.lit(bounds)
        at = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(known, at + step - 1) < F.col("id")), at + step).otherwise(at)) + 1
    o = F.when(F.col("id").isNull(), 0).otherwise(at)
    high = F.shiftright(F.xxhash64("text"), 32) + F.lit(1 << 31)
    rows = docs.withColumn("o", o.cast("int"))
    g = F.get(F.lit(firsts), F.col("o")) + F.shiftright(high * F.get(F.lit(subs), F.col("o")), 32) if bounds else F.lit(0)
    groups = sum(subs)
    rows = rows.withColumn("g", g.cast("int"))
    return Grouped(rows.repartition(2 * groups, "g"), groups, 2 * groups, rows)


def asked(
    texts: Grouped,
    ask: Callable[[pa.Table], Blobs],
    answer: Callable[[list[bytes], list[int]], list[bytes | None]],
    settle: Callable[[pa.Table, dict[int, bytes]], pa.Table],
    schema: str,
    partitions: int,
) -> DataFrame:
    """ask(texts of a group) -> (bucket, blob); answer(blobs of a bucket, the order number of each, ascending) -> a blob or None for each; settle(texts of a group, answers by bucket) -> rows."""
    if texts.groups > DIRECT:
        return _relayed(texts, ask, answer, settle, schema, partitions)

    def asks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found, o = ask(table), table["o"][0].as_py()
        return pa.table({"b": pa.array([b for b, _ in found], pa.int32()), "g": pa.array([key[0].as_py()] * len(found), pa.int32()), "o": pa.array([o] * len(found), pa.int32()), "blob": pa.array([x for _, x in found], pa.binary())})

    def answers(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("o", "ascending"), ("g", "ascending")])
        groups = table["g"].to_pylist()
        found = answer(table["blob"].to_pylist(), table["o"].to_pylist())
        rows = [(g, x) for g, x in zip(groups, found, strict=True) if x is not None]
        return pa.table({"g": pa.array([g for g, _ in rows], pa.int32()), "b": pa.array([key[0].as_py()] * len(rows), pa.int32()), "blob": pa.array([x for _, x in rows], pa.binary())})

    def settles(left: pa.Table, right: pa.Table) -> pa.Table:
        return settle(left, dict(zip(right["b"].to_pylist(), right["blob"].to_pylist(), strict=True)))

    blobs = texts.texts.groupBy("g").applyInArrow(asks, "b int, g int, o int, blob binary")
    replies = blobs.repartition(partitions, "b").groupBy("b").applyInArrow(answers, "g int, b int, blob binary")
    return texts.texts.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(settles, schema)


def _relayed(texts: Grouped, ask: Callable, answer: Callable, settle: Callable, schema: str, partitions: int) -> DataFrame:
    """asked() by relays (s, q), s a range of buckets and q one of groups; each range has about the root of all groups."""
    wide = math.isqrt(texts.groups - 1) + 1

    def asks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        g, o = key[0].as_py(), table["o"][0].as_py()
        return _to_relays([(b, g, o, blob) for b, blob in ask(table)], wide)

    def forward(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        s, q = (k.as_py() for k in key)
        by: dict[int, list] = {}
        for sheaf in table["blob"]:
            for item in _items(sheaf.as_py()):
                by.setdefault(item[0], []).append(item)
        return pa.table({"b": pa.array(list(by), pa.int32()), "s": pa.array([s] * len(by), pa.int32()), "q": pa.array([q] * len(by), pa.int32()), "blob": pa.array(map(_sheaf, by.values()), pa.binary())})

    def answers(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        items = sorted((x for sheaf in table["blob"] for x in _items(sheaf.as_py())), key=lambda x: (x[2], x[1]))
        found = answer([x[3] for x in items], [x[2] for x in items])
        replies = [(b, g, o, x) for (b, g, o, _), x in zip(items, found, strict=True) if x is not None]
        return _to_relays(replies, wide)

    def back(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for sheaf in table["blob"]:
            for item in _items(sheaf.as_py()):
                by.setdefault(item[1], []).append(item)
        return pa.table({"g": pa.array(list(by), pa.int32()), "blob": pa.array(map(_sheaf, by.values()), pa.binary())})

    def settles(left: pa.Table, right: pa.Table) -> pa.Table:
        return settle(left, {b: x for sheaf in right["blob"] for b, _, _, x in _items(sheaf.as_py())})

    place = "s int, q int, blob binary"
    relay = lambda df: df.repartition(texts.partitions, "s", "q").groupBy("s", "q")
    sent = relay(texts.texts.groupBy("g").applyInArrow(asks, place)).applyInArrow(forward, "b int, " + place)
    replies = sent.repartition(partitions, "b").groupBy("b").applyInArrow(answers, place)
    returned = relay(replies).applyInArrow(back, "g int, blob binary")
    return texts.texts.groupBy("g").cogroup(returned.groupBy("g")).applyInArrow(settles, schema)


#: What a relay passes on: bucket, group, order number, blob.
Item = tuple[int, int, int, bytes]


def _sheaf(items: list[Item]) -> bytes:
    """Items as one blob."""
    heads = np.array([(b, g, o, len(x)) for b, g, o, x in items], "<i4")
    return len(items).to_bytes(4, "little") + heads.tobytes() + b"".join(x for *_, x in items)


def _items(sheaf: bytes) -> Iterator[Item]:
    n = int.from_bytes(sheaf[:4], "little")
    at = 4 + 16 * n
    for b, g, o, size in np.frombuffer(sheaf, "<i4", 4 * n, 4).reshape(n, 4).tolist():
        yield b, g, o, sheaf[at : at + size]
        at += size


def _to_relays(items: list[Item], wide: int) -> pa.Table:
    """A row for each relay that the items go to."""
    by: dict[tuple[int, int], list[Item]] = {}
    for item in items:
        by.setdefault((item[0] // wide, item[1] // wide), []).append(item)
    return pa.table({"s": pa.array([s for s, _ in by], pa.int32()), "q": pa.array([q for _, q in by], pa.int32()), "blob": pa.array(map(_sheaf, by.values()), pa.binary())})


def pack(sorted_values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, each in as many bytes as the largest needs."""
    n = len(sorted_values)
    if not n:
        return bytes([1])
    gaps = np.empty(n, np.uint64)
    gaps[0] = 0
    np.subtract(sorted_values[1:], sorted_values[:-1], out=gaps[1:])
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + int(sorted_values[0]).to_bytes(8, "little") + gaps.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if len(blob) == 1:
        return np.zeros(0, np.uint64)
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(raw), 8), np.uint8)
    gaps[:, :width] = raw
    gaps = gaps.view("<u8").reshape(-1)
    gaps[0] = int.from_bytes(blob[1:9], "little")
    return np.cumsum(gaps, dtype=np.uint64)


def cuts(sorted_values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of `buckets` equal ranges of 64-bit numbers begins, and the end."""
    edges = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
    return np.append(np.searchsorted(sorted_values, edges), len(sorted_values))


def joined(parts: list[bytes]) -> bytes:
    """Parts of under 4 GB as one blob."""
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def parted(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return out
