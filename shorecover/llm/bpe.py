"""BPE encoding and decoding with the vocabulary of a public tokenizer.

Distinct-word table: tasks split texts into units (an optional space and a run of non-space, or
white space) and keep, for a group of texts, its distinct units and the number of the unit at
each position. The units go to buckets by their hash: a bucket is a part of the table of the
corpus' distinct units, where each is encoded once. The ids join back to their group and, by
position, to its texts. So neither texts nor occurrences are shuffled, only packed numbers and
each group's distinct units. Decoding joins ids to the bytes of their pieces, a table of the
vocabulary's size that goes to every task. Units end where the tokenizer's own pre-tokenizer
always ends a piece, so the ids equal those of the whole text.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import joined, parted

#: Bytes of text in a group and, about, for a bucket of distinct units.
GROUP, BUCKET = 8 << 20, 16 << 20
#: White space as the pre-tokenizer's \s has it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNITS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def gather(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[offsets[i]:offsets[i+1]] for each i of index, joined; and where each part ends."""
    n = offsets[index + 1] - offsets[index]
    ends = np.cumsum(n)
    if not len(index) or not ends[-1]:
        return flat[:0], ends
    return flat[np.repeat(offsets[index] - (ends - n), n) + np.arange(ends[-1])], ends


class _Splitter:
    """Texts to units."""

    def __init__(self, spec: str):
        added = [x["content"] for x in json.loads(spec).get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def units(self, text: str) -> list[str]:
        """A text that holds an added token is one unit, as that token cuts pieces elsewhere."""
        return [text] if self.added and self.added.search(text) else _UNITS.findall(text)


@lru_cache(2)
def _splitter(spec: str) -> _Splitter:
    """Kept in the worker from task to task."""
    return _Splitter(spec)


@lru_cache(2)
def _encoder(spec: str):
    """The library's tokenizer, kept in the worker from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32, byte plane by byte plane, compressed."""
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(raw[:, :width].T).tobytes()
    return bytes([width]) + len(values).to_bytes(4, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack_numbers(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:5], "little")
    out = np.zeros((n, 4), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(blob[5:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u4").reshape(-1)


class _Group:
    """The texts of a group as numbers of its distinct units, in the order in which they first came."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.at = array("I")
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str, units: list[str]) -> None:
        index = self.index
        for u in units:
            if u not in index:
                index[u] = len(index)
        self.at.extend(map(index.__getitem__, units))
        self.ids.append(doc_id)
        self.counts.append(len(units))
        self.bytes += len(text)

    def rows(self, number: int, buckets: int) -> pa.RecordBatch:
        """One row of the layout (b = -1), and one for each bucket that has units of this group.

        Spark may run this twice; the group's name holds its place and its units, so that other
        rows in a partition the second time would give a group without answers and not wrong ones.
        """
        units = [u.encode() for u in self.index]
        g = int.from_bytes(hashlib.blake2b(b"\0".join([str(number).encode(), *units]), digest_size=8).digest(), "little") >> 1
        bucket = np.fromiter((zlib.crc32(u) % buckets for u in units), np.int64, len(units))
        ids = np.array([i or 0 for i in self.ids], "<i8").tobytes()
        null = np.array([i is None for i in self.ids], np.uint8).tobytes()
        at = np.frombuffer(self.at, np.uint32) if self.at else np.zeros(0, np.uint32)
        out = [(-1, joined([ids, null, pack_numbers(np.array(self.counts)), pack_numbers(bucket), pack_numbers(at)]))]
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(ends)):
            mine = [units[k] for k in order[ends[b] : ends[b + 1]]]
            out.append((int(b), joined([pack_numbers(np.fromiter(map(len, mine), np.int64, len(mine))), b"".join(mine)])))
        return pa.RecordBatch.from_arrays([pa.array([g] * len(out), pa.int64()), pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["g", "b", "blob"])


@lru_cache(2)
def _pieces(spec: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces by id, and where each begins."""
    spec = json.loads(spec)
    by_id = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec.get("added_tokens", [])}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    each = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in (by_id.get(i, "") for i in range(max(by_id) + 1))]
    return np.frombuffer(b"".join(each), np.uint8), np.cumsum([0, *map(len, each)])


def load(spark, path: str) -> Broadcast:
    """The tokenizer's file (a few MB, fixed), read on the driver and sent to the executors."""
    return spark.sparkContext.broadcast(Path(path).read_text())


def encode(docs: DataFrame, spec: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit numbers).

    A null text counts as empty and has no ids. One row for each input row, repeated ids and null
    ids included; other columns are ignored, whatever their names; an empty table gives none. A
    text longer than GROUP is a group of its own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(n_bytes / BUCKET))
    partitions = max(2 * math.ceil(n_bytes / GROUP), 8)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, group, number = _splitter(spec.value), _Group(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                group.add(doc_id, text, splitter.units(text))
                if group.bytes >= GROUP:
                    yield group.rows(number, buckets)
                    group, number = _Group(), number + 1
        if group.ids:
            yield group.rows(number, buckets)

    def encoded(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Each distinct unit of the bucket encoded once; every group gets those of its own."""
        index: dict[bytes, int] = {}
        asked = []
        for blob in table["blob"].to_pylist():
            lengths, data = parted(blob)
            ends = np.cumsum(unpack_numbers(lengths).astype(np.int64)).tolist()
            asked.append(np.fromiter((index.setdefault(data[a:e], len(index)) for a, e in zip([0, *ends], ends)), np.int64, len(ends)))
        encoder, units, ids, ends = _encoder(spec.value), list(index), array("I"), array("q", [0])
        for k in range(0, len(units), 10_000):
            for e in encoder.encode_batch_fast([u.decode() for u in units[k : k + 10_000]], add_special_tokens=False):
                ids.extend(e.ids)
                ends.append(len(ids))
        flat, offsets = np.array(ids, np.uint32), np.array(ends, np.int64)
        found = [joined([pack_numbers(offsets[q + 1] - offsets[q]), pack_numbers(gather(flat, offsets, q)[0])]) for q in asked]
        return pa.table({"g": table["g"], "b": table["b"], "blob": pa.array(found, pa.binary())})

    def placed(left: pa.Table, right: pa.Table) -> pa.Table:
        """The ids of each text, by the position of its units."""
        if not left.num_rows:
            raise ValueError("a partition of docs held other rows when it was read again")
        ids, null, counts, bucket, at = parted(left["blob"][0].as_py())
        counts, bucket, at = unpack_numbers(counts).astype(np.int64), unpack_numbers(bucket), unpack_numbers(at).astype(np.int64)
        replies = [parted(blob) for _, blob in sorted(zip(right["b"].to_pylist(), right["blob"].to_pylist()))]
        flat = np.concatenate([np.zeros(0, np.uint32), *[unpack_numbers(x) for _, x in replies]])
        sizes = np.concatenate([np.zeros(0, np.int64), *[unpack_numbers(n).astype(np.int64) for n, _ in replies]])
        if len(sizes) != len(bucket):
            raise ValueError("a partition of docs held other rows when it was read again")
        rank = np.empty(len(bucket), np.int64)
        rank[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
        out, ends = gather(flat, np.concatenate(([0], np.cumsum(sizes))), rank[at])
        last = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].astype(np.int64)
        return pa.table(
            {
                "doc_id": pa.array(np.frombuffer(ids, "<i8"), pa.int64(), mask=np.frombuffer(null, np.uint8).astype(bool)),
                "n_tokens": pa.array(np.diff(last), pa.int64()),
                "ids": pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(4 * last), pa.py_buffer(out.astype("<u4").tobytes())]).cast(pa.binary()),
            }
        )

    rows = rows.sortWithinPartitions("doc_id", F.xxhash64("text"))
    mixed = rows.mapInArrow(split, "g long, b int, blob binary").repartition(partitions, "g")
    replies = mixed.where("b >= 0").repartition(buckets, "b").groupBy("b").applyInArrow(encoded, "g long, b int, blob binary")
    return mixed.where("b < 0").groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(placed, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, spec: Broadcast) -> DataFrame:
    """The columns of encode() and text: the pieces of ids, as UTF-8 with U+FFFD for broken bytes; null ids give an empty text.

    The join of ids and pieces is a look-up in the piece table by id, in tasks, for each text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, offsets = _pieces(spec.value)
        for batch in batches:
            texts = []
            for ids in batch.column(2):
                data, _ = gather(flat, offsets, np.frombuffer(ids.as_py() or b"", "<u4").astype(np.int64))
                texts.append(data.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(work, "doc_id long, n_tokens long, ids binary, text string")


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
