"""Substring dedup: Rabin-Karp hashes of every window of words, counted over the corpus.

A window is `size` consecutive words of one document. A window whose words also start in a
document with a smaller id is a repeat; overlapping repeats merge into maximal intervals of
words, and those go. Windows are judged on the input. Hashes have 64 bits: among n different
windows about n^2 / 2^65 pairs are taken as equal by chance (0.03 in 10^9 windows).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .exchange import asked, cuts, grouped, pack, unpack


def _group_windows(table: pa.Table, size: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Runs as (first row, Words, window starts, window hashes); all hashes; the row of each."""
    found, at, rows = [], [], []
    for row, texts in W.runs(table["text"]):
        w = W.split(texts)
        first, h = W.windows(W.hashes(w), w.first, size)
        found.append((row, w, first))
        at.append(h)
        rows.append(row + np.searchsorted(w.first, first, "right") - 1)
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return found, cat(at, np.uint64), cat(rows, np.int64)


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table["id"].combine_chunks() if isinstance(table["id"], pa.ChunkedArray) else table["id"]
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False)


def remove_repeats(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, n_words, n_removed, kept (binary, UTF-8 words joined by one space), spans.

    spans holds the removed intervals as (first word, end) pairs. A null text has no words. A row
    with a null id keeps all its words and removes none elsewhere. Rows that share an id are
    judged one by one and never remove each other's words, in one group or in several. Texts are
    read whole, a run of about 1 MB at a time. Other columns are ignored; an empty table gives an
    empty result.
    """
    texts = grouped(docs, id_col, text_col)
    buckets = texts.groups

    def hashed(table):
        runs, h, rows = _group_windows(table, size)
        ids, null = _ids(table)
        named = ~null[rows] if len(rows) else np.zeros(0, bool)
        return runs, h, rows, ids, null, named

    def ask(table):
        _, h, _, _, _, named = hashed(table)
        h = np.unique(h[named])
        at = cuts(h, buckets)
        return [(b, pack(h[at[b] : at[b + 1]])) for b in range(buckets) if at[b] < at[b + 1]]

    def answer(blobs, orders):
        """A bit for each hash of a blob: a group of smaller ids has it too (groups that share an id have one order number)."""
        each = [unpack(x) for x in blobs]
        h, own = np.concatenate(each), np.repeat(orders, [len(x) for x in each])
        order = np.argsort(h, kind="stable")
        first = np.ones(len(h), bool)
        first[1:] = h[order[1:]] != h[order[:-1]]
        least = own[order[np.flatnonzero(first)]][np.cumsum(first) - 1]
        again = np.zeros(len(h), bool)
        again[order] = own[order] > least
        ends = np.cumsum([len(x) for x in each])
        return [np.packbits(x).tobytes() if x.any() else None for x in np.split(again, ends[:-1])]

    def settle(table, answers):
        runs, h, rows, ids, null, named = hashed(table)
        repeat = np.zeros(len(h), bool)
        if named.any():
            seen, inverse = np.unique(h[named], return_inverse=True)
            at = cuts(seen, buckets)
            earlier = np.zeros(len(seen), bool)
            for b, bits in answers.items():
                n = at[b + 1] - at[b]
                earlier[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
            own = ids[rows[named]]
            least = np.full(len(seen), np.iinfo(np.int64).max)
            np.minimum.at(least, inverse, own)
            repeat[named] = earlier[inverse] | (own > least[inverse])
        out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept", "spans")}
        done = 0
        for row, w, first in runs:
            mine = first[repeat[done : done + len(first)]]
            done += len(first)
            edge = np.zeros(len(w.starts) + 1, np.int64)
            np.add.at(edge, mine, 1)
            np.add.at(edge, np.minimum(mine + size, len(w.starts)), -1)
            gone = np.cumsum(edge[:-1]) > 0
            data, offsets = W.kept_texts(w, ~gone)
            data, n = data.tobytes(), np.diff(w.first)
            removed = np.zeros(len(gone) + 1, np.int64)
            np.cumsum(gone, out=removed[1:])
            removed = np.diff(removed[w.first])
            for k in range(len(n)):
                out["doc_id"].append(None if null[row + k] else int(ids[row + k]))
                out["n_words"].append(int(n[k]))
                out["n_removed"].append(int(removed[k]))
                out["kept"].append(data[offsets[k] : offsets[k + 1]])
                spans = []
                if removed[k]:
                    flag = np.concatenate(([0], gone[w.first[k] : w.first[k + 1]].view(np.int8), [0]))
                    step = np.diff(flag)
                    spans = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]
                out["spans"].append(spans)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), span)
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    schema = "doc_id long, n_words long, n_removed long, kept binary, spans array<struct<start: long, end: long>>"
    return asked(texts, ask, answer, settle, schema, texts.partitions)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], size: int = 13) -> list[tuple]:
    """The same by definition, over a small list; for tests."""
    import re

    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and least[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
