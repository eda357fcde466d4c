"""LM scoring: a bigram model in Elias-Fano trie levels.

Tokens are words, A-Z in lower case, then one end of text. The model mixes relative frequency
with the base by a Dirichlet prior: P(w|h) = c(hw)/(c(h)+MU) + MU/(c(h)+MU) * P(w), where P(w) is
the base (c(w)+1)/(N+V+1). Counts cover all training texts. The trie is spread over buckets of
context words: in a bucket, monotone Elias-Fano pointers lead from a context to its successors,
which are an Elias-Fano sequence of (rank of the context, successor), found by successor search
relative to the context; beside each lies its smoothed share c(hw)/(c(h)+MU) in 16 bits (log10
in steps of 1/5000, rounded down so that no probability passes 1). Successors are known by 40 bits of their hash within a context.

A first pass counts all words: it gives the numbers N and V, and the contexts with over HOT, or over a mean bucket, of all
tokens, which are spread over buckets by successor as well. Every group of texts sends each bucket
its distinct words and pairs with counts and gets back counts and shares: no row for each token
leaves a task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import words as W
from .elias_fano import EliasFano, mapped
from .exchange import asked, joined, pack, parted, spread, unpack

MU, HOT, STEPS = 20.0, 0.002, 5000
#: Bytes of text in a group, about: a group's tokens, pairs and their order are in memory at once.
GROUP = 4 << 20
END, BOS = np.uint64(0x5EED5EED00000001), np.uint64(0x5EED5EED00000002)


def tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts, where each text begins, and the end)."""
    out, at, done = [], [], 0
    for _, texts in W.runs(table["text"]):
        w = W.split(texts, lower=True)
        h = np.insert(W.hashes(w), w.first[1:], END)
        starts = w.first[:-1] + np.arange(len(texts))
        out.append(h)
        at.append(starts + done)
        done += len(h)
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([np.zeros(0, np.int64), *at, [done]]).astype(np.int64)


def is_training(ids: list[int | None], divisor: int, rest: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % divisor != rest for i in ids], bool)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((W.mix(h) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _pack_counts(c: np.ndarray) -> bytes:
    """Counts as bytes; those over 254 as 255 and again as whole numbers."""
    big = c > 254
    return np.minimum(c, 255).astype(np.uint8).tobytes() + c[big].astype("<u4").tobytes()


def _unpack_counts(blob: memoryview, n: int) -> tuple[np.ndarray, int]:
    c = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    big = np.flatnonzero(c == 255)
    c[big] = np.frombuffer(blob, "<u4", len(big), offset=n)
    return c, n + 4 * len(big)


class _Group:
    """Distinct words and pairs of a group's texts, dealt to buckets."""

    def __init__(self, table: pa.Table, buckets: int, divisor: int, rest: int, hot: np.ndarray):
        self.ids = table["id"].to_pylist()
        h, self.at = tokens(table)
        self.train = is_training(self.ids, divisor, rest)
        flag = np.repeat(self.train, np.diff(self.at))
        self.words, self.word = np.unique(np.concatenate((h, [BOS, END])), return_inverse=True)
        self.word = self.word[:-2]
        self.count = np.bincount(self.word, flag, len(self.words)).astype(np.int64)
        before = np.empty(len(h), np.int64)
        before[1:] = self.word[:-1]
        before[self.at[:-1]] = np.searchsorted(self.words, BOS)
        pairs, self.pair = np.unique((before << 32) | self.word, return_inverse=True)
        self.pair_count = np.bincount(self.pair, flag, len(pairs)).astype(np.int64)
        self.head, self.tail = pairs >> 32, pairs & 0xFFFFFFFF
        real = self.words != BOS
        self.word_order, self.word_cuts = self._dealt(np.where(real, _bucket(self.words, buckets), buckets), buckets)
        key = self.words[self.head]
        spread = np.isin(key, hot)
        key = np.where(spread, W.mix(key) ^ self.words[self.tail], key)
        self.pair_order, self.pair_cuts = self._dealt(_bucket(key, buckets), buckets)

    @staticmethod
    def _dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))

    def blobs(self, buckets: int) -> list[tuple[int, bytes]]:
        out = []
        for b in range(buckets):
            w = self.word_order[self.word_cuts[b] : self.word_cuts[b + 1]]
            p = self.pair_order[self.pair_cuts[b] : self.pair_cuts[b + 1]]
            if not len(w) and not len(p):
                continue
            heads, n = np.unique(self.head[p], return_counts=True)
            tails = (self.words[self.tail[p]] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            out.append((b, joined([pack(self.words[w]), _pack_counts(self.count[w]), pack(self.words[heads]), _pack_counts(n), np.ascontiguousarray(tails).tobytes(), _pack_counts(self.pair_count[p])])))
        return out


def _read(blob: bytes) -> tuple[np.ndarray, ...]:
    """(words, counts, heads of the pairs, tails, counts)."""
    words, count, heads, n, tails, pair_count = parted(blob)
    words, heads = unpack(words), unpack(heads)
    n = _unpack_counts(memoryview(n), len(heads))[0]
    raw = np.zeros((len(tails) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(tails, np.uint8).reshape(-1, 5)
    return words, _unpack_counts(memoryview(count), len(words))[0], np.repeat(heads, n), raw.view("<u8").reshape(-1), _unpack_counts(memoryview(pair_count), len(raw))[0]


def quantised(share: np.ndarray) -> np.ndarray:
    """16 bits: 0 for none, else 1 to 65535 for 10^0 down to 10^(-65534/STEPS), about 10^-13."""
    with np.errstate(divide="ignore"):
        code = 1 + np.ceil(-np.log10(share) * STEPS)
    return np.where(share > 0, np.clip(code, 1, 65535), 0).astype(np.uint16)


def share_of(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((1.0 - code.astype(float)) / STEPS), 0.0)


class Trie:
    """One bucket of the model: contexts, pointers, successors and their shares."""

    def __init__(self, heads: np.ndarray, tails: np.ndarray, counts: np.ndarray, totals: dict[int, int], mu: float):
        seen = counts > 0
        heads, tails, counts = heads[seen], tails[seen], counts[seen]
        order = np.lexsort((tails, heads))
        heads, tails, counts = heads[order], tails[order], counts[order]
        new = np.ones(len(heads), bool)
        new[1:] = (heads[1:] != heads[:-1]) | (tails[1:] != tails[:-1])
        start = np.flatnonzero(new)
        counts = np.add.reduceat(counts, start) if len(start) else counts
        heads, tails = heads[start], tails[start]
        self.contexts, first, n = np.unique(heads, return_index=True, return_counts=True)
        total = np.add.reduceat(counts, first) if len(first) else counts
        total = np.array([totals.get(int(h), int(t)) for h, t in zip(self.contexts, total, strict=True)], float)
        rank = np.repeat(np.arange(len(first), dtype=np.uint64), n)
        self.pointers = EliasFano(np.append(first, len(heads)).astype(np.uint64), len(heads) + 1)
        self.successors = EliasFano((rank << np.uint64(40)) | tails, max(1, len(first)) << 40)
        self.shares = mapped(quantised(counts / (np.repeat(total, n) + mu)))

    def __call__(self, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """The quantised share of each pair; 0 for pairs not seen."""
        out = np.zeros(len(heads), np.uint16)
        if not len(self.contexts) or not len(heads):
            return out
        rank = np.minimum(np.searchsorted(self.contexts, heads), len(self.contexts) - 1)
        known = np.flatnonzero(self.contexts[rank] == heads)
        rank = rank[known]
        at = self.successors.successor((rank.astype(np.uint64) << np.uint64(40)) | tails[known])
        inside = at < self.pointers.get(rank + 1).astype(np.int64)
        known, at, rank = known[inside], at[inside], rank[inside]
        same = self.successors.get(at) == ((rank.astype(np.uint64) << np.uint64(40)) | tails[known])
        out[known[same]] = self.shares[at[same]]
        return out


def _counted(docs: DataFrame, divisor: int, rest: int, share: float) -> tuple[dict[int, int], int, int]:
    """(counts of the words with over `share` of the training tokens, at most 1/share; N; V). A task sends each of its words once, but for those beyond a million."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["h", "c"])

        for batch in batches:
            keep = is_training(batch.column(0).to_pylist(), divisor, rest)
            for at, texts in W.runs(batch.column(1)):
                mine = texts.filter(pa.array(keep[at : at + len(texts)]))
                h, c = np.unique(tokens(pa.table({"text": mine}))[0], return_counts=True)
                words, at_word = np.unique(np.concatenate((words, h)), return_inverse=True)
                counts = np.bincount(at_word, np.concatenate((counts, c)), len(words)).astype(np.int64)
                if len(words) > 1_000_000:
                    yield rows()
                    words, counts = words[:0], counts[:0]
        yield rows()

    counts = docs.mapInArrow(work, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    seen = Observation()
    top = counts.observe(seen, F.sum("c").alias("n"), F.count("*").alias("v")).orderBy(F.desc("c")).limit(math.ceil(1 / share)).collect()
    n, v = seen.get.get("n") or 0, seen.get.get("v") or 0
    hot = {r.h % (1 << 64): r.c for r in top if r.c > share * n}
    if int(END) in hot:
        hot[int(BOS)] = hot[int(END)]
    return hot, n, v


def score(docs: DataFrame, divisor: int = 7, rest: int = 2, mu: float = MU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    A row is held out from training if crc32 of its id as text leaves `rest` by `divisor`; a null
    id is neither learned nor held out. A null or empty text is one end token. Repeated rows count
    and are scored each; a very long text is in one group, alone. Other columns are ignored,
    whatever their names; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = spread(docs, id_col, text_col, GROUP)
    buckets = texts.groups
    # a context that stays in one bucket adds at most a mean bucket to it
    totals, n, v = _counted(rows, divisor, rest, min(HOT, 1 / buckets))
    hot = np.array(sorted(totals), np.uint64)
    hot_counts = np.array([totals[int(h)] for h in hot], float)

    def ask(table):
        return _Group(table, buckets, divisor, rest, hot).blobs(buckets)

    def answer(blobs, orders):
        each = [_read(x) for x in blobs]
        words, at = np.unique(np.concatenate([x[0] for x in each]), return_inverse=True)
        count = np.bincount(at, np.concatenate([x[1] for x in each]), len(words)).astype(np.int64)
        trie = Trie(np.concatenate([x[2] for x in each]), np.concatenate([x[3] for x in each]), np.concatenate([x[4] for x in each]), totals, mu)
        return [joined([_pack_counts(count[np.searchsorted(words, w)]), trie(h, t).astype("<u2").tobytes()]) for w, _, h, t, _ in each]

    def settle(table, answers):
        g = _Group(table, buckets, divisor, rest, hot)
        count, code = np.zeros(len(g.words), np.int64), np.zeros(len(g.head), np.uint16)
        for b, blob in answers.items():
            counts, codes = parted(blob)
            w = g.word_order[g.word_cuts[b] : g.word_cuts[b + 1]]
            count[w] = _unpack_counts(memoryview(counts), len(w))[0]
            code[g.pair_order[g.pair_cuts[b] : g.pair_cuts[b + 1]]] = np.frombuffer(codes, "<u2")
        count[np.searchsorted(g.words, BOS)] = count[np.searchsorted(g.words, END)]
        base = (count + 1) / (n + v + 1)
        context = count[g.head].astype(float)
        share = share_of(code)
        if len(hot):
            place = np.minimum(np.searchsorted(hot, g.words), len(hot) - 1)
            whole = np.where(hot[place] == g.words, hot_counts[place], count)[g.head]
            share *= (whole + mu) / (context + mu)
        p = np.log10(share + mu / (context + mu) * base[g.tail])
        sums = lambda values: np.add.reduceat(values, g.at[:-1]) if len(g.ids) else values[:0]
        return pa.table(
            {
                "doc_id": pa.array(g.ids, pa.int64()),
                "held_out": pa.array([bool(i is not None and not t) for i, t in zip(g.ids, g.train, strict=True)]),
                "n_tokens": pa.array(np.diff(g.at), pa.int64()),
                "n_known": pa.array(sums((count[g.word] > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(g.ids), n), pa.int64()),
                "base_score": pa.array(sums(np.log10(base)[g.word]), pa.float64()),
                "score": pa.array(sums(p[g.pair]), pa.float64()),
            }
        )

    return asked(texts, ask, answer, settle, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", texts.partitions)
