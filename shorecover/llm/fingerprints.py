"""Document fingerprints: MinHash signatures over word shingles.

Each of PERMUTATIONS universal hashes (multiply and shift, odd multipliers) keeps its least
value over a text's shingles, as 16 bits. The share of equal places estimates the Jaccard
likeness of two texts. near_duplicates() joins bands of signatures in Spark and verifies the
links it finds with the exact likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .exchange import grouped
from .tables import cut

PERMUTATIONS, SHINGLE, BAND_ROWS = 128, 5, 4
_RNG = np.random.default_rng(90210)
_A = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, PERMUTATIONS, dtype=np.uint64)


def shingles(texts: pa.Array, size: int = SHINGLE, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, where those of each text begin, and the end): every run of `size` words; the whole sequence of a shorter text. lower: with A-Z in lower case."""
    w = W.split(texts, lower)
    h = W.hashes(w)
    n = np.diff(w.first)
    _, long = W.windows(h, w.first, size)
    counts = np.maximum(n - size + 1, 0)
    short = np.flatnonzero((n > 0) & (n < size))
    ends = np.cumsum(counts + ((n > 0) & (n < size)))
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    whole = np.ones(len(out), bool)
    whole[ends[short] - 1] = False
    out[whole] = long
    for k in short:
        out[ends[k] - 1] = W.windows(h, w.first[k : k + 2], int(n[k]))[1][0]
    return out, np.concatenate(([0], ends)).astype(np.int64)


def signatures(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """uint16[texts, PERMUTATIONS]; all ones for a text without words."""
    h, at = shingles(texts, size)
    out = np.full((len(at) - 1, PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    for k in range(len(out)):
        for a in range(at[k], at[k + 1], 2048):
            x = h[a : min(a + 2048, at[k + 1])]
            np.minimum(out[k], ((x[None, :] * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(1), out=out[k], casting="unsafe")
    return (out & np.uint32(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, signature (binary, 16-bit little-endian). A null text counts as empty; equal texts have equal signatures."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in W.runs(batch.column(1)):
                raw = [s.astype("<u2").tobytes() for s in signatures(texts, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array(raw, pa.binary())], ["doc_id", "signature"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, signature binary")


def _forest(sig: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links by signature that connect what is connected in one bucket: a search, never all pairs."""
    left, found = np.arange(len(sig)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = likeness(sig[left], sig[x]) >= threshold
            found += [(int(x), int(y)) for y in left[near]]
            queue.extend(left[near])
            left = left[~near]
    return found


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, class_id (smallest id of the class), n_links (verified links at its signature).

    Texts of one signature are one class. Signatures that share a band meet in a bucket; there a
    search links those whose estimated likeness is at most 0.1 below the threshold, and each link is verified by
    the Jaccard likeness of the shingle sets. A pair at 0.8 shares none of 32 bands with a
    probability below 10^-7; one that hangs on a rejected link in one bucket is left to its other
    buckets. n_links counts the links of the searches that hold, not all pairs. Null texts count
    as empty, texts without words are one class. A row for each row of docs, repeated ones
    included; null ids never are a class_id unless a class has no other. Texts are read whole;
    other columns are ignored, whatever their names; an empty table gives none.
    """
    prints = cut(fingerprints(docs, size, id_col, text_col))
    distinct = cut(prints.groupBy("signature").agg(F.min("doc_id").alias("least")).select("signature", "least", F.xxhash64("signature").alias("node")))
    bands = [F.xxhash64(F.lit(k), F.substring("signature", 2 * BAND_ROWS * k + 1, 2 * BAND_ROWS)) for k in range(PERMUTATIONS // BAND_ROWS)]
    keyed = distinct.select("node", "signature", F.explode(F.array_distinct(F.array(*bands))).alias("k"))
    crowded = keyed.groupBy("k").count().where("count > 1").select("k")

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes = table["node"].to_numpy()
        sig = np.array([np.frombuffer(x, "<u2") for x in table["signature"].to_pylist()])
        pairs = _forest(sig, threshold - 0.1)
        return pa.table({"a": pa.array([int(nodes[a]) for a, _ in pairs], pa.int64()), "b": pa.array([int(nodes[b]) for _, b in pairs], pa.int64())})

    links = cut(keyed.join(crowded, "k", "left_semi").groupBy("k").applyInArrow(work, "a long, b long").distinct())
    # the set of a signature comes from its own texts: ids may be null or shared by different texts
    linked = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _shingle_sets(docs, size, text_col).join(linked, "node", "left_semi").groupBy("node").agg(F.min_by("s", F.xxhash64("s")).alias("s"))
    a, b = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = cut(links.join(a, "a").join(b, "b").where(both >= threshold * (F.size("sa") + F.size("sb") - both)).select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    each = distinct.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")).join(degree, "node", "left")
    least = each.groupBy("root").agg(F.min("least").alias("class_id"))
    return prints.join(each.join(least, "root").select("signature", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "signature").select("doc_id", "class_id", "n_links")


def _shingle_sets(docs: DataFrame, size: int, text_col: str) -> DataFrame:
    """Columns node (of the signature), s: the set of hashes of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in W.runs(batch.column(0)):
                h, at = shingles(texts, size)
                sets = [np.unique(h[a:b]).view(np.int64) for a, b in zip(at, at[1:])]
                raw = [s.astype("<u2").tobytes() for s in signatures(texts, size)]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["signature", "s"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(work, "signature binary, s array<long>")
    return rows.select(F.xxhash64("signature").alias("node"), "s")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text beside an edited one: its last floor(n/2) code points give way to the first as many of the next text.

    The next text is that of the next smaller id (ties: of the next smaller hash of the text, then
    text; null ids come last), after the last the first. Columns doc_id, n_chars, edited_sha256,
    signature and edited_signature (binary), near_edited, near_next. Texts lie in groups in this order,
    also those of one id; each group also gets the one text that follows it. A null text counts as
    empty; other columns are ignored; an empty table gives none.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = grouped(docs)
    rows = texts.texts.select("id", "text", "g").withColumn("h", F.xxhash64("text"))
    # from the rows before the shuffle: a task sends one text a group at most
    heads = texts.dealt.withColumn("h", F.xxhash64("text")).groupBy("g").agg(F.max(F.struct("id", "h", "text")).alias("top")).select("g", F.col("top.text").alias("text"))
    # the head of a group goes to the next greater group, that of the greatest to the least
    order = Window.orderBy("g")
    present = texts.dealt.select("g").distinct()
    places = present.select("g", F.coalesce(F.lead("g").over(order), F.first("g").over(order)).alias("to"))
    heads = heads.join(places, "g").select(F.col("to").alias("g"), "text")

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = left["id"].to_pylist(), [t or "" for t in left["text"].to_pylist()]
        hashes = left["h"].to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, hashes[k], own[k].encode()), reverse=True)
        following = right["text"][0].as_py() if right.num_rows else own[order[0]] if order else ""
        ordered = [own[k] for k in order]
        nexts = [*ordered[1:], following]
        changed = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(ordered, nexts, strict=True)]
        sig = _signed([*ordered, following])
        new = _signed(changed)
        return pa.table(
            {
                "doc_id": pa.array([ids[k] for k in order], pa.int64()),
                "n_chars": pa.array([len(t) for t in ordered], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                "signature": pa.array([s.astype("<u2").tobytes() for s in sig[:-1]], pa.binary()),
                "edited_signature": pa.array([s.astype("<u2").tobytes() for s in new], pa.binary()),
                "near_edited": pa.array(likeness(sig[:-1], new), pa.float64()),
                "near_next": pa.array(likeness(sig[:-1], sig[1:]), pa.float64()),
            }
        )

    schema = "doc_id long, n_chars long, edited_sha256 string, signature binary, edited_signature binary, near_edited double, near_next double"
    return rows.groupBy("g").cogroup(heads.groupBy("g")).applyInArrow(settle, schema)


def _signed(texts: list[str]) -> np.ndarray:
    found = [signatures(run) for _, run in W.runs(pa.array(texts, pa.large_string()))]
    return np.concatenate([np.zeros((0, PERMUTATIONS), np.uint16), *found])


def digest(found: DataFrame) -> DataFrame:
    hexed = lambda c: F.lower(F.hex(c))
    return found.select("doc_id", "n_chars", "edited_sha256", hexed("signature").alias("fingerprint"), hexed("edited_signature").alias("edited_fingerprint"), "near_edited", "near_next")
