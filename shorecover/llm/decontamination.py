"""Benchmark decontamination by templates.

Texts are brought to templates: numbers (also spelled out), names and units after numbers become typed slots,
other words are compared in lower case without outer punctuation. Windows of WINDOW words
hash-join those of the benchmark, as templates and, whatever their slots, as they are; windows of
a document and an item that lie on one diagonal are one passage. In it one value of the item
stands for one value of the document (the most frequent, or else the first); slots of other
values split the passage. A part counts if it covers MIN_WORDS words of the item (or MIN_SHARE
of a shorter one); if the passage was split, its slots do not count as words. So a question
with other numbers or names is caught as well as a copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import cut

WINDOW, MIN_WORDS, MIN_SHARE = 8, 13, 0.8
#: A template window with fewer plain words is no evidence unless all its words are the item's own.
MIN_PLAIN = 4
#: Up to so many benchmark windows (8 bytes each) go to every task; more are joined by a shuffle.
LOCAL_WINDOWS = 500_000
#: Units of measure.
UNITS = "mm cm m km in ft yd mi g kg mg lb oz t l ml s sec min h hr hours minutes seconds days weeks months years meters metres miles kilometers kilometres feet inches pounds dollars euros cents percent kmh mph hz khz w kw v a k c f °c °f % $ €".split()
#: Spelled-out numbers; "one" is left out, as it mostly is no number.
NUMBERS = "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) for c in ".,:/-+%$"]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PUNCT[[ord("%"), ord("$")]] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\""]] = True
NUM, NAME, UNIT, TEMPLATE = np.uint64(0x1111), np.uint64(0x2222), np.uint64(0x3333), np.uint64(0x4444)


def _listed(words: list[str]) -> np.ndarray:
    return np.sort(W.hashes(W.split(pa.array([" ".join(words)], pa.large_string()))))


_UNITS, _NUMBERS = _listed(UNITS), _listed(NUMBERS)


def template(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template word, its own hash, whether it is a slot, first word of each text) of one run of texts."""
    w = W.split(texts)
    starts, ends = w.starts.copy(), w.ends.copy()
    for _ in range(3):
        move = (ends - starts > 1) & _PUNCT[w.data[np.minimum(starts, len(w.data) - 1)]] if len(starts) else np.zeros(0, bool)
        starts[move] += 1
        move = (ends - starts > 1) & _PUNCT[w.data[ends - 1]] if len(starts) else move
        ends[move] -= 1
    own = W.hashes(W.Words(W.LOWER[w.data], w.offsets, starts, ends, w.first))
    if not len(own):
        return own, own, np.zeros(0, bool), w.first
    sums = lambda flag: np.concatenate(([0], np.cumsum(flag[w.data])))
    digits, numeric = sums(_DIGIT), sums(_NUMERIC)
    number = (digits[ends] > digits[starts]) & (numeric[ends] - numeric[starts] == ends - starts) | np.isin(own, _NUMBERS)
    at = np.minimum(np.searchsorted(_UNITS, own), len(_UNITS) - 1)
    unit = np.zeros(len(own), bool)
    unit[1:] = number[:-1] & (_UNITS[at[1:]] == own[1:])
    opens = np.ones(len(own), bool)
    opens[1:] = _STOP[w.data[w.ends[:-1] - 1]] | (w.data[w.starts[1:] - 1] == 10)
    opens[w.first[:-1][np.diff(w.first) > 0]] = True
    unit[w.first[:-1][np.diff(w.first) > 0]] = False
    name = _UPPER[w.data[starts]] & ~opens & (ends - starts > 1)
    out = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, own)))
    return out, own, number | unit | name, w.first


def windows(texts: DataFrame, key: str, text_col: str, size: int, only: DataFrame | None = None) -> DataFrame:
    """Columns key, pos, n, h, words (array of structs: own, the hash of each word in the window; slot); n: words of the text. only: (h), windows to keep.

    Each window comes with the hash of its own words, and if it has slots and MIN_PLAIN plain
    words once more with that of its template. A text of fewer than `size` words is one window.
    """
    local = None
    if only is not None:
        only = only.select("h").distinct()
        if only.count() <= LOCAL_WINDOWS:
            local = np.sort(np.array([r.h for r in only.collect()], np.int64).view(np.uint64))
    sent = texts.sparkSession.sparkContext.broadcast(local)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            for row, part in W.runs(batch.column(1)):
                words, own, slot, first = template(part)
                n = np.diff(first)
                slots = np.concatenate(([0], np.cumsum(slot)))
                for kind in (own, words):
                    at, h = W.windows(kind, first, size)
                    for k in np.flatnonzero((n > 0) & (n < size)):
                        at = np.append(at, first[k])
                        h = np.append(h, W.windows(kind, first[k : k + 2], int(n[k]))[1])
                    doc = np.searchsorted(first, at, "right") - 1
                    ends = np.minimum(at + size, first[doc + 1])
                    keep = np.ones(len(at), bool)
                    if kind is words:
                        h = W.mix(h ^ TEMPLATE)
                        n_slots = slots[ends] - slots[at]
                        keep = (n_slots > 0) & ((ends - at) - n_slots >= np.minimum(MIN_PLAIN, ends - at))
                    if wanted is not None:
                        found = np.searchsorted(wanted, h)
                        keep &= (wanted[np.minimum(found, len(wanted) - 1)] == h) if len(wanted) else False
                    at, h, doc, ends = at[keep], h[keep], doc[keep], ends[keep]
                    each = np.concatenate([np.arange(0), *map(np.arange, at, ends)])
                    values = pa.StructArray.from_arrays([pa.array(own[each].view(np.int64)), pa.array(slot[each])], ["own", "slot"])
                    values = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(ends - at))), pa.int32()), values)
                    ids = batch.column(0).take(pa.array(row + doc))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(at - first[doc], pa.int64()), pa.array(n[doc], pa.int64()), pa.array(h.view(np.int64)), values], [key, "pos", "n", "h", "words"])

    rows = texts.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.col(key).isNotNull())
    found = rows.mapInArrow(work, f"{key} long, pos long, n long, h long, words array<struct<own:long,slot:boolean>>")
    return found if only is None or local is not None else found.join(only, "h", "left_semi")


def _near_enough(found: DataFrame, item: DataFrame) -> DataFrame:
    """found with near: how many words around a window lie in windows that any item has; without windows that have fewer than their least demanding item needs.

    A passage lies on one diagonal, so within the length of its item, and its words lie in such
    windows. So nothing is lost, and an opening that many documents share with many items, but
    too short for a passage, goes before documents meet items in it.
    """
    longest = item.agg(F.max("len")).first()[0] or 1
    covered = found.select("doc_id", F.explode(F.sequence("pos", F.col("pos") + F.size("words") - 1)).alias("word")).distinct()
    block = lambda c: F.floor(F.col(c) / longest)
    counts = covered.groupBy("doc_id", block("word").alias("b")).agg(F.count("*").alias("c"))
    # a passage from a word of one block ends in it or in the next
    near = counts.select("doc_id", F.explode(F.array(*[F.col("b") + d for d in (-1, 0, 1)])).alias("b"), "c").groupBy("doc_id", "b").agg(F.sum("c").alias("near"))
    needs = item.groupBy("h").agg(F.min("need").alias("least"))
    rows = found.withColumn("b", block("pos")).join(near, ["doc_id", "b"]).join(needs, "h")
    return rows.where("near >= least").drop("b", "least")


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item it leaks: doc_id, item_id, n_words (covered words of the item), n_slots (slot values seen), exact (all covered words are the item's own).

    Null or empty texts leak nothing; rows with a null id are left out; rows that share an id are
    one document, repeated rows among them. An item of fewer than `size` words is one window and must
    be met whole; a very long text is worked on whole. Other columns are ignored, whatever their
    names; an empty table of either kind gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    item = windows(items, "item_id", "text", size).select("item_id", F.col("pos").alias("at"), F.col("n").alias("len"), "h", F.col("words").alias("item_words"))
    # what a passage of the item must cover at least
    item = item.withColumn("need", F.least(F.lit(float(min_words)), min_share * F.col("len")))
    found = _near_enough(cut(windows(docs, "doc_id", "text", size, item)), item)
    alike = ((F.col("len") >= size) | (F.col("len") == F.col("n"))) & (F.col("near") >= F.col("need")) & (F.size("words") == F.size("item_words"))
    met = found.join(item, "h").where(alike).withColumn("diagonal", F.col("pos") - F.col("at"))
    # few windows meet; written, they are found once for the steps below
    met = cut(met.select("doc_id", "item_id", "diagonal", "len", "at", "item_words", "words"))
    passage = ["doc_id", "item_id", "diagonal"]
    each = met.select(*passage, "len", "at", F.posexplode(F.arrays_zip("item_words", "words")).alias("k", "p"))
    each = each.select(*passage, "len", (F.col("at") + F.col("k")).alias("at"), F.col("p.item_words.slot").alias("slot"), F.col("p.item_words.own").alias("x"), F.col("p.words.own").alias("y"))
    each = each.repartition(*passage).groupBy(*passage, "at", "x", "y").agg(F.first("len").alias("len"), F.bool_or("slot").alias("slot"))
    alike = Window.partitionBy(*passage, "slot", "x", "y")
    each = each.withColumn("often", F.count("*").over(alike)).withColumn("since", F.min("at").over(alike))
    usual = F.first("y").over(Window.partitionBy(*passage, "slot", "x").orderBy(F.desc("often"), "since", "y"))
    each = each.withColumn("odd", (F.col("y") != usual).cast("int"))
    each = each.withColumn("part", F.sum("odd").over(Window.partitionBy(*passage).orderBy("at"))).withColumn("split", F.max("odd").over(Window.partitionBy(*passage)))
    parts = each.where("odd = 0").groupBy(*passage, "part").agg(
        F.count_distinct("at").alias("n_words"),
        F.count_distinct(F.when(~F.col("slot"), F.col("at"))).alias("n_plain"),
        F.count_distinct(F.when(F.col("slot"), F.struct("x", "y"))).alias("n_slots"),
        F.bool_and(F.col("x") == F.col("y")).alias("exact"),
        F.max("split").alias("split"),
        F.first("len").alias("len"),
    )
    counted = F.when(F.col("split") == 1, F.col("n_plain")).otherwise(F.col("n_words"))
    kept = parts.where((counted >= min_words) | (counted >= min_share * F.col("len")))
    return kept.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("n_slots").alias("n_slots"), F.max("exact").alias("exact"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that leak no item; a row with a null id is judged by its own text, rows that share an id as one document.

    All columns stay, whatever their names; null and empty texts stay.
    """
    named, bare = docs.where(F.col(id_col).isNotNull()), docs.where(F.col(id_col).isNull())
    ids = lambda found: cut(found.select("doc_id").distinct())
    leaked = ids(leaks(named, benchmark, id_col=id_col, item_col=item_col, text_col=text_col)).withColumnRenamed("doc_id", id_col)
    kept = named.join(leaked, id_col, "left_anti").select(*docs.columns)
    if bare.isEmpty():
        return kept
    texts = bare.select(F.xxhash64(text_col).alias("doc_id"), F.col(text_col).alias("text"))
    hashes = ids(leaks(texts, benchmark, item_col=item_col))
    return kept.unionAll(bare.join(hashes, F.xxhash64(bare[text_col]) == hashes["doc_id"], "left_anti").select(*docs.columns))
