"""PII: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Four base kinds are found leftmost and non-overlapping, each by its own pattern; a match that
fails its check is dropped and not retried. Further spans come from patterns that alone are too
weak (national phone numbers, IBAN, social security numbers, spelled-out addresses): each has a
prior, a checksum or shape test, and words near it raise or lower the score; those of at least
`min_score` that overlap no base span are added.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import runs

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: Possessive parts and the look-behind only save retries that can't succeed.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?<![\w.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![\w-])")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SPELLED = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(] ?(?:dot|DOT) ?[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,5}")
_DOTTED = re.compile(r"(?<![0-9])[0-9](?:[./_\x20-]{0,2}[0-9]){12,18}(?![0-9])")
_WORDS = re.compile(r"[a-z]+")
#: Words that speak for a kind within CONTEXT characters before a span, and words that speak against any.
FOR = {
    "email": {"mail", "email", "contact", "write"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "payment", "pan"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "contact"},
    "iban": {"iban", "account", "bank", "transfer"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
}
AGAINST = {"isbn", "issn", "version", "order", "invoice", "serial", "sku", "part", "build", "doi"}
CONTEXT = 48


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one "@", so it is enough to look around each: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind as listed, then start; offsets in code points, end exclusive."""
    found = [("email", a, b) for a, b in emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def _score(text: str, kind: str, start: int, prior: float) -> float:
    near = set(_WORDS.findall(text[max(0, start - CONTEXT) : start].lower()))
    return min(1.0, max(0.0, prior + 0.3 * bool(near & FOR.get(kind, set())) - 0.4 * bool(near & AGAINST)))


def more_spans(text: str, base: list[tuple[str, int, int]], min_score: float = 0.5) -> list[tuple[str, int, int, float]]:
    """Spans beyond the base ones, with scores."""
    found = []
    if any("0" <= c <= "9" for c in text) or "[" in text or "(" in text:
        for m in _NATIONAL.finditer(text):
            found.append(("phone", *m.span(), 0.6 if m[0][0] == "(" else 0.5))
        for m in _SSN.finditer(text):
            found.append(("ssn", *m.span(), 0.6))
        for m in _IBAN.finditer(text):
            value = m[0].replace(" ", "")
            while len(value) > 15 and not mod97(value):
                value = value[:-1]
            if 15 <= len(value) <= 34 and mod97(value):
                end, left = m.start(), len(value)
                while left:
                    left -= text[end] != " "
                    end += 1
                if end == m.end() or not text[end].isalnum():
                    found.append(("iban", m.start(), end, 0.9))
        for m in _DOTTED.finditer(text):
            if luhn(_digits(m[0])):
                found.append(("card", *m.span(), 0.5))
        for m in _SPELLED.finditer(text):
            found.append(("email", *m.span(), 0.7))
    starts, ends = _union((a, b) for _, a, b in base)
    out = []
    for kind, a, b, prior in sorted(found, key=lambda x: (-x[3], x[1])):
        score = _score(text, kind, a, prior)
        at = bisect_right(starts, a)
        free = (at == 0 or ends[at - 1] <= a) and (at == len(starts) or starts[at] >= b)
        if score >= min_score and free:
            starts.insert(at, a)
            ends.insert(at, b)
            out.append((kind, a, b, score))
    return out


def _union(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the intervals that the spans cover, ascending."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if starts and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])


def _spans(text: str, min_score: float) -> list[dict]:
    base = base_spans(text)
    every = [(k, a, b, min(1.0, _score(text, k, a, 0.9)), True) for k, a, b in base] + [(*x, False) for x in more_spans(text, base, min_score)]
    return [dict(zip(("kind", "start", "end", "score", "base"), x, strict=True)) for x in sorted(every, key=lambda x: (KINDS.index(x[0]), x[1]))]


def redacted(text: str, spans: list[dict]) -> str:
    """The text with each span, overlapping ones as one, replaced by the kind of the first in brackets."""
    parts, done = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= done:
            parts += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
        done = max(done, s["end"])
    return "".join([*parts, text[done:]])


def find_pii(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, spans: array of (kind, start, end, score, base) by kind as in KINDS, then start.

    A null or empty text has no spans. One row for each input row, repeated ones included; other
    columns are ignored; an empty table gives none. Of candidates that overlap the likelier stays,
    of equally likely ones the first. A very long text takes about linear time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in runs(batch.column(1)):
                spans = pa.array([_spans(t, min_score) for t in texts.to_pylist()], pa.list_(_SPAN))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), spans], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double, base: boolean>>")


def redact(docs: DataFrame, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The columns of docs, with personal data in the text replaced by its kind; a null text stays null.

    One row for each input row, repeated ones included, whatever its other columns are named; an
    empty table stays empty. Of a text of any length all spans are found, in about linear time.
    """
    schema = docs.schema
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, _spans(t, min_score)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(work, schema)


def digest(found: DataFrame) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
