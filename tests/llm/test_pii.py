import hashlib
import random
import re

from shorecover.llm import pii


def by_definition(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_by_definition():
    rng = random.Random(1)
    for _ in range(30_000):
        text = "".join(rng.choice(["a", "b.", "@", "@", ".", "-", " ", "0", "256", "255", "4055105915866795", "+1", "(", ")", "é", "٣", "x@y.z", "+", "%"]) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == by_definition(text), text


def test_more_spans_and_redaction():
    text = "Call (727) 555-6430 or IBAN DE89 3704 0044 0532 0130 00 now; joe [at] mail [dot] org, 123-45-6789, isbn 978-030-4061; after that a good deal of other words: 4055.1059.1586.6795"
    found = pii._spans(text, 0.5)
    assert {(s["kind"], text[s["start"] : s["end"]]) for s in found} == {("phone", "(727) 555-6430"), ("iban", "DE89 3704 0044 0532 0130 00"), ("email", "joe [at] mail [dot] org"), ("ssn", "123-45-6789"), ("card", "4055.1059.1586.6795")}
    assert pii.redacted(text, found).startswith("Call [PHONE] or IBAN [IBAN] now; [EMAIL], [SSN], isbn")
    assert not pii._spans("DE89 3704 0044 0532 0130 01 and 4055105915866796", 0.5)


def test_rows(spark):
    rows = [(1, "a@b.co 10.0.0.1"), (2, None), (3, ""), (None, "+1 (727) 555-6430"), (1, "a@b.co 10.0.0.1"), (4, "9" * 3000), (5, "x" * 100_000 + "@"), (6, "ß" * 5 + "me@x.de")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as n_email")
    got = sorted((tuple(r) for r in pii.digest(pii.find_pii(df)).collect()), key=str)
    want = []
    for i, t in rows:
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in by_definition(t))
        n = [sum(k == kind for k, _, _ in by_definition(t)) for kind in pii.KINDS[:4]]
        want.append((i, *n, hashlib.sha256(spans.encode()).hexdigest(), spans))
    assert got == sorted(want, key=str)
    assert pii.redact(df).where("doc_id = 1").first().text == "[EMAIL] [IP]"
    assert pii.find_pii(df.limit(0)).count() == 0


def test_a_long_text_of_many_spans():
    """Two million characters of phone numbers take seconds."""
    import time

    text = "call (212) 555-0198 or +1 212 555 0142 now " * 50_000
    began = time.time()
    spans = pii._spans(text, 0.5)
    assert len(spans) >= 100_000 and time.time() - began < 40
    assert all(a["end"] <= b["start"] for a, b in zip(spans, spans[1:]) if a["kind"] == b["kind"])
