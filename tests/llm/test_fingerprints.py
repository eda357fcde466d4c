import hashlib
import random

import pyarrow as pa

from shorecover.llm import exchange, fingerprints


def rows_of(n, seed=4):
    rng = random.Random(seed)
    words = [f"w{k}é" for k in range(500)]
    base = [[rng.choice(words) for _ in range(rng.choice([2, 30, 120]))] for _ in range(n // 3)]
    return [(k * 3 % 1009, " ".join(base[k % len(base)])) for k in range(n)]


def test_edited_by_definition(spark):
    rows = rows_of(90) + [(2000, None), (2001, ""), (2002, "x"), (2003, "a b " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as g")
    was, exchange.grouped.__defaults__ = exchange.grouped.__defaults__, ("doc_id", "text", 3000)
    try:
        got = {r.doc_id: r for r in fingerprints.digest(fingerprints.edited(df)).collect()}
    finally:
        exchange.grouped.__defaults__ = was
    ordered = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        jaccard = lambda a, b: len(a & b) / max(1, len(a | b))
        sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := x.split()) else set() for x in (t, new, after)]
        assert abs(got[i].near_edited - (jaccard(sets[0], sets[1]) if sets[0] | sets[1] else 1)) < 0.25
        assert abs(got[i].near_next - (jaccard(sets[0], sets[2]) if sets[0] | sets[2] else 1)) < 0.25
    assert len({got[i].fingerprint for i, _ in rows}) == len({t or "" for _, t in rows})
    assert fingerprints.edited(df.limit(0)).count() == 0 and fingerprints.edited(df.limit(1)).count() == 1


def test_signature_by_definition():
    text = " ".join(f"v{k * k % 37}" for k in range(60))
    texts = pa.array([text], pa.large_string())
    h, _ = fingerprints.shingles(texts)
    least = [min(((int(x) * int(a) + int(b)) % 2**64) >> 32 for x in h) & 0xFFFF for a, b in zip(fingerprints._A, fingerprints._B, strict=True)]
    assert fingerprints.signatures(texts)[0].tolist() == least
    w = text.split()
    assert len(set(h.tolist())) == len({tuple(w[k : k + 5]) for k in range(len(w) - 4)})


def test_near_duplicates_of_shared_and_null_ids(spark):
    """Near copies whose ids are null or shared with other texts are verified by their own shingles."""
    rng = random.Random(5)
    base = [[f"t{rng.randrange(9000)}" for _ in range(150)] for _ in range(3)]
    near = [" ".join([*w[:-1], "changed"]) for w in base]
    rows = [(7, " ".join(base[0])), (7, " ".join(base[1])), (8, near[0]), (9, near[1]), (None, " ".join(base[2])), (None, near[2]), (None, near[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as s", "3 as class_id")
    got = sorted(((r.doc_id or -1, r.class_id or -1, r.n_links) for r in fingerprints.near_duplicates(df).collect()))
    assert got == [(-1, -1, 1)] * 3 + [(7, 7, 1)] * 2 + [(8, 7, 1), (9, 7, 1)]
    assert fingerprints.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(9)
    rows = []
    for k in range(20):
        w = [f"t{rng.randrange(5000)}" for _ in range(200)]
        for c in range(4):
            v = list(w)
            if c:
                v[rng.randrange(200)] = "changed"
            rows.append((10 * k + c, " ".join(v)))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (902, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.class_id) for r in fingerprints.near_duplicates(df).collect()}
    want = {(10 * k + c, 10 * k) for k in range(20) for c in range(4)} | {(900, 900), (901, 900), (None, 0), (902, 10)}
    assert got == want
