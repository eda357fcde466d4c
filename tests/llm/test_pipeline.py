"""The pipeline against plain Python over sf0.001, and its edge rows."""

import hashlib

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from shorecover.llm import decontamination, near_copies, pii, toxicity

DIR = "/root/testdata/sf0.001"


def test_against_plain_python(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    model = toxicity.train(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
    worst = lambda t: model.scores(max(model.decisions(sorted(u)), default=model.bias) if (u := toxicity.units(t)) else model.bias)
    kept = [d for d in docs if worst(d[1]) < 0.7]
    # links at 0.8 are all there but for the probability of a miss; no link is beyond the margin
    group = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame([d[:2] for d in kept], "doc_id long, text string")).collect()}
    sure, most = (dict(near_copies.brute_force([d[:2] for d in kept], margin=m)) for m in (0.0, near_copies.MARGIN))
    assert all(group[i] == group[sure[i]] and most[i] == most[group[i]] for i in group)
    kept = [d for d in kept if group[d[0]] == d[0]]
    bad = {r.doc_id for r in decontamination.leaks(spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long"), spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
    kept = [d for d in kept if d[0] not in bad]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d in kept:
        ids = t.encode(pii.redacted(d[1], pii._spans(d[1], 0.5)), add_special_tokens=False).ids
        want.append((d[0], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, DIR).collect()]
    assert sorted(got) == sorted(want) and 0 < len(got) < len(docs)


def test_stages_keep_columns_and_edge_rows(spark):
    rows = [(1, "a fine day", "en", "s", 10), (None, "x", None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (1, "a fine day", "en", "s", 10), (4, "a fine day", "de", "t", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, DIR)
        assert out.columns == df.columns and out.count() >= 3
        assert stage(spark, df.limit(0), DIR).count() == 0
    assert {(r.doc_id, r.text) for r in corpus_pipeline.STAGES[1][1](spark, df, DIR).collect()} == {(1, "a fine day"), (None, "x"), (2, None)}
