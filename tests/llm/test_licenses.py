import time

import duckdb
import pyarrow as pa

from shorecover.llm import license_texts, licenses

FILL = "plain words about nothing much at all "


def test_planted(spark):
    rows = [(1, FILL * 9 + "Licensed under the Apache License, Version 2.0.\n" + FILL), (2, "RELEASED under the MIT license!"), (3, FILL * 40), (4, None), (5, ""), (6, "mit"), (7, FILL * 3000 + "licensed under CC BY-NC 4.0"), (None, "Released under the MIT License."), (8, "This work is licensed under the GNU General Public License, version 3. " * 2), (2, "Released under the MIT License"), (9, "Licensed under the Apache Software Licence number two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as license", "2 as w", "3 as b", "4 as s", "5 as value", "6 as k", "7 as h")
    got = {(r.doc_id, r.license) for r in licenses.scan(df).collect()}
    assert got == {(1, "Apache-2.0"), (2, "MIT"), (7, "CC-BY-NC-4.0"), (None, "MIT"), (8, "GPL-3.0")}
    assert licenses.scan(df.limit(0)).count() == 0


def test_every_position(spark):
    rows = [(k, "x " * k + "Licensed under CC BY 4.0 " + "y " * 40) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in licenses.scan(df).where("license = 'CC-BY-4.0'").collect()} == set(range(40))


def test_whole_texts(spark):
    changed = license_texts.MIT.replace("the Software without restriction", "our programs without restriction")
    half = license_texts.MIT[: len(license_texts.MIT) // 2]
    rows = [(1, FILL * 50 + license_texts.MIT + FILL * 50), (2, changed), (3, half), (4, license_texts.GPL3 + license_texts.ISC), (5, license_texts.GPL3.replace("version 3 of", "version 2 of"))]
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (4, "GPL-3.0-or-later"), (4, "ISC")}
    assert got[1, "MIT"] == 1 and 0.9 < got[2, "MIT"] < 1


def test_own_templates_in_blocks_equal_sql(spark, monkeypatch):
    docs = [(k, FILL * (k % 4) + text[: len(text) * (k % 5 + 6) // 10] + " " + FILL) for k, (_, text) in enumerate(license_texts.TEMPLATES * 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    with duckdb.connect() as db:
        db.register("documents", pa.table({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs]}))
        want = sorted(db.execute(f"select doc_id, license, n_templates, containment from ({licenses.oracle()})").fetchall())
    for rows in (licenses.BLOCK_ROWS, 10_000):
        monkeypatch.setattr(licenses, "BLOCK_ROWS", rows)
        assert sorted(tuple(r) for r in licenses.scan(df).collect()) == want
    own = spark.createDataFrame([("own", "one two three four five six"), ("own", "one two three four five six"), ("short", "one two"), ("none", None)], "license string, text string")
    texts = spark.createDataFrame([(1, "zero one two three four five six seven"), (2, "one two three four five")], "doc_id long, text string")
    assert [tuple(r) for r in licenses.scan(texts, own).collect()] == [(1, "own", 1, 1.0)]
    assert licenses.scan(texts, own.limit(0)).count() == 0


def test_long_templates_take_linear_time(spark):
    long = " ".join(f"w{k * 7919 % 30011}" for k in range(30_000))
    texts = spark.createDataFrame([(1, FILL + long + " " + FILL), (2, long[:80_000]), (3, FILL)], "doc_id long, text string")
    began = time.time()
    assert [tuple(r) for r in licenses.scan(texts, spark.createDataFrame([("long", long)], "license string, text string")).collect()] == [(1, "long", 1, 1.0)]
    assert time.time() - began < 60


def test_bands_decide_what_is_counted(spark):
    """Every text that the exact count would accept is retrieved, and nearly none that shares no shingle with a template."""
    rows = [(k, f"a{k} " * (k % 5) + text + f" b{k}") for k, (_, text) in enumerate(license_texts.TEMPLATES * 6)] + [(1000 + k, FILL * 20 + str(k)) for k in range(50)] + [(None, license_texts.ISC)]
    bands, _ = licenses._known(licenses.standard_templates(spark))
    got = {r.doc_id for r in licenses.candidates(spark.createDataFrame(rows, "doc_id long, text string"), bands).collect()}
    assert got == {None, *range(6 * len(license_texts.TEMPLATES))}
