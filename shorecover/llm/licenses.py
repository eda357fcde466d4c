"""License scans in DataFrame functions alone.

Texts and templates are cut into overlapping windows of SIZE shingles (six words), texts at every
STRIDE-th word, templates at each. A window and a template share a band if the least shingle of a window
of either is the same under one of BANDS hashes: with a probability of their windows' Jaccard
likeness j, so all bands miss with (1 - j)^BANDS. The worst case is a template of one shingle, j = 1/2 and a miss
of 1e-6. Of two shingles a text's windows hold both or one each, and one of them is the least of its windows with a
probability of 2/3; from three on some window of a whole copy is the template's own, and each single shingle
agrees with a probability of 1/3 at least. Bands retrieve: only the documents whose windows share one
are read again, and only with the templates that they met, for an exact count. A match holds CONTAINMENT of the
template's distinct shingles, and of those with a number among their words, so that the version decides
between two templates that differ in it alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_texts
from .tables import cut

SHINGLE, SIZE, STRIDE, BANDS, CONTAINMENT = 5, 2, 2, 20, 0.8
#: About so many rows of bands or of shingles go to every task at once (about 50 MB); more are met in blocks.
BLOCK_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda's body would evaluate it at each step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(w: Column) -> Column:
    """The hash of each run of SHINGLE words; w must be bound by let(): a slice of a column copies the whole array."""
    n = F.size(w) - SHINGLE + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))).otherwise(F.array().cast("array<long>"))


def windows(s: Column, stride: int) -> Column:
    """(a, b): SIZE shingles each, the first repeated where the text ends; none without shingles. All shingles are in a window."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(s) - SIZE + stride - 1), F.lit(stride))
    cells = [lambda i, k=k: F.coalesce(F.get(s, i + k), F.get(s, i)) for k in range(SIZE)]
    return F.when(F.size(s) > 0, F.transform(starts, lambda i: F.struct(*[c(i).alias(name) for c, name in zip(cells, "ab", strict=True)])))


def band(w: str) -> Column:
    """The least value of a window's shingles under the hash of number k."""
    return F.least(*[F.xxhash64(F.col(f"{w}.{c}"), F.col("k")) for c in "ab"])


def standard_templates(spark: SparkSession) -> DataFrame:
    """Columns license, text: common notices and whole license texts by SPDX identifier."""
    return spark.createDataFrame(license_texts.TEMPLATES, "license string, text string")


def _known(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables, (t, value) of the bands of each template and (license, t, n, n_numbered, value, numbered) of its distinct shingles. The work follows a template's words."""
    one = templates.select("license", F.col("text").cast("string").alias("text")).distinct().withColumn("t", F.xxhash64("license", "text"))
    numbered = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))), lambda i: F.exists(F.slice(w, i, SHINGLE), lambda x: x.rlike("[0-9]")))
    s = let(words(F.col("text")), lambda w: F.when(F.size(w) >= SHINGLE, F.arrays_zip(shingles(w).alias("value"), numbered(w).alias("numbered"))))
    each = cut(one.select("license", "t", s.alias("p")).where("p is not null"))
    cells = each.select("t", F.explode(let(F.col("p.value"), lambda s: windows(s, 1))).alias("w")).select("*", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("k"))
    n_numbered = F.size(F.array_distinct(F.transform(F.filter("p", lambda p: p["numbered"]), lambda p: p["value"])))
    # counted before the rows are exploded: beside explode() Spark would count again for each row
    counted = each.select("license", "t", F.size(F.array_distinct("p.value")).alias("n"), n_numbered.alias("n_numbered"), "p")
    counted = counted.select("license", "t", "n", "n_numbered", F.explode("p").alias("p"))
    return cut(cells.select("t", band("w").alias("value")).distinct()), cut(counted.select("license", "t", "n", "n_numbered", "p.value", "p.numbered").distinct())


def _meet(values: DataFrame, known: DataFrame) -> DataFrame:
    """values joined with a table of templates on value, block by block. A row's block follows its value and template, so neither a long template nor a common value makes a large block."""
    blocks = -(-known.count() // BLOCK_ROWS)
    met = [values.join(F.broadcast(known.where(F.pmod(F.xxhash64("value", "t"), F.lit(blocks)) == k)), "value") for k in range(blocks)] or [values.join(known, "value")]
    return reduce(DataFrame.unionByName, met)


def candidates(docs: DataFrame, bands: DataFrame) -> DataFrame:
    """Columns doc_id, t: documents (doc_id, text) and the templates that share a band with one of their windows."""
    cells = let(words(F.col("text")), lambda w: let(shingles(w), lambda s: windows(s, STRIDE)))
    rows = docs.select("doc_id", F.explode_outer(cells).alias("w")).where("w is not null")
    keyed = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("k"))
    return _meet(keyed.select("doc_id", band("w").alias("value")), bands).groupBy("doc_id", "t").agg(F.lit(1).alias("one")).select("doc_id", "t")


def scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and license in it: doc_id, license, n_templates (found), containment (the highest).

    templates: columns license, text, of any length; those of fewer than SHINGLE words or of null are never
    found, repeated ones count once; standard_templates() by default. Shingles count anywhere in the
    document. A null, empty or short text holds none, rows with one id count together, a null id is an
    id, and very long texts are cut into windows like others. Other columns are ignored, whatever
    their names; an empty table of documents or templates gives no rows.
    """
    bands, known = _known(templates if templates is not None else standard_templates(docs.sparkSession))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    met = cut(candidates(texts, bands)).select(F.col("doc_id").alias("id"), F.col("t").alias("template"))
    again = texts.join(met.select("id").distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    values = again.select("doc_id", F.explode(let(words(F.col("text")), lambda w: F.array_distinct(shingles(w)))).alias("value"))
    each = _meet(values, known).groupBy("doc_id", "license", "t", "n", "n_numbered", "value", "numbered").agg(F.lit(1).alias("one"))
    held = each.groupBy("doc_id", "license", "t", "n", "n_numbered").agg(F.count("*").alias("c"), F.count_if(F.col("numbered")).alias("c_numbered"))
    full = held.where((F.col("c") / F.col("n") >= CONTAINMENT) & (F.col("c_numbered") >= CONTAINMENT * F.col("n_numbered")))
    found = full.join(met, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("template")), "left_semi")
    return found.groupBy("doc_id", "license").agg(F.count("*").alias("n_templates"), F.max(F.col("c") / F.col("n")).alias("containment"))


def oracle() -> str:
    """DuckDB SQL for scan() of documents, without bands: every shingle against every template."""
    lines = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in license_texts.TEMPLATES)
    cut_words = f"unnest(list_distinct(list_transform(range(1, greatest(1, len(w) - {SHINGLE - 2})), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')))) as s"
    return f"""
with v as (select distinct license, line, regexp_extract_all(lower(line), '[a-z0-9]+') as w from (values {lines}) v(license, line)),
t as (select license, line, {cut_words} from v),
n as (select license, line, count(*) as n, count(*) filter (where regexp_matches(s, '[0-9]')) as n_numbered from t group by license, line),
d as (select doc_id, {cut_words} from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from documents)),
m as (select doc_id, license, line, count(distinct s) as c, count(distinct s) filter (where regexp_matches(s, '[0-9]')) as c_numbered
  from d join t using (s) group by doc_id, license, line)
select doc_id, license, count(*) as n_templates, max(c / n) as containment
from m join n using (license, line) where c / n >= {CONTAINMENT} and c_numbered >= {CONTAINMENT} * n_numbered group by doc_id, license
"""
