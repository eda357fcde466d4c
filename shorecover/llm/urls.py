"""URL filters: gradient-boosted trees on lexical features, under a list of rules.

Features are DataFrame expressions over the url: lengths, depth, digit ratio, entropy, parameter
counts, hyphens, and the share of blocked urls under its suffix in the training sample. The
trees are Spark ML's. A rule (host, path) that fits decides instead; the longest wins.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bound of the labelled sample, by smallest hash of the url, for each class.
SAMPLE = 2000
TREES, DEPTH = 15, 3
#: Terms whose urls are labelled as blocked for training, if no labels are given.
SEED_TERMS = ["adult", "casino", "bets", "pills", "spam"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case; empty for null or without "://"."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the end of the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_and_verdict(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. rules: (rule like "net/", verdict), a fixed list."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        own, slash, start = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + start)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _entropy(text: Column) -> Column:
    letters = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(F.filter(letters, lambda c: c != "")), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


FEATURES = ["len_url", "len_host", "len_path", "n_labels", "depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "longest_label", "suffix_share"]


def with_features(urls: DataFrame, suffixes: dict[str, float], prior: float, url_col: str = "url") -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    h, p = host(url), path(url)
    count = lambda text, what: (F.length(text) - F.length(F.translate(text, what, ""))).cast("double")
    labels = F.split(h, r"\.")
    known = F.create_map(*[F.lit(x) for pair in suffixes.items() for x in pair]) if suffixes else F.create_map(F.lit(""), F.lit(prior))
    each = {
        "len_url": F.length(url).cast("double"),
        "len_host": F.length(h).cast("double"),
        "len_path": F.length(p).cast("double"),
        "n_labels": F.size(labels).cast("double"),
        "depth": count(p, "/"),
        "digit_ratio": count(url, "0123456789") / F.greatest(F.length(url), F.lit(1)),
        "entropy": _entropy(h),
        "n_params": count(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "="),
        "n_hyphens": count(h, "-"),
        "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double"),
        "suffix_share": F.coalesce(F.try_element_at(known, F.element_at(labels, -1)), F.lit(prior)),
    }
    return urls.select("*", F.struct(*[v.alias(k) for k, v in each.items()]).alias("__x"))


class UrlFilter:
    """A model of blocked urls; None as trees: one class alone was seen and `prior` is its share."""

    def __init__(self, trees, suffixes: dict[str, float], prior: float):
        self.trees, self.suffixes, self.prior = trees, suffixes, prior

    def vectors(self, urls: DataFrame, url_col: str) -> DataFrame:
        rows = with_features(urls, self.suffixes, self.prior, url_col)
        flat = rows.select("*", *[F.col(f"__x.{k}").alias(f"__{k}") for k in FEATURES])
        return VectorAssembler(inputCols=[f"__{k}" for k in FEATURES], outputCol="__features").transform(flat)

    def with_score(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """urls and score: the probability that a url is to be blocked; null urls count as empty."""
        if self.trees is None:
            return urls.withColumn("score", F.lit(float(self.prior)))
        found = self.trees.transform(self.vectors(urls, url_col))
        return found.select(*urls.columns, vector_to_array("__probability")[1].alias("score"))


def seed_labels(urls: DataFrame, url_col: str = "url", terms: list[str] = SEED_TERMS) -> DataFrame:
    """Columns url, label: 1 if the host holds one of the terms, 0 otherwise; weak labels where none are given.

    A row for each url that is not null, repeated ones included; an empty url is a 0.
    """
    bad = F.lit(False)
    for term in terms:
        bad = bad | host(F.col(url_col)).contains(term)
    return urls.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), bad.cast("int").alias("label"))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> UrlFilter:
    """labelled: url, label (0 or 1). At most `sample` distinct urls of each class, by the smallest hash, fit the model.

    Null urls and other labels are left out; of several labels of a url the larger counts. Where but
    one class is left, or none, the score is the share of class 1 for every url.
    """
    ranked = labelled.where("url is not null and label in (0, 1)").groupBy("url").agg(F.max("label").alias("label"))
    chosen = [ranked.where(F.col("label") == y).orderBy(F.xxhash64("url"), "url").limit(sample).collect() for y in (0, 1)]
    rows = [(r.url, float(r.label)) for part in chosen for r in part]
    prior = (len(chosen[1]) + 1) / (len(rows) + 2)
    if not chosen[0] or not chosen[1]:
        return UrlFilter(None, {}, prior)
    data = labelled.sparkSession.createDataFrame(rows, "url string, label double").coalesce(1)
    suffix = F.element_at(F.split(host(F.col("url")), r"\."), -1)
    by = data.groupBy(suffix.alias("s")).agg(F.sum("label").alias("bad"), F.count("*").alias("n")).where("s is not null").collect()
    model = UrlFilter(None, {r.s: (r.bad + 10 * prior) / (r.n + 10) for r in by}, prior)
    trees = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=5)
    trees.setProbabilityCol("__probability").setRawPredictionCol("__raw").setPredictionCol("__prediction")
    vectors = model.vectors(data, "url").select("__features", "label").cache()
    model.trees = trees.fit(vectors)
    vectors.unpersist()
    return model


def judge(pages: DataFrame, model: UrlFilter, rules: list[tuple[str, str]], url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """pages and host, path, rule, verdict ("block" or "allow"), score; columns of pages by these names give way.

    A row for each page, repeated ones included. A null url counts as empty: no host, no path, no
    rule, a verdict by its score. Urls are read whole, of any length; an empty table stays empty.
    """
    given = pages.drop("host", "path", "rule", "verdict", "score")
    rows = given.select("*", host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rows = model.with_score(rows, url_col).withColumn("__rule", rule_and_verdict(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select(*given.columns, "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), own).alias("verdict"), "score")
