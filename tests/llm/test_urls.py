import math
import re

from pyspark.sql import functions as F

from shorecover.llm import urls

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def by_definition(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(r, v) for r, v in RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *max(fit, key=lambda x: len(x[0]), default=(None, None))


def test_rules_and_edges(spark):
    given = ["http://a.net/x", "https://EXAMPLE.net/en/1", "https://m.example.net/en", "http://x.example.com/de/1?q=a://b", "http://badexample.com/de/", "http://b.org/fr/?a=1", "http://b.org/fr", "net/", "", None, "http://", "://x.org/fr/#", "http://net", "http://net/", "x" * 50_000, "http://É.net/ü#://", "http://a.com\n/b", "http://casino-win.example.com/en/1"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(given)], "page_id long, url string").selectExpr("*", "1 as rule", "2 as host", "'x' as html")
    model = urls.fit(urls.seed_labels(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")))
    got = urls.judge(df, model, RULES).orderBy("page_id").collect()
    for r, u in zip(got, given, strict=True):
        host, path, rule, verdict = by_definition(u)
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert urls.judge(df.limit(0), model, RULES).count() == 0


def test_features_by_definition(spark):
    given = ["http://a-b.example.net/x/y?p=1&q=22#z=3", "https://EXAMPLE.org", "", None, "no scheme 12", "ftp://a..b./?=", "http://aab.de/é/1"]
    df = spark.createDataFrame([(u,) for u in given], "url string")
    for r in urls.with_features(df, {"net": 0.75, "": 0.5}, 0.25).collect():
        url = r.url or ""
        host, path, _, _ = by_definition(r.url)
        query = re.search(r"\?([^#]*)", url)
        labels = host.split(".")
        shares = [host.count(c) / len(host) for c in set(host)]
        want = [len(url), len(host), len(path), len(labels), path.count("/"), len(re.findall("[0-9]", url)) / max(1, len(url)), -sum(s * math.log2(s) for s in shares)]
        want += [query[1].count("=") if query else 0, host.count("-"), max(map(len, labels)), {"net": 0.75, "": 0.5}.get(labels[-1], 0.25)]
        assert list(r["__x"].asDict()) == urls.FEATURES
        assert all(abs(a - b) < 1e-9 for a, b in zip(r["__x"], want, strict=True)), r.url


def test_repeated_pages(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (2, None), (2, None)], "page_id long, url string")
    got = urls.judge(df, urls.UrlFilter(None, {}, 0.2), RULES).collect()
    assert sorted((r.page_id, r.verdict) for r in got) == [(1, "block"), (1, "block"), (2, "allow"), (2, "allow")]


def test_held_out_hosts(spark):
    """Trained without one of the seed terms, the trees still find its urls."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labelled = urls.seed_labels(pages).where(~F.col("url").contains("casino"))
    model = urls.fit(labelled)
    got = model.with_score(pages).select((F.col("score") >= 0.5).alias("p"), F.col("url").contains("casino").alias("held"), urls.seed_labels(pages).columns[0]).collect()
    held = [r.p for r in got if r.held]
    assert held and sum(held) / len(held) > 0.9
    clean = [r.p for r in got if not any(t in r.url for t in urls.SEED_TERMS)]
    assert sum(clean) / len(clean) < 0.02


def test_one_class(spark):
    df = spark.createDataFrame([("http://a.com/", 0)], "url string, label int")
    assert urls.fit(df).with_score(df).first().score < 0.5
    assert urls.fit(df.limit(0)).prior == 0.5
