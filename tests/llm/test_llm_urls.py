"""URL parts, rules and models against plain Python."""

import math
import random
from collections import Counter, defaultdict

from parley.llm.urls import ALPHABET, Rule, filter_urls, learned, parts, ruled, scores, threshold
from pyspark.sql import functions as F

RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def rule_of(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.host + r.path), default=None)
    return (best.host + best.path, best.verdict) if best else (None, None)


def test_parts_and_rules(spark):
    urls = [None, "", "no scheme/en/", "http://", "http://A.Example.NET/en/x?q#f", "https://net", "https://net/", "x://badnet/", "http://org/fr/",
            "http://a.org/fr", "http://ex.com://y/z", "http://e.example.com/de/?a=/en/", "http://example.net?x=/en/", "http://É.Org/fr/\nx",
            "http://h#f/a?b", "ftp://net/EN/", "http://example.net/en"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path, _ = parts(F.col("url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), RULES)
    got = df.select("url", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "verdict": verdict}).collect()
    for r in got:
        assert (r.host, r.path) == split(r.url), r.url
        assert (r.rule, r.verdict) == rule_of(r.host, r.path), r.url


def plain_model(texts, order):
    grams, followers, totals = Counter(), defaultdict(set), Counter()
    for text in texts:
        padded = ["^"] * order + list(text) + ["$$"]
        for i in range(order, len(padded)):
            for k in range(order + 1):
                context = tuple(padded[i - k : i])
                grams[context, padded[i]] += 1
                followers[context].add(padded[i])
                totals[context] += 1

    def log_likelihood(text):
        padded, total = ["^"] * order + list(text) + ["$$"], 0.0
        for i in range(order, len(padded)):
            p = 1 / ALPHABET
            for k in range(order + 1):
                context = tuple(padded[i - k : i])
                if totals[context]:
                    kinds = len(followers[context])
                    p = (grams[context, padded[i]] + kinds * p) / (totals[context] + kinds)
            total += math.log(p)
        return total / (len(text) + 1)

    return log_likelihood


def test_scores_are_those_of_the_plain_model(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice("ab/") for _ in range(rng.randint(1, 9))), "allow") for _ in range(60)]
    rows += [("".join(rng.choice("bc/é") for _ in range(rng.randint(1, 9))), "block") for _ in range(60)]
    df = spark.createDataFrame(rows, "text string, verdict string").repartition(3)
    models = learned(df, order=3)
    allow, block = (plain_model([t for t, v in rows if v == verdict], 3) for verdict in ("allow", "block"))
    texts = ["ab/ba", "cc", "é", "z", "a" * 3000, ""]
    for text, got in zip(texts, scores(models, texts, 3)):
        assert math.isclose(got, allow(text) - block(text) if text else 0.0, abs_tol=1e-9), text
    small = learned(df, order=3, size=20)  # runs that a small model lacks are judged by shorter ones
    assert all(math.isfinite(x) for x in scores(small, texts, 3))


def test_threshold():
    assert threshold([]) == 0.0 and threshold([(5, "allow", 3)]) == 0.0
    assert threshold([(100, "allow", 5), (40, "allow", 1), (10, "block", 9), (-300, "block", 2)]) == 0.4
    assert threshold([(10, "allow", 5), (-10, "block", 5)]) == 0.0


def test_filter(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    extra = spark.createDataFrame([(-1, None, "x"), (None, "", None), (-3, "http://a.net/" + "x" * 100_000, ""), (-3, "http://a.net/" + "x" * 100_000, "")], pages.schema)
    pages = pages.unionByName(extra).withColumn("host", F.lit(1)).withColumn("score", F.lit("s"))
    out = filter_urls(pages, RULES)
    rows = out.collect()
    assert len(rows) == pages.count()
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in rows:
        assert (r.host, r.path) == split(urls[r.page_id])
        rule, verdict = rule_of(r.host, r.path)
        assert r.rule == rule and r.verdict == (verdict or ("allow" if r.score >= r.threshold else "block"))
    assert {r.verdict for r in rows if r.rule is None} == {"allow", "block"}
    assert filter_urls(pages.limit(0), RULES).count() == 0
    alone = filter_urls(pages.filter("page_id < 0"), ()).collect()  # nothing to learn from
    assert {r.verdict for r in alone} == {"allow"}


def test_no_run_is_left_out(spark):
    """Scores and verdicts are those of all runs, however few of them a task holds."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    whole = {r.page_id: r for r in filter_urls(pages, RULES).collect()}
    assert len(whole) > 100 and any(r.score for r in whole.values())
    for size in (0, 50):
        for r in filter_urls(pages, RULES, size=size).collect():
            assert math.isclose(r.score, whole[r.page_id].score, abs_tol=1e-9)
            assert (r.verdict, r.threshold) == (whole[r.page_id].verdict, whole[r.page_id].threshold)
