"""URL verdicts against a plain loop over the list."""

import random

import pytest
from pyspark.sql import functions as F

from poolsight.llm import url_filter
from poolsight.llm.url_filter import Listed, filter_urls

LISTED = "host string, path string, verdict string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:end]


def judge(url, listed):
    host, path = parts(url)
    best = None
    for h, p, v in listed:
        h, p = "".join(c.lower() if "A" <= c <= "Z" else c for c in h or ""), p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or ((-1, -1), "", ""), ((len(h) + len(p), len(h)), v or "", h + p))
    return (host, path, best[2], best[1]) if best else (host, path, None, "allow")


def addresses(rng, n):
    hosts = ["a.org", "b.a.org", "A.Org", "xa.org", "org", "shop.de", "deep.er.shop.de", "a..org", "", "org.", "ü.org", "h:80"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/xy", "/é/1", "//", "?q=://z/x", "#f", "/x?y#z", "/x\n/y"]
    out = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(n)]
    return [*out, None, "", "no scheme", "mailto:x", "://", "http:///x", "http://a.org/" + "y" * 200_000, "http://" + "d." * 50_000 + "org/x"]


def rules(rng, n):
    hosts = ["org", "a.org", "b.a.org", "shop.de", "er.shop.de", "A.ORG", ".org", "org.", "d.org", "ü.org", None, ""]
    return [(rng.choice(hosts), rng.choice(["", "/", "/x", "/x/", "/xy", "/é", None]), rng.choice(["allow", "block"])) for _ in range(n)]


@pytest.mark.parametrize("broadcast", [500_000, 0])
@pytest.mark.parametrize("n", [0, 1, 40])
def test_as_a_plain_loop(spark, monkeypatch, n, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_KEYS", broadcast)
    rng = random.Random(n)
    urls, listed = addresses(rng, 150), rules(rng, n)
    urls += urls[:20]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = filter_urls(pages, spark.createDataFrame(listed, LISTED)).orderBy("page_id").collect()
    assert [(r["__host"], r["__path"], r["__rule"], r["__verdict"]) for r in got] == [judge(u, listed) for u in urls]
    assert {r["verdict"] for r in got} == {"own"}


def test_empty_and_clashing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, host string, __end string, __host string, __row long")
    out = filter_urls(pages, spark.createDataFrame([], LISTED))
    assert out.columns == ["page_id", "url", "host", "__end", "__host", "__path", "__rule", "__verdict"] and out.count() == 0
    some = spark.createDataFrame([(None, "http://a.org/x", "own", "e", "h", 7)], pages.schema)
    row = filter_urls(some, spark.createDataFrame([("org", "/", "block")], LISTED)).first()
    assert (row["host"], row["__end"], row["__host"], row["__rule"]) == ("own", "e", "a.org", "org/")


def test_the_filter_loses_nothing_and_drops_most(spark):
    """Every listed key passes; of others at most a few in a hundred do, also where blocks are short of bits."""
    listed = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("key"))
    made = Listed(listed, "key")
    assert made.possible(listed).count() == 20_000
    assert made.possible(others).count() < 600


def test_a_full_filter_is_still_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", 1)
    listed = spark.range(3_000).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(6_000).select("id", F.concat(F.lit("http://www.h"), "id", F.lit("/p")).alias("url"))
    out = filter_urls(pages, listed).groupBy("__verdict").count().collect()
    assert {r[0]: r[1] for r in out} == {"block": 3_000, "allow": 3_000}


def test_plan_is_native(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    listed = spark.sql(f"SELECT * FROM VALUES {url_filter.RULES} AS t(host, path, verdict)")
    plan = filter_urls(pages, listed)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "ExistingRDD", "NestedLoop", "Cartesian"))
