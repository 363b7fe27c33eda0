import random

from pyspark.sql import functions as F

from posthorn.llm import url_filters as u

SCHEMA = "page_id long, url string, host string, key string"
URLS = [
    None, "", "no scheme", "http://", "HTTPS://WWW.Spam-Farm.example.net", "http://spam-farm.example.net?x=/es/", "https://x.example.org/en/1a",
    "https://example.org/en/2", "https://badexample.org/es/1", "https://example.org/es/1?q#f", "http://a.com/fr/", "http://a.com/de/x#y", "http://com/de/",
    "http://a.net/p?u=http://b.org/es/", "ftp://a.net:8080/x", "http://ÄB.example.com/É", "x://a.org", "http://casino-win.example.com/fr/1", "a://b\nc.net/d\ne",
]


def brute(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(len(r), v, r) for v, r in u.RULES if under(r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
    bad = any(under(k) for k in listed)
    verdict, rule = max(fits)[1:] if fits else ("block" if bad else "allow", None)
    return host, path, rule, verdict, bad


def test_matches_brute_force(spark):
    rows = [(i, x, "clash", "clash") for i, x in enumerate(URLS)] + [(None, URLS[4], "", ""), (3, "http://", "", "")]
    got = u.judge(spark.createDataFrame(rows, SCHEMA), u.listed_frame(spark)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r[0], *brute(r[1], u.LISTED))) for r in rows)


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(u, "BITS_PER_KEY", 3)  # many false positives, so many levels
    rng = random.Random(1)
    keys = [f"h{i}.example" for i in range(3000)]
    listed = set(rng.sample(keys, 700)) | {"absent"}
    every = spark.createDataFrame([(k,) for k in keys], "key string")
    levels = u.cascade(every, u.listed_frame(spark, tuple(sorted(listed))))
    assert len(levels) > 2
    got = {r.key: r.b for r in every.select("key", u.is_listed(levels, every["key"]).alias("b")).collect()}
    assert got == {k: k in listed for k in keys}


def test_empty_lists_and_tables(spark):
    df = spark.createDataFrame([(i, x, "", "") for i, x in enumerate(URLS)], SCHEMA)
    none = u.judge(df, u.listed_frame(spark).limit(0)).collect()
    assert not any(r.listed for r in none)
    assert u.judge(df.limit(0), u.listed_frame(spark)).collect() == []


def test_a_list_of_a_million_keys(spark):
    n = 1_000_000
    hosts = spark.range(2 * n).select(F.concat(F.lit("h"), F.col("id"), F.lit(".example")).alias("host"), "id")
    pages = hosts.select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), "host", F.lit("/x")).alias("url"))
    listed = hosts.where("id % 2 = 0").select(F.col("host").alias("key"))
    levels = u.cascade(u.universe(hosts), listed)
    assert sum(len(x.bits) for x in levels) < 1.2 * n and len(levels[0].bits) == n
    wrong = u.judge(pages, listed).where((F.col("verdict") == "block") != (F.col("page_id") % 2 == 0))
    assert wrong.count() == 0


def test_plan_is_native(spark):
    plan = u.judge(spark.createDataFrame([(1, "http://a.b/c", "", "")], SCHEMA), u.listed_frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
