from __future__ import annotations

import re

from pyspark.sql import functions as F

from tapewright.llm import url_filter as U
from tapewright.llm.queries import QUERIES, RULES

URLS = [
    "http://A.Example.NET/en/x?y=1", "https://example.net", "https://example.net?q", "http://example.net/", "ftp://x.org/fr/a#b", "x.org/fr/", "http://org/fr/", "http://notorg/fr/", "http://a.example.com/de/1", "http://b.example.com/en/1",
    "://net/", "a://b://net/", "", None, "http://user:pw@host.net:80/p", "http://ÄB.net/x", "http://example.net/en", "http://h.org/fr/\nnew", "http://q.example.com/de/?a=1&b=2&c=3", "http://q.example.com/de/?a=1&b=2&c=3",
]


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in U.judge(df, RULES, U.UrlModel(None, None, None)).collect()}
    assert len(out) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = parsed(u)
        r = rule(host, path)
        assert (out[i]["host"], out[i]["path"]) == (host, path)
        assert out[i]["rule"] == (r.text if r else None) and out[i]["verdict"] == (r.verdict if r else "allow")


def test_trees_learn_from_labelled_urls(spark):
    rows = [(i, f"https://safe{i % 9}.example.org/en/{i}" if i % 2 else f"http://x{i}-77.bad.biz/?a={i}&b=2&c=3", i % 2 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, blocked_label boolean").withColumn("url_length", F.lit("clash"))
    model = U.fit(df, "url", F.when(F.col("page_id") < 300, F.col("blocked_label")), trees=4, depth=3)
    got = model.predict(df).where("page_id >= 300").select("blocked", "blocked_label").collect()
    assert len(got) == 100 and sum(r[0] == r[1] for r in got) > 95
    assert model.predict(df.where("false")).count() == 0


def test_one_kind_of_label_allows_all(spark):
    df = spark.createDataFrame([("http://a.net/",), (None,)], "url string")
    model = U.fit(df, "url", F.lit(True))
    assert [r["blocked"] for r in model.predict(df).collect()] == [False, False]


def test_query_judges_every_page(spark):
    out = QUERIES["op1_url_filter"](spark, "/root/testdata/sf0.001").toPandas()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").toPandas()
    assert sorted(out["page_id"]) == sorted(pages["page_id"])
    for page, url in zip(pages["page_id"], pages["url"]):
        row = out[out["page_id"] == page].iloc[0]
        r = rule(*parsed(url))
        assert row["rule"] == (r.text if r else None) and row["verdict"] in ("allow", "block")
        assert r is None or row["verdict"] == r.verdict


def test_copies_do_not_fill_the_sample_and_statistics_count_all(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(U, "bounded_rows", lambda *a, real=U.bounded_rows: drawn.append(real(*a)) or drawn[-1])
    rows = [(f"https://h{i % 7}.{'good.org' if i % 2 else 'bad.biz'}/{i}", i % 2 == 0) for i in range(120) for _ in range(30)]
    df = spark.createDataFrame(rows, "url string, label boolean")
    model = U.fit(df, "url", F.col("label"), most_rows=20, trees=2, depth=2)
    assert [d.select("__url").distinct().count() for d in drawn] == [20, 20]
    assert {r["__domain"]: (r["domain_blocked"], r["domain_seen"]) for r in model.domains.collect()} == {"good.org": (0, 60), "bad.biz": (60, 60)}


def test_trees_judge_urls_of_hosts_that_they_never_saw(spark):
    """Blocked: digits and dashes in the host and many parameters, on suffixes that both kinds use."""
    def url(i):
        bad = i % 2 == 0
        host = f"x{i * 7919 % 10**6}-{i}-w{i % 13}" if bad else f"{'abcdefghij'[i % 10] * 3}site{'klmno'[i % 5]}"
        return f"https://{host}.{('com', 'org', 'net')[i // 2 % 3]}/{'a' if bad else 'news'}/{i}" + ("?p=1&q=2&r=3" if bad else ""), bad

    rows = [url(i) for i in range(1600)]
    train, held = spark.createDataFrame(rows[:800], "url string, label boolean"), spark.createDataFrame(rows[800:], "url string, label boolean")
    model = U.fit(train, "url", F.col("label"), trees=5, depth=3)
    right = model.predict(held).agg(F.avg((F.col("blocked") == F.col("label")).cast("double"))).first()[0]
    assert right >= 0.95


def test_long_urls_and_clashing_names(spark):
    df = spark.createDataFrame([("https://a.example.net/en/" + "x/" * 200_000, "r", "v", "p"), (None, "r", "v", "p"), ("", "r", "v", "p")], "url string, rule string, Verdict string, path string")
    train = spark.createDataFrame([(f"https://h{i}.net/{i}", i % 2 == 0) for i in range(40)], "url string, label boolean")
    out = U.judge(df, RULES, U.fit(train, "url", F.col("label"), trees=2, depth=2)).collect()
    assert len(out) == 3 and {r["rule"] for r in out} == {"example.net/en/", None}
    assert max(len(r["path"]) for r in out) == 400_004
