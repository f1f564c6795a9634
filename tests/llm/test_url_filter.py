"""URL rules and Bloom filter cascades against plain matching."""

import random

import numpy as np
import pytest

from weighbridge.llm import url_filter as U

RULES = [("allow", "com", "/"), ("block", "example.com", "/en"), ("allow", "WWW.example.com", "/en/"), ("block", "net", "/es/"), ("block", "x.net", "/"), ("allow", "x.net", "/"), ("block", "", "/"), ("block", None, "/"), ("allow", "net", None)]


def plain(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = []
    for action, h, p in RULES:
        if h and p is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p):
            fits.append((len(h), len(p), action == "block", h.lower() + p, action))
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def urls():
    rnd = random.Random(2)
    hosts = ["com", "a.com", "example.com", "www.example.com", "b.www.EXAMPLE.com", "notexample.com", "net", "x.net", "y.x.net", "org", "", "com.", "é.net", ".com"]
    paths = ["", "/", "/en", "/en/", "/english?x=/es/", "/es/a#b", "?q", "#f", "/es", "/en/\nx"]
    out = [f"http://{rnd.choice(hosts)}{rnd.choice(paths)}" for _ in range(300)]
    return [*out, None, "", "no scheme/", "http://", "a://b://com/", "x" * 100_000, "http://com/" + "y" * 100_000]


@pytest.mark.parametrize("max_broadcast", [U.MAX_BROADCAST, 0])
def test_verdicts_equal_plain_matching(spark, monkeypatch, max_broadcast):
    monkeypatch.setattr(U, "SHARD", 20)
    rows = list(enumerate(urls()))
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id long, url string, host string, keys int").repartition(3)
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(df, rules, max_broadcast=max_broadcast).collect()}
    assert got == {i: plain(u) for i, u in rows}


def test_hosts_of_many_labels_have_few_keys(spark):
    import time

    deep = ".".join(["x"] * 60_000)
    rows = list(enumerate([f"http://{deep}.example.com/en/a", f"http://{deep}/", "http://" + "." * 60_000 + "net/es/", f"http://{deep}.y.x.net/"]))
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame([*RULES, ("block", "a.b.c.d.example.com", "/")], "action string, host string, path string")
    assert U.judge_urls(df.limit(1), rules).count() == 1  # started
    t0 = time.time()
    judged = U.judge_urls(df, rules)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged.collect()}
    assert got == {i: plain(u) for i, u in rows} and time.time() - t0 < 20
    keys = U.candidate_keys(U.host_path(df, "url"), [1, 3, 4], [1, 2, 3, 6]).selectExpr("max(size(keys)) AS n").first()["n"]
    assert keys <= 12


def test_empty_tables(spark):
    none = spark.createDataFrame([], "action string, host string, path string")
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [r["verdict"] for r in U.judge_urls(one, none).collect()] == ["allow"]
    assert U.judge_urls(one.limit(0), spark.createDataFrame(RULES, none.schema)).collect() == []


def test_cascade_is_exact_over_its_universe():
    hashes = U._hashes([f"key{i}" for i in range(20_000)])
    for share in (0, 1, 500, 10_000, 20_000):
        levels = U.build_cascade(hashes[:share], hashes[share:])
        assert np.array_equal(U.member(hashes, levels), np.arange(20_000) < share)
