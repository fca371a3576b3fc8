import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import op10_url_filter as op

URLS = [
    None, "", "no scheme", "http://WWW.Example.ORG/es/1", "https://example.org/en/1x", "http://example.org", "http://org/", "http://a.com/fr/x?q=/de/", "http://a.com/de/1#f",
    "http://a.com/DE/1", "ftp://badexample.org/es/1", "http://u:p@b.net:80/x/y#z?w", "http://x.net?/a", "://h/p", "http://morg/", "http://a.com/fr",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = lambda s, marks: min([s.index(m) for m in marks if m in s] + [len(s)])
    n = cut(rest, "/?#")
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
    path = tail[: cut(tail, "?#")]
    fit = []
    for verdict, rule in op.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append((len(rule), rule, verdict))
    best = max(fit, default=(0, None, None))
    return host, path, best[1], best[2]


def test_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, None, "x", "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string, verdict string")
    got = sorted(op.judge(pages).collect())
    for r, u in zip(got, URLS, strict=True):
        host, path, rule, verdict = brute(u)
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert got[0].verdict == got[1].verdict == got[2].verdict == "allow"


def dense(seed, edges):
    """The fixed point, by solving the equations; hosts without links send all back to the seeds."""
    hosts = sorted({h for x in edges for h in x[:2]} | set(seed))
    b = np.array([seed.get(h, 0.0) for h in hosts])
    m = np.zeros((len(hosts), len(hosts)))
    for s, d, n in edges:
        m[hosts.index(d), hosts.index(s)] += n
    out = m.sum(axis=0)
    m[:, out > 0] /= out[out > 0]
    m[:, out == 0] = (b / b.sum())[:, None]
    return dict(zip(hosts, np.linalg.solve(np.eye(len(hosts)) - op.DAMPING * m, (1 - op.DAMPING) * b), strict=True))


@pytest.mark.parametrize("more", [[], [("b", "end", 4.0), ("d", "end", 1.0)]])
def test_pagerank_equals_dense(spark, more):
    e = [("a", "b", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("a", "c", 1.0), ("d", "a", 3.0), *more]
    seed = {"a": 0.5, "d": 0.25}
    got = dict(map(tuple, op.propagate(spark.createDataFrame(list(seed.items()), "host string, seed double"), spark.createDataFrame(e, "src string, dst string, n double")).collect()))
    want = dense(seed, e)
    assert abs(sum(got.values()) - 0.75) < 1e-9  # nothing is lost
    for h, v in want.items():
        assert abs(got.get(h, 0.0) - v) < 0.75 * op.TOLERANCE * op.DAMPING / (1 - op.DAMPING)


def test_query_on_pages_with_links_between_hosts(spark, tmp_path):
    link = lambda *h: "".join(f'<a Href="//{x}/p">' for x in h)
    pages = [("http://bad.com/de/1", ""), ("http://bad.com/de/2", ""), ("http://good.org/1", link("friend.net", "other.net")), ("http://spam.net/", link("bad.com", "bad.com")),
             ("http://friend.net/", link("good.org")), ("http://other.net/", link("bad.com", "friend.net", "good.org")), ("http://spam2.net/", link("spam.net")), (None, link("bad.com"))]
    spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in op.op10_url_filter(spark, str(tmp_path)).collect()}
    edges = {}
    for u, h in pages:
        src = brute(u)[0]
        for d in re.findall('Href="//([^/]+)/', h):
            if src and src != d:
                edges[src, d] = edges.get((src, d), 0) + 1
    trust = dense({"good.org": 1 / 3}, [(s, d, n) for (s, d), n in edges.items()])
    distrust = dense({"bad.com": 2 / 3}, [(d, s, n) for (s, d), n in edges.items()])
    for i, (u, _) in enumerate(pages):
        host, path, rule, verdict = brute(u)
        t, x = trust.get(host, 0.0), distrust.get(host, 0.0)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if x > op.MAX_DISTRUST * (t + x) else "allow"))
    assert got[3].verdict == got[6].verdict == "block" and got[4].verdict == "allow"


def test_distrust_flows_against_links(spark):
    link = lambda h: f'<a href="http://{h}/x">'
    rows = [(0, "http://bad.com/de/1", None), (1, "http://bad.com/de/2", ""), (2, "http://farm.net/1", link("bad.com") * 3), (3, "http://good.org/1", link("nice.net")), (4, "http://nice.net/2", "x"), (5, "http://bad.com/en/1", "")]
    got = {r.page_id: r.verdict for r in op.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block"}


def test_edges_are_between_hosts(spark):
    html = '<a href="http://A.net/1"><img src=\'https://b.net/i.png\'><a href="/own"><a href="http://h.org/2"><a HREF=http://a.net><a hReF="//c.net/x"><p>//d.net/'
    e = op.host_edges(spark.createDataFrame([("http://h.org/", html), (None, html)], "url string, html string"))
    assert sorted(map(tuple, e.collect())) == [("h.org", "a.net", 2.0), ("h.org", "b.net", 1.0), ("h.org", "c.net", 1.0)]


def test_empty_table_and_repeats(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert op.judge(none).collect() == []
    twice = spark.createDataFrame([(1, "http://a.com/de/", "")] * 2, "page_id long, url string, html string")
    assert op.judge(twice).where(F.col("verdict") == "block").count() == 2
