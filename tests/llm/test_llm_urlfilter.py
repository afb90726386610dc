from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from wearmark.llm import urlfilter

URLS = [
    "http://A.Example.COM/en/x?y=/net/es/", "https://www.example.com/en/", "http://example.com", "http://example.com/en",
    "http://xexample.com/en/", "ftp://b.net/es/1#top", "http://b.net/fr?x", "http://net/fr/", "http://b.net/de/", "nothing",
    "", None, "http://?q", "http://c.org/a?b://d/e", "x://É.Com/p", "http://b.net/es", "http://com/", "a://b://c/d",
]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    fits = []
    for verdict, text in urlfilter.RULES:
        name, _, prefix = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix):
            fits.append((len(text), text, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "a") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    found = {r.page_id: r for r in urlfilter.judged(pages).collect()}
    assert len(found) == len(URLS)
    for i, url in enumerate(URLS):
        r = found[i]
        assert (r.host, r.path) == parts(url)
        name, verdict = rule(*parts(url))
        assert r.rule == name and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
    assert urlfilter.judged(pages.limit(0)).count() == 0


def test_propagation_equals_numpy(spark):
    links = {"a": ["b", "c"], "b": ["c"], "c": ["a"], "d": ["c", "bad"], "e": ["d"], "bad": ["bad2"], "f": []}
    rows = []
    for host, out in links.items():
        path = "/es/" if host == "bad" else "/x"
        name = f"{host}.{'net' if host == 'bad' else 'com' if host == 'a' else 'org'}"
        html = "".join(f"<a class=l href='https://{t}.{'net' if t == 'bad' else 'com' if t == 'a' else 'org'}/'>x</a>" for t in out)
        rows += [(len(rows), f"http://{name}{path}", html + "<a href=/local>y</a>", 1)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, trust int")
    found = {r.host: r for r in urlfilter.judged(pages).collect()}
    names = sorted({*links, "bad2"})
    at = {n: i for i, n in enumerate(names)}
    flow = np.zeros((len(names), len(names)))
    for host, out in links.items():
        for t in out:
            flow[at[t], at[host]] = 1.0
    for column, matrix, seed in (("trust", flow, "a"), ("distrust", flow.T, "bad")):
        part = matrix / np.maximum(matrix.sum(axis=0), 1)
        base = np.zeros(len(names))
        base[at[seed]] = 1 - urlfilter.DAMPING
        score = np.linalg.solve(np.eye(len(names)) - urlfilter.DAMPING * part, base)
        for host, r in found.items():
            assert abs(r[column] - score[at[host.split(".")[0]]]) < 1e-3, (host, column)
    assert found["d.org"].verdict == "block"  # it links to a blocked host
    assert found["c.org"].verdict == "allow" and found["f.org"].verdict == "allow"


def test_links_are_between_hosts(spark):
    html = "<A HREF=\"//Other.org/x\">a</A> <a href='http://other.org/y'>b</a> <a href=/in>c</a> <a href='http://self.org/'>d</a>"
    pages = spark.createDataFrame([(1, "http://self.org/p", html)], "page_id long, url string, html string")
    assert [tuple(r) for r in urlfilter.host_links(pages).collect()] == [("self.org", "other.org", 1)]
    assert urlfilter.host_links(pages.withColumn("html", F.lit(None).cast("string"))).count() == 0
