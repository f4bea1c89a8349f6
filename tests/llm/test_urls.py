"""URL filters against brute force on a small link graph."""

import re
import sys

import pytest

from tabfold.llm.urls import RULES, judge_urls

LINKS = '<a href="{}">x</a>'


def parse(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def rule_for(host, path):
    fit = [(len(r), r, v) for r, v in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fit)[1:] if fit else (None, None)


def pagerank(edges, seeds, rounds, damping):
    total = sum(seeds.values())
    seeds = {h: s / total if total else 0.0 for h, s in seeds.items()}
    out = {}
    for (a, b), n in edges.items():
        out[a] = out.get(a, 0) + n
    score = dict(seeds)
    for _ in range(rounds):
        come = dict.fromkeys(seeds, 0.0)
        for (a, b), n in edges.items():
            come[b] += score[a] * n / out[a]
        lost = sum(s for h, s in score.items() if h not in out)
        score = {h: (1 - damping) * seeds[h] + damping * (come[h] + seeds[h] * lost) for h in seeds}
    return score


PAGES = [
    (1, "http://good.org/a", ["http://Friend.net/x", "/own"]), (2, "https://friend.net/", ["//good.org/z", "http://far.net/"]),
    (3, "http://a.com/de/1", []), (4, "http://spam.net/x", ["http://a.com/de/1", "HTTP://a.com/de/2"]), (5, "http://spam.net/x?y://z.org/", []),
    (6, "http://x.example.org/es/1", []), (7, "http://x.example.org/en/12", []), (8, "http://x.example.org/en/2", []), (9, None, []), (10, "no scheme", []),
    (11, "http://WWW.Site.com/fr/a?b#c", ["mailto:x"]), (12, "http://site.com", []), (13, "://odd.org#/x", []), (13, "://odd.org#/x", []), (None, "http://far.net/q", ["http://far.net/"])]


def test_against_brute_force(spark):
    data = [(i, u, "".join(LINKS.format(x) for x in links), "mine") for i, u, links in PAGES]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, Host string")
    out = judge_urls(pages, spark.createDataFrame(RULES, "rule string, verdict string"), rounds=5)
    edges, allow, block = {}, {}, {}
    for _, u, links in PAGES:
        host, path = parse(u)
        allow[host], block[host] = allow.get(host, 0), block.get(host, 0)
        verdict = rule_for(host, path)[1]
        allow[host] += verdict == "allow"
        block[host] += verdict == "block"
        for dst in {parse("http:" + x if x.startswith("//") else x)[0] or host if "//" in x else host for x in links}:
            if host and dst:
                edges[host, dst] = edges.get((host, dst), 0) + 1
                for h in (host, dst):
                    allow.setdefault(h, 0), block.setdefault(h, 0)
    trust = pagerank(edges, allow, 5, 0.85)
    distrust = pagerank({(b, a): n for (a, b), n in edges.items()}, block, 5, 0.85)
    got = sorted(out.collect(), key=lambda r: str(r.page_id))
    assert len(got) == len(PAGES) and "Host_in" in out.columns
    for r, (i, u, _) in zip(got, sorted(PAGES, key=lambda p: str(p[0]))):
        host, path = parse(u)
        rule, verdict = rule_for(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.trust == pytest.approx(trust[host]) and r.distrust == pytest.approx(distrust[host])
        assert r.verdict == (verdict or ("block" if distrust[host] > trust[host] else "allow"))
    verdicts = {r.page_id: r.verdict for r in got}
    assert verdicts[4] == "block" and verdicts[2] == "allow"


def test_long_chain(spark, monkeypatch):
    """A chain of unruled hosts that ends in a blocked page: all of them lead there."""
    n, urls = 12, sys.modules[judge_urls.__module__]
    monkeypatch.setattr(urls, "TOLERANCE", 1e-3)  # fewer steps; the rest is at most 0.85 / 0.15 of it
    data = [(k, f"http://h{k}.net/", LINKS.format(f"http://h{k + 1}.net/" if k < n - 1 else "http://a.com/de/1")) for k in range(n)]
    pages = spark.createDataFrame([*data, (n, "http://a.com/de/1", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in judge_urls(pages, spark.createDataFrame(RULES, "rule string, verdict string")).collect()}
    assert {r.verdict for r in got.values()} == {"block"}
    edges = {(f"h{k + 1}.net" if k < n - 1 else "a.com", f"h{k}.net"): 1 for k in range(n)}
    settled = pagerank(edges, {"a.com": 1} | {f"h{k}.net": 0 for k in range(n)}, 300, 0.85)
    assert all(abs(got[k].distrust - settled[f"h{k}.net"]) < 6e-3 for k in range(n))


def test_empty(spark):
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert judge_urls(none, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/", None), (2, None, None)], "page_id long, url string, html string")
    assert {r.verdict for r in judge_urls(one, rules.where("false")).collect()} == {"allow"}
