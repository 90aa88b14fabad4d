from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sluice.llm import reputation

URLS = ["http://A.Example.org/es/x?q#f", "x://b.com", "no scheme", None, "", "://", "http://sub.EXAMPLE.org/en/12", "http://example.org.evil.com/de/", "ftp://org/", "http://notexample.org/es/",
        "http://u@h:80/p//://q", "http://é.com/fr/é", "a://b.com/fr/#x", "http://x.co.uk/fr/", "a://b.com?x=/fr/"]


def direct(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in host), path[:end]


def test_odd_urls_and_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(URLS)] * 2, "page_id bigint, url string, host string, path string, rule string")
    out = reputation.judge(df).collect()
    assert len(out) == 2 * len(URLS)
    for r in out:
        host, path = direct(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        fits = [(len(h + p), h + p, v) for h, p, v in reputation.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert r.rule == (max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else r.verdict) and r.verdict in ("allow", "block")
    assert reputation.judge(df.limit(0)).count() == 0


def test_suffix_and_domain(spark):
    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("uk", "co.uk"), "www.x.com": ("com", "x.com"), "com": ("com", "com"), "": ("", ""), "b.co.uk": ("co.uk", "b.co.uk")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    s = reputation.suffix_of(F.col("h"))
    assert {r.h: (r.s, r.d) for r in df.select("h", s.alias("s"), reputation.domain_of(F.col("h"), s).alias("d")).collect()} == hosts


def posterior(rows):
    """Suffix, domain and host shares by plain loops; rows: (host, domain, suffix, n, g)."""

    def bind(members, p):
        members = [(n, g) for n, g in members if n]
        if len(members) < 2:
            return 1000.0
        total = sum(n for n, _ in members)
        spread = (sum(n * (g / n - p) ** 2 for n, g in members) - p * (1 - p) * (len(members) - 1)) / (total - sum(n * n for n, _ in members) / total)
        return min(1000.0, max(1.0, p * (1 - p) / spread - 1)) if spread > 0 else 1000.0

    def shrink(groups, parent):
        out = {}
        for up, members in groups.items():
            s = bind(list(members.values()), parent[up])
            out |= {k: ((g + s * parent[up]) / (n + s), n + s) for k, (n, g) in members.items()}
        return out

    def grouped(i, j):
        out = {}
        for row in rows:
            up = row[j] if j is not None else ""
            n, g = out.setdefault(up, {}).get(row[i], (0, 0))
            out[up][row[i]] = n + row[3], g + row[4]
        return out

    total, good = sum(r[3] for r in rows), sum(r[4] for r in rows)
    suffix = {k: v[0] for k, v in shrink(grouped(2, None), {"": (good + 1) / (total + 2)}).items()}
    domain = {k: v[0] for k, v in shrink(grouped(1, 2), suffix).items()}
    return shrink(grouped(0, 1), domain)


def test_shares_follow_plain_loops(spark):
    pick = random.Random(6)
    rows = []
    for t in ("com", "org", "net"):
        for d in range(6):
            rate = pick.random()
            for h in range(pick.randint(1, 5)):
                n = pick.randint(0, 30)
                rows.append((f"h{h}.d{d}.{t}", f"d{d}.{t}", t, n, sum(pick.random() < rate for _ in range(n))))
    labels = [(h, i < g) for h, _, _, n, g in rows for i in range(n)] + [(h, None) for h, *_ in rows]
    want = posterior(rows)
    out = reputation.reputations(spark.createDataFrame(labels, "host string, good boolean")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.share == pytest.approx(want[r.host][0], rel=1e-9)
        assert r.share <= r.upper <= 1


def test_bad_host_is_blocked_and_unknown_is_not(spark):
    pages = spark.createDataFrame([(1, "a://bad.x.net/1"), (2, "a://new.y.net/1")], "page_id bigint, url string")
    labels = spark.createDataFrame([("a://bad.x.net/z", False)] * 200 + [("a://ok.z.net/", True)] * 300, "url string, good boolean")
    assert {r.page_id: r.verdict for r in reputation.judge(pages, rules=(), outcomes=labels).collect()} == {1: "block", 2: "allow"}
