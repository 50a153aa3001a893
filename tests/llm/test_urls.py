import random
import re

import duckdb
from pyspark.sql import Row

from hostelry.llm import queries, urls

RULES = queries.RULES


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0])) if fits else (None, None)


def plain_bound(rows, limit=0.5, z=1.645):
    """Posterior bound per host from (host, bad) rows."""
    level = {"": {}}
    names = {}
    for host, bad in rows:
        domain, suffix = ".".join(host.split(".")[-2:]), host.split(".")[-1]
        names[host] = (domain, suffix)
        for kind, key in (("suffix", suffix), ("domain", domain), ("host", host)):
            n, k = level.setdefault(kind, {}).get(key, (0, 0))
            level[kind][key] = (n + (bad is not None), k + (bad or 0))
    n, k = (sum(x[i] for x in level["host"].values()) for i in (0, 1))
    prior = {s: (k + 0.5) / (n + 1) for s in level["suffix"]}
    up = {"suffix": lambda key: key, "domain": lambda key: key.split(".")[-1], "host": lambda key: names[key][0]}
    for kind in ("suffix", "domain", "host"):
        a = b = c = 0
        for key, (n, k) in level[kind].items():
            m = prior[up[kind](key)]
            if n:
                a, b, c = a + n * (k / n - m) ** 2, b + m * (1 - m), c + (n - 1) * m * (1 - m)
        rho = max(0.001, min(0.5, (a - b) / c)) if c > 0 else 0.1
        s = (1 - rho) / rho
        prior_new = {key: (k + s * prior[up[kind](key)]) / (n + s) for key, (n, k) in level[kind].items()}
        if kind == "host":
            return {h: m - z * (m * (1 - m) / (level["host"][h][0] + s + 1)) ** 0.5 for h, m in prior_new.items()}
        prior = prior_new


HOSTS = ["a.com", "b.a.com", "x.example.net", "example.net", "Example.COM", "m.example.com", "q.org", "net", "spam.bad.info", "y.bad.info", "", "é.fr"]
PATHS = ["", "/", "/en/1", "/de/2?x=/en/", "/fr/#a", "?q=1", "#/de/", "/en", "/a\nb"]


def pages_of(seed, n=400):
    rng = random.Random(seed)
    out = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(HOSTS)}{rng.choice(PATHS)}") for i in range(n)]
    return out + [(n, None), (n + 1, "no scheme"), (n + 2, "a://b://c/d"), (None, "http://a.com/")]


def test_equals_a_plain_judge(spark):
    rng = random.Random(5)
    rows = pages_of(1)
    bad = {i: int(rng.random() < (0.97 if url and "bad.info" in url else 0.2)) for i, url in rows if i is not None and rng.random() < 0.8}
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame(list(bad.items()), "page_id long, bad int")
    bound = plain_bound([(plain_parts(u)[0], bad.get(i)) for i, u in rows])
    out = urls.judge(pages, outcomes, RULES).collect()
    assert len(out) == len(rows)
    by_id = dict(rows)
    assert any(b > 0.5 for b in bound.values())
    for r in out:
        host, path = plain_parts(by_id[r.page_id])
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert abs(r.bound - bound[host]) < 1e-9
        assert r.verdict == (verdict or ("block" if bound[host] > 0.5 else "allow"))


def test_a_domain_speaks_for_its_unseen_hosts(spark):
    rows = [(i, f"http://h{i % 40}.bad.info/") for i in range(400)] + [(1000, "http://new.bad.info/")] + [
        (2000 + i, f"http://h{i % 40}.good{i % 9}.com/") for i in range(400)]
    outcomes = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows if i != 1000], "page_id long, bad int")
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), outcomes, []).collect()}
    assert out[1000].verdict == "block" and out[2000].verdict == "allow"


def test_rows_of_any_kind(spark):
    pages = spark.createDataFrame([Row(page_id=1, url="http://a.com", host="x", bad=3, n=1, rule=2, key_=1)] * 2)
    none = spark.createDataFrame([(1, None), (None, 1)], "page_id long, bad int")
    out = urls.judge(pages, none, RULES)
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()] == [(1, "a.com", "", None, "allow")] * 2
    assert urls.judge(pages.limit(0), none.limit(0), RULES).collect() == []


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    want = con.execute(queries.SQL["op6_urls"])
    names = [d[0] for d in want.description]
    got = queries.op6_urls(spark, folder)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))
