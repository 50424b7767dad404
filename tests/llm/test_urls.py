import datetime as dt
import random

from quillgraph.llm import urls


def keys(url):
    import re

    m = re.match(urls.HOST, url or "")
    if not m:
        return []
    host = m[1].lower()
    labels = host.split(".")
    path = re.match(urls.PATH, url)
    seg = [s for s in (path[1] if path else "").split("/") if s]
    return ["domain:" + ".".join(labels[i:]) for i in range(max(len(labels) - 1, 1))] + ["host:" + host] + ["prefix:" + "/".join([host, *seg[: i + 1]]) for i in range(len(seg))]


def plain(url, day, entries):
    best = None
    for key in keys(url) if day else []:
        now = {}
        for kind, value, action, at in entries:
            if kind and value and action and at and f"{kind}:{value.lower()}" == key and at <= day:
                now[at] = "add" if "add" in (action, now.get(at)) else "remove"
        if now and now[max(now)] == "add":
            best = max([best, (("domain", "host", "prefix").index(key.split(":")[0]), len(key), key)], key=lambda x: x or (-1,))
    return best and best[2]


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(120))
    hosts = ["a.example.com", "example.com", "b.a.example.com", "x.org", "localhost"]
    captures = [(i, rnd.choice(["http", "HTTPS"]) + "://" + rnd.choice(["", "u:p@"]) + rnd.choice(hosts) + rnd.choice(["", ":80"]) + rnd.choice(["", "/", "/p/q", "/p?x=/z", "#top"]), day()) for i in range(150)]
    captures += [(900, None, day()), (901, "not a url", day()), (902, "http://x.org/", None), (1, captures[1][1], captures[1][2])]
    entries = [(rnd.choice(["domain", "host", "prefix"]), rnd.choice([*hosts, "X.org", "x.org/p", "example.com/p/q"]), rnd.choice(["add", "remove"]), day()) for _ in range(90)] + [(None, "x.org", "add", day()), ("host", None, "add", day())]
    c = spark.createDataFrame(captures, "id long, url string, fetched date").selectExpr("*", "'old' as rule")
    e = spark.createDataFrame(entries, "kind string, value string, action string, at date")
    out = urls.judge(c, e).collect()
    assert len(out) == len(captures) and 20 < sum(r.listed for r in out) < 140
    for r in out:
        assert r.rule == plain(r.url, r.fetched, entries) and r.listed == (r.rule is not None)
    assert urls.judge(c.limit(0), e).count() == 0
    assert not any(r.listed for r in urls.judge(c, e.limit(0)).collect())
    plan = urls.judge(c, e)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
