import re

from tests.llm import edge
from tidewater.llm import url_rules as U

URLS = [
    None, "", "no scheme", "http://", "://x.NET", "https://A.Example.NET/en/1", "http://example.net/en/", "http://example.net/en", "http://notexample.net/en/x", "http://net/?q=/",
    "http://x.example.com/de/5#f", "http://example.com/de?x", "http://a.org/fr/1?u=http://b.net/", "http://ORG/fr/", "http://a.org", "ftp://Ünet.é/ß", "http://a\nb.net/c\nd", "x://y://z.net/",
]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for verdict, rule in U.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


def pages(spark, rows):
    return edge.with_clashes(spark.createDataFrame([(i, u, "<html>") for i, u in rows], "page_id long, url string, html string"))


def test_explicit_rules(spark):
    rows = [*enumerate(URLS), (None, URLS[5]), (5, URLS[5])]
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(pages(spark, rows), edge.labels(spark)).collect()), key=str)
    assert got == sorted(((i, *(b := brute(u))[:3], b[3] or "allow") for i, u in rows), key=str)


def test_mined_rules_match_brute_force(spark):
    rows, marks = [], []
    for i in range(200):
        bad = i % 4 == 0
        host = "win.casino.test" if bad and i % 8 else "casino.test" if i % 8 == 1 else "news.test"
        rows.append((i, f"http://{host}/{'promo' if bad else 'story'}/{i}.html?ref={i}"))
        marks.append((i, 0 if bad and i % 20 else 1, 0))
    df = pages(spark, rows)
    p = U.split_url(df.select("page_id", "url")).withColumn("tokens", U.tokens())
    train = U.labelled(p, edge.labels(spark, marks))
    table = [(set(r["tokens"]), r["bad"]) for r in train.collect()]
    found = U.mined(train).collect()
    assert found
    base = sum(b for _, b in table) / len(table)
    for r in found:
        hit = [b for t, b in table if set(r["rule"]) <= t]
        assert abs(sum(hit) / len(hit) - r["confidence"]) < 1e-9 and sum(hit) >= U.LEAST and sum(hit) / len(hit) >= max(U.CONFIDENCE, U.LIFT * base)
        assert r["key"] in r["rule"]
    got = {r["page_id"]: r["confidence"] for r in U.judge(df, edge.labels(spark, marks)).collect()}
    for r in p.collect():
        best = max((x["confidence"] for x in found if set(x["rule"]) <= set(r["tokens"])), default=None)
        assert got[r["page_id"]] == best


def test_plan_stays_in_the_jvm(spark):
    plan = U.judge(pages(spark, enumerate(URLS)), edge.labels(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow|NestedLoop|Cartesian", plan)


def test_empty_tables(spark):
    assert U.judge(pages(spark, enumerate(URLS)).limit(0), edge.labels(spark)).count() == 0
    assert U.judge(pages(spark, enumerate(URLS)), edge.labels(spark).limit(0)).count() == len(URLS)
