import random
import re

from folioscope.llm.url_filter import RULES, rule_table, url_filter


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(c.lower() if c.isascii() else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, verdict, rule = max(fits, default=(0, 0, default, None))
    return host, path, rule, verdict


def urls():
    rng = random.Random(4)
    hosts = ["example.org", "WWW.Example.org", "a.b.example.org", "notexample.org", "example.com", "x.com", "org", "com", "example.org:80", "é.org", "a..org", "localhost", ""]
    paths = ["", "/", "/es/", "/es/a", "/en/1", "/en/12", "/en/2", "/fr/x", "/de/", "/ES/", "/de/é", "?q=/es/", "#/es/", "/fr/?x#y"]
    rows = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    return [None, "", "no scheme", "://", "http:/x", "a://b://c/d", "http://example.org/es/\nline", *rows]


def check(spark, rules):
    df = spark.createDataFrame([(i % 290, u) for i, u in enumerate(urls())], "page_id long, url string").selectExpr("*", "'x' AS host", "'x' AS rule")
    got = url_filter(df, rule_table(spark, rules)).collect()
    assert sorted(map(str, got and [tuple(r) for r in got])) == sorted(str((i % 290, *brute(u, rules))) for i, u in enumerate(urls()))


def test_contract_rules(spark):
    check(spark, RULES)


def test_nested_rules_ties_and_empty_paths(spark):
    check(spark, [("block", "org", ""), ("allow", "example.org", "/e"), ("block", "b.example.org", "/"), ("allow", "com", "/fr/"), ("block", "x.com", "/f"), ("allow", "com", "/fr/"), ("block", "com", "/fr/"), ("block", "a.b.example.org", "/es/a")])


def test_no_rules_and_empty_table(spark):
    check(spark, [("allow", "nowhere.test", "/")])
    df = spark.createDataFrame([(1, "http://example.org/es/")], "page_id long, url string")
    assert url_filter(df.limit(0), rule_table(spark)).collect() == []
    assert url_filter(df, rule_table(spark).limit(0)).first()["verdict"] == "allow"


def test_a_very_long_url(spark):
    df = spark.createDataFrame([(1, "http://" + "a." * 20 + "example.org/es/" + "x" * 50_000), (2, None), (3, "x" * 50_000), (4, "http:///es/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"], len(r["path"])) for r in url_filter(df, rule_table(spark)).collect()}
    assert got == {1: ("example.org/es/", "block", 50_004), 2: (None, "allow", 0), 3: (None, "allow", 0), 4: (None, "allow", 4)}
