import random

from tapewright.llm import urlfilter as u
from tapewright.llm.queries import URL_RULES

PAGE = "page_id long, url string"


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host), r.verdict == "allow"), default=None)
    return host, path, best and best.text, best.verdict if best else default


def check(spark, urls, rules):
    df = spark.createDataFrame(list(enumerate(urls)), PAGE).repartition(3).selectExpr("*", "'x' AS host", "'y' AS k", "'z' AS verdict")
    got = {r["page_id"]: tuple(r)[1:] for r in u.judge_urls(df, rules).collect()}
    for i, url in enumerate(urls):
        assert got[i] == brute(url, rules), url


def test_cases(spark):
    rules = u.parse_rules(URL_RULES)
    check(spark, [None, "", "example.net/en/", "http://", "http://NET", "http://net/", "http://a.b.example.net/en/x?y#z", "http://example.net/en", "http://xexample.net/en/", "https://EXAMPLE.com/de/1", "http://org?x=/fr/", "http://a.org/fr/#q", "http://example.net:80/en/", "x://y://z/", "http://net./"], rules)
    assert u.judge_urls(spark.createDataFrame([], PAGE), rules).count() == 0
    assert {r["rule"] for r in u.judge_urls(spark.createDataFrame([(None, "http://a.net/")], PAGE), []).collect()} == {None}


def test_random_nested_rules(spark, monkeypatch):
    r = random.Random(3)
    labels = ["a", "b", "c", "com", "ab"]
    host = lambda: ".".join(r.choice(labels) for _ in range(r.randint(1, 4)))
    path = lambda: "/" + "/".join(r.choice("xyz") for _ in range(r.randint(0, 3)))
    rules = [u.Rule(r.choice(["allow", "block"]), host(), path()) for _ in range(60)]
    for block in (7, 1, 1000):
        monkeypatch.setattr(u, "BLOCK_RULES", block)
        check(spark, [f"http://{host()}{path()}" for _ in range(150)], rules)


def test_ties_do_not_depend_on_blocks(spark, monkeypatch):
    rules = u.parse_rules(["block net/aaa", "allow a.net/a", "block a.net/a"])
    urls = ["http://a.net/aaa", "http://b.net/aaa", "http://a.net/a"]
    for block in (1, 2, 100):
        monkeypatch.setattr(u, "BLOCK_RULES", block)
        check(spark, urls, rules)


def test_repeated_rows_and_long_urls(spark):
    rules = u.parse_rules([*URL_RULES, "block " + "l." * 40 + "net/" + "p/" * 3000])
    long = "http://" + "l." * 40 + "net/" + "p/" * 5000
    df = spark.createDataFrame([(1, long), (1, long), (2, "http://" + "x" * 100_000), (None, None)], PAGE)
    got = sorted((r["page_id"] or 0, r["verdict"], len(r["rule"] or "")) for r in u.judge_urls(df, rules).collect())
    assert got == [(0, "allow", 0), (1, "block", 6084), (1, "block", 6084), (2, "allow", 0)]


def test_paths_of_one_host():
    r = random.Random(5)
    rules = [u.Rule("block", "h", "/" + "".join(r.choice("ab") for _ in range(r.randint(0, 5)))) for _ in range(40)]
    paths = u.Paths(rules)
    for _ in range(300):
        p = "/" + "".join(r.choice("abc") for _ in range(r.randint(0, 7)))
        want = max((x for x in rules if p.startswith(x.path)), key=lambda x: len(x.path), default=None)
        assert paths.longest(p) == want
