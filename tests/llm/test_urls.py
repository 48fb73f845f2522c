import random
import string

import pytest
from pyspark.sql import functions as F

from pagemill.llm import urls as U

SCHEMA = "page_id long, url string, html string, rule string, verdict string, _row string, token string, `a.b` string"
SIGNS = set(string.ascii_letters + string.digits + "_.%-")


def parts(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    n = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:n].translate(str.maketrans(U.UPPER, U.LOWER)), rest[n:]
    return host, tail[: min((tail.index(c) for c in "?#" if c in tail), default=len(tail))], tail


def fits(pattern, host, tail):
    """Sign by sign, without expressions."""
    text = "://" + host + tail

    def here(p, i):
        if not p:
            return True
        if p == "|":
            return i == len(text)
        if p[0] == "*":
            return any(here(p[1:], j) for j in range(i, len(text) + 1))
        if p[0] == "^":
            return (i < len(text) and text[i] not in SIGNS and here(p[1:], i + 1)) or (i == len(text) and here(p[1:], i))
        return i < len(text) and text[i] == p[0] and here(p[1:], i + 1)

    if pattern.startswith("||"):
        starts = [3, *(3 + i + 1 for i, c in enumerate(host) if c == ".")]
        return any(here(pattern[2:], i) for i in starts)
    return any(here(pattern, i) for i in range(len(text) + 1))


def brute(rows, rules):
    out = []
    known = {}
    for page, url in rows:
        if url in known:
            out.append((page, *known[url]))
            continue
        host, path, tail = parts(url)
        best = min(((tier, -len(rule), verdict != "block", rule, verdict) for rule, verdict, pattern, tier in rules if fits(pattern, host, tail)), default=None)
        known[url] = (host, path, best and best[3], best[4] if best else "allow")
        out.append((page, *known[url]))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    names = ["net", "org", "example", "EXAMPLE", "com", "de", "ads", "blog", "x", "näme", ""]
    made = []
    for i in range(400):
        host = ".".join(r.choice(names) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ":80"])
        tail = "".join(r.choice(["/", "/en/", "/fr/", "/de/", "en", "?", "#", "page=2", "&", ".zip", "tag", "login", "utm_source=a", "Casino", "%20", "\n"]) for _ in range(r.randint(0, 6)))
        made.append((i % 300, r.choice(["http", "https", "ftp", ""]) + "://" + host + r.choice(["", "/", "/", "/"]) + tail))
    made += [(1, None), (2, ""), (3, "no scheme/net/"), (None, "http://a.net/"), (4, "http://a.net"), (5, "http://net/"), (6, "http://xnet/"), (7, "http://a.net?/"), (8, "a://b://c.net/")]
    made += [(9, "http://hot.example.net/" + "x" * 100_000 + ".zip")] + [(10, "https://hot.example.net/en/1")] * 300
    return made


def given(spark, rows):
    return spark.createDataFrame([(*r, "h", "r", "v", "w", "t", "x") for r in rows], SCHEMA).repartition(3)


def contract(rows):
    rules = [("net/", "block", "||net/", 0), ("example.net/en/", "allow", "||example.net/en/", 0), ("example.com/de/", "block", "||example.com/de/", 0), ("org/fr/", "allow", "||org/fr/", 0)]
    return [*rules, *((p, v, p, 1) for p, v in U.PATTERNS)]


@pytest.mark.parametrize("small", [U.SMALL, 0])
def test_against_every_rule(spark, rows, small):
    rules = contract(rows)
    out = U.judged(given(spark, rows), U.rules_of(spark, rules), small=small).drop("tier").collect()
    assert sorted(repr(tuple(r)) for r in out) == brute(rows, rules)


@pytest.mark.parametrize("small", [U.SMALL, 0])
def test_random_rules(spark, rows, small):
    r = random.Random(8)
    bits = ["net", "example", "en", "/", ".", "^", "*", "zip", "page", "=", "?", "+", "(", "a", "|x", "tag", "EN"]
    rules = {("||" if r.random() < 0.3 else "") + "".join(r.choice(bits) for _ in range(r.randint(1, 5))) + ("|" if r.random() < 0.2 else "") for _ in range(60)}
    rules = [(f"r{i}", r.choice(["allow", "block"]), p, i % 3) for i, p in enumerate(sorted(rules))]
    rows = [x for x in rows if len(x[1] or "") < 1000]  # the test's own matcher is slow
    out = U.judged(given(spark, rows), U.rules_of(spark, rules), small=small).drop("tier").collect()
    assert sorted(repr(tuple(r)) for r in out) == brute(rows, rules)


def test_plans_are_native(spark, rows):
    out = U.judged(given(spark, rows), U.rules_of(spark, contract(rows)).filter("tier = 0"))
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_only_rarest_tokens_fetch(spark):
    got = {r.pattern: r.t for r in spark.createDataFrame([("||net/",), ("/tag/",), ("ads",), ("*ads*/x/",), ("a.b|",), ("^",), ("||blog.*^utm_source=",)], "pattern string").select("pattern", U.whole_tokens("pattern").alias("t")).collect()}
    assert got == {"||net/": ["net"], "/tag/": ["tag"], "ads": [], "*ads*/x/": ["x"], "a.b|": ["b"], "^": [], "||blog.*^utm_source=": ["blog", "utm", "source"]}


def test_empty(spark):
    out = U.judged(given(spark, []), U.rules_of(spark, contract([])))
    assert out.count() == 0
    out = U.judged(given(spark, [(1, "http://a.net/")]), U.rules_of(spark, contract([])).filter(F.lit(False)))
    assert [r.verdict for r in out.collect()] == ["allow"]
