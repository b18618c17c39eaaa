import random
import re

import pytest

from spanweave.llm import url_filter as U

from ..compare import duck, rows

AWKWARD = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "http://com?x", "http://a.com/", "HTTPS://Example.COM/en/1", "http://example.com/EN/1", "http://www.example.com/en/x", "http://m.www.example.com/en/x#a",
    "http://notexample.com/en/", "http://x.net/es/?q=1", "http://x.net/es", "http://net/fr/a", "http://a.org/x://b.net/es/", "http://user@example.com/en/", "http://example.com:80/en/", "ftp://host/file.exe", "http://h.org/a\nb/cart",
    "http://casino-win.org/cart", "http://h.org/cart/", "http://h.org/carts", "http://h.org/x?sid=1", "http://h.org/xsid=1", "http://mycasino.org/", "http://ads.h.org/", "http://adserver12.h.org/", "http://h.org/pic.GIF?x", "http://h.org/a.exe",
    "http://h.org/a.exe?x", "http://gutenberg.org/a/b/login", "http://h.org/login", "http://h.org/robots.txt", "http://xxx.org/robots.txt", "http://h.org/ünï/tag/é", "http://h.org/b-for-sale-7.html", "http://" + "a" * 3000 + ".com/" + "b/" * 3000, "HTTP://CASINO.org", "http://h.org/\u212aelvin",
]


def fits(rule, url):
    """A host rule on a URL, by its parts."""
    host, slash, path = rule.partition("/")
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    own, way = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    return (own == host or own.endswith("." + host)) and way.startswith(slash + path), own, way


def plain(url, host_rules=U.HOST_RULES, patterns=U.PATTERNS):
    url = url or ""
    own, way = fits("com/", url)[1:]
    hit = max(((len(r), len(r.partition("/")[0]), r, a) for r, a in host_rules if fits(r, url)[0]), default=None)
    match = [p for p in patterns if re.search(U.pattern_regex(p.removeprefix("@@")).replace(r"\z", r"\Z").replace("(?s)(?i)", "(?si)"), url, re.A)]
    first = next((p for p in match if p.startswith("@@")), None) or next(iter(match), None)
    verdict = hit[3] if hit else "block" if first and not first.startswith("@@") else "allow"
    return own, way, hit and hit[2], first, verdict


def test_every_rule_on_every_url(spark):
    rnd = random.Random(3)
    urls = AWKWARD + ["".join(rnd.choice(["http://", "ads", ".", "casino", "-", "/", "cart", "net", "es", "com", "?", "#", "sid=", "login", "X", "1"]) for _ in range(rnd.randrange(1, 14))) for _ in range(400)]
    docs = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, Verdict string").repartition(5)
    got = {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "pattern", "verdict")) for r in U.filter_urls(docs, U.rules_table(spark)).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert {r[4] for r in got.values()} == {"allow", "block"} and len({r[3] for r in got.values()}) > 8


@pytest.mark.parametrize("pattern,tokens", [("||a.b^", ["a", "b"]), ("foo", []), ("/foo/", ["foo"]), ("*foo*bar*", []), ("/foo-*.html|", ["foo", "html"]), ("|http://x", ["http"]), ("^a=", ["a"]), ("/ém/", []), ("/a|b/", ["a", "b"])])
def test_tokens_that_every_match_holds(pattern, tokens):
    assert U.pattern_tokens(pattern) == tokens


def test_rules_lie_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(f"http://h{i}.org/common/{'rare' if i == 0 else 'x'}/",) for i in range(9)], "url string")
    tokens = urls.selectExpr("url").select("url", U.F.explode(U.tokens_of(U.F.col("url"))).alias("token"))
    rules = U.rules_table(spark, (), ("/common/rare/", "/common/never/", "/common/", "free*text", "/x/common/"))
    assert {r["rule"]: r["token"] for r in U.indexed(rules, tokens).collect()} == {"/common/rare/": "rare", "/common/never/": "never", "/common/": "common", "free*text": "", "/x/common/": "x"}


def test_longest_host_rule_wins_and_ties_go_to_the_longer_host(spark):
    rules = (("a.org/b/", "block"), ("org/bcd/ef", "allow"), ("x.a.org", "allow"), ("x.a.org/b/c/", "block"), ("org/12345", "block"), ("b.org/123", "allow"))
    urls = ["http://a.org/b/", "http://a.org/bcd/ef", "http://x.a.org", "http://x.a.org/b/c", "http://x.a.org/b/c/", "http://b.org/12345", "http://c.org/12345", "http://x.a.orgs/"]
    docs = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in U.filter_urls(docs, U.rules_table(spark, rules, ())).collect()}
    assert [got[i] for i in range(len(urls))] == ["a.org/b/", "org/bcd/ef", "x.a.org", "a.org/b/", "x.a.org/b/c/", "b.org/123", "org/12345", None]


def test_empty_tables_repeated_rows_and_no_rules(spark):
    schema = "page_id long, url string, html string, rule int"
    assert U.filter_urls(spark.createDataFrame([], schema), U.rules_table(spark)).count() == 0
    docs = spark.createDataFrame([(1, "http://casino.org/", "h", 1)] * 3 + [(None, None, None, None)] * 2 + [(1, "http://b.org/", "h", 2)], schema)
    got = U.filter_urls(docs, U.rules_table(spark))
    assert sorted(r["verdict"] for r in got.collect()) == ["allow"] * 3 + ["block"] * 3
    assert got.columns == ["page_id", "url", "html", "host", "path", "rule", "pattern", "verdict"]
    assert {r["verdict"] for r in U.filter_urls(docs, U.rules_table(spark, (), ())).collect()} == {"allow"}


def test_query_equals_its_sql(spark, sf_dir):
    got = U.op13_url_filter(spark, sf_dir).toPandas()
    assert rows(got) == rows(duck(U.OP13_SQL, sf_dir)) and set(got["verdict"]) == {"allow", "block"}
