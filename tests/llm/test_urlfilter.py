import re

import pytest

from lodestar.llm import queries, urlfilter
from lodestar.llm.urlfilter import Rule

SITES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URLS = [
    "http://a.example.org/es/1", "https://example.org/en/12?x=/es/", "http://notexample.org/es/", "http://x.com/fr", "http://x.com/fr/", "HTTP://X.COM/de/#a", "http://com/de/x",
    "http://x.net/de/", "http://www.spam-farm.example.org/q", "http://spam-farm.net/q", "http://cheap-pills.io", "http://spamfarm.net/", "http://x.net/spam-farm/", "http://example.org?/es/", "http://org", "nothing",
    "://", "http://", "", None, "ftp://u@h.org:80/a://b", "http://x.com//fr/", "http://ExAmple.ORG/ES/", "http://é.org/ü", "http://x.com/fr/\nx", "http://casino.com/fr/", "http://casino.net/fr/", "http://casino.net/fr/", "http://a.b.c.example.org/en/1" + "9" * 5000,
]


def judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    spam = re.search(r"(?:^|[^A-Za-z0-9])(spam-farm|cheap-pills|casino|viagra|porn|adult|payday|warez)(?:$|[^A-Za-z0-9])", host)
    return host, path, None, "block" if spam else "allow"


@pytest.mark.parametrize("most", [200, 3])
def test_equals_judging_one_by_one(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(urlfilter.judged, "__defaults__", (urlfilter.SITES + urlfilter.SPAM, "url", "allow", most))
    pages = spark.createDataFrame([(i, u, "html") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op5_url_filters(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == [(i, *judge(u)) for i, u in enumerate(URLS)]


@pytest.mark.parametrize("most", [200, 0])
def test_extra_columns_no_rows_no_rules(spark, most):
    schema = "page_id long, url string, host string, verdict int, token string, index int"
    pages = spark.createDataFrame([(1, "http://a.org/x", "h", 1, "t", 5), (1, "http://a.org/x", "h", 1, "t", 5), (None, None, None, None, None, None)], schema)
    out = urlfilter.judged(pages, most_mapped=most)
    assert sorted(((r.page_id, r.host, r.rule, r.token, r["index"]) for r in out.collect()), key=str) == sorted([(1, "a.org", "org/", "t", 5)] * 2 + [(None, "", None, None, None)], key=str)
    assert urlfilter.judged(spark.createDataFrame([], schema), most_mapped=most).count() == 0
    assert {r.verdict for r in urlfilter.judged(pages, rules=pages.limit(0).selectExpr("'' rule", "'' verdict", "'' expression", "0 rank", "false host_only"), most_mapped=most).collect()} == {"allow"}


def test_the_rarest_token_is_the_key(spark):
    pages = spark.createDataFrame([("a.org", "/x"), ("b.org", "/y"), ("a.net", "/z")], "host string, path string")
    rules = (Rule("r1", "block", "||a.org^"), Rule("r2", "block", "|b.org/y|"), Rule("r3", "block", "^Q.org/*x"), Rule("r4", "block", "*.or*"), Rule("r5", "block", None))
    got = {r.rule: r.token for r in urlfilter.rule_table(pages, rules).collect()}
    assert got == {"r1": "a", "r2": "b", "r3": "q", "r4": ""}


def plain(expression):
    """The same by the rules' definition, a character at a time."""
    start, body = ("(^|^[^/]*[.])", expression[2:]) if expression.startswith("||") else ("^", expression[1:]) if expression.startswith("|") else ("", expression)
    end, body = (r"\Z", body[:-1]) if body.endswith("|") else ("", body)
    return re.compile(start + "".join("(?s:.*)" if c == "*" else r"(^|\Z|[^A-Za-z0-9])" if c == "^" else re.escape(c) for c in body) + end)


@pytest.mark.parametrize("most", [200, 0])
def test_every_rule_meets_every_url_it_fits(spark, most):
    expressions = ["*.xyz/", "||xyz^", "|a.b", "b/|", "x", "a*c", "^c^", "/d?e", "(+)", "$", "||a.b/É", "A.B", "é^", "^1^2^", "*", "a.b^c", "\\", "İ^b"]
    hosts, paths = ["a.xyz", "xyz", "a.b", "x.a.b", "c", "é.b", "a-c", "İ.b"], ["", "/", "/b/", "/A.B", "/(+)$", "/É/é", "/1/2", "/ab/c", "/d\\", "/x\ny"]
    pages = spark.createDataFrame([(h + p, f"http://{h}{p}") for h in hosts for p in paths], "at string, url string")
    for e in expressions:
        got = {r["at"] for r in urlfilter.judged(pages, (Rule("r", "block", e), Rule("s", "block", "||nowhere.net^")), most_mapped=most).where("verdict = 'block'").collect()} if e in expressions[:3] or most else None
        assert got is None or got == {h + p for h in hosts for p in paths if plain(e).search(h + p)}, e
    all_ = tuple(Rule(f"{i:02}", "block", e, i) for i, e in enumerate(expressions))
    got = {r["at"]: r.rule for r in urlfilter.judged(pages, all_, most_mapped=most).collect()}
    assert got == {u: max((f"{i:02}" for i, e in enumerate(expressions) if plain(e).search(u)), default=None) for u in got}
