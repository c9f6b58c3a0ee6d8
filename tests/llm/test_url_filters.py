from tenuro.llm.url_filters import RULE_SCHEMA, RULES, judge_urls

URLS = [
    (1, "https://a.example.net/en/x?y"), (2, "http://NET/"), (3, "http://net"),
    (4, "http://xnet/"), (5, "no scheme/at all"), (6, None), (7, ""), (8, "x://a.b.org/fr/"),
    (9, "http://example.com/de"), (9, "http://example.com/de/"), (9, "http://example.com/de/"),
    (None, "http://example.net/fr/"), (10, "http://" + "a." * 50_000 + "net/" + "b" * 100_000),
    (11, "http://a://b.net/x"), (12, "http:///path"), (13, "http://été.org/fr/é?#"),
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host, path = rest[:cut].translate(lower), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [
        (len(h + p), h + p, v)
        for h, p, v in RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_urls_against_plain_matching(spark):
    pages = spark.createDataFrame(
        [(k, u, "x", 1) for k, u in URLS], "page_id long, url string, host string, copies int"
    )
    rules = spark.createDataFrame(list(RULES), RULE_SCHEMA)
    got = [tuple(r) for r in judge_urls(pages, rules).collect()]
    assert sorted(got, key=str) == sorted([(k, *plain(u)) for k, u in URLS], key=str)
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_without_rules_the_default_holds(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    verdicts = judge_urls(pages, spark.createDataFrame([], RULE_SCHEMA), default="block")
    assert {(r.rule, r.verdict) for r in verdicts.collect()} == {(None, "block")}
    assert verdicts.count() == len(URLS)


def test_rule_precedence(spark):
    rules = spark.createDataFrame(
        [("b.c", "/", "allow"), ("b.c", "/", "block"), ("c", "/x/", "allow"), (None, "/", "block")],
        RULE_SCHEMA,
    )
    pages = spark.createDataFrame([(1, "s://a.b.c/"), (2, "s://a.b.c/x/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, rules).collect()}
    # Both rules of page 2 have four characters; the longer host wins.
    assert got == {1: ("b.c/", "block"), 2: ("b.c/", "block")}
