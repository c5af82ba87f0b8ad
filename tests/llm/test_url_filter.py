import pytest

from tracewright.llm import url_filter as U


@pytest.fixture(scope="module")
def model(spark):
    return U.train(U.labelled_urls(spark))


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, marks: s[: min([len(s), *(s.index(m) for m in marks if m in s)])]
    host = cut(rest, "/?#")
    return host.translate({c: c + 32 for c in range(65, 91)}), cut(rest[len(host) :], "?#")


def slow_rule(host, path):
    fits = []
    for action, rule in U.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, action))
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "https://example.net/en", "http://net", "http://net/", "http://x.net?q=/en/", "ftp://example.com/de/1.html",
    "http://notexample.com/de/", "http://a.org/fr/x", "http://org/fr/", "http://h#f/p", "http:///en/", "x://y://z/p", "http://ÄB.example.com/DE/", "http://internet/",
    "https://casino-win.example.com/en/77", "https://blog.school.example.com/fr/12?page=2&ref=x", "http://a.com/\nb?c", "http://x.com/" + "a/" * 4000,
]


def test_hosts_paths_rules(spark, model):
    urls = spark.createDataFrame([(i, u, "mine", "kept") for i, u in enumerate(URLS)], "page_id long, url string, host string, label string")
    rows = {r.page_id: r for r in U.judge(urls, model).collect()}
    for i, url in enumerate(URLS):
        host, path = slow_parts(url)
        rule, action = slow_rule(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].label) == (host, path, rule, "kept")
        assert rows[i].verdict == (action or ("block" if rows[i].score >= U.CUT else "allow"))
    assert rows[17].verdict == "block" and rows[18].verdict == "allow"
    assert U.judge(urls.limit(0), model).count() == 0


def test_held_out_accuracy(spark, model):
    fresh = U.labelled_urls(spark, 9_000).where("url is not null").subtract(U.labelled_urls(spark))
    scored = model.score(U.with_parts(fresh)).selectExpr("avg(cast((score >= 0.5) = (label = 1) as double)) a").first()
    assert scored.a > 0.95


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = U.op1_url_filter(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    for r in rows:
        assert (r.rule, None if r.rule is None else r.verdict) == slow_rule(r.host, r.path)
    free = [r for r in rows if r.rule is None]
    assert all(r.verdict == "block" for r in free if "casino" in r.host or "pills" in r.host)
    assert sum(r.verdict == "block" for r in free) < 0.15 * len(free)
