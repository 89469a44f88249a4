from millrace.llm.queries import URL_RULES, op6_url_filters
from millrace.llm.url_filters import filter_urls
from millrace.sources.tables import table

from .conftest import SMALL


def judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else default


def test_query_agrees_with_plain_judgement(spark):
    urls = {r.page_id: r.url for r in table(spark, SMALL, "pages").collect()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op6_url_filters(spark, SMALL).collect()}
    assert got == {k: judge(u, URL_RULES) for k, u in urls.items()}


def test_edges(spark):
    urls = [None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://A.ORG/x", "ftp://example.org/en/1", "x://example.org/en/12?q=://b", "x://myexample.org/es/", "x://a.example.org/es", "http://com/fr/",
            "http://É.com/de/é#x", "http://a..com/de/", "http://u:p@example.com:80/de/", "http://h\nost.com/fr/\nx", "http://com.evil.net/de/", "http://.com/de/", "http://com?/de/", "http://a.com/fr/", "http://a.com/fr/"]
    pages = spark.createDataFrame([(i // 2, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, URL_RULES).collect())))
    assert got == sorted(str((i // 2, *judge(u, URL_RULES))) for i, u in enumerate(urls))
    assert {r.verdict for r in filter_urls(pages, []).collect()} == {"allow"}
    twice = pages.limit(3).union(pages.limit(3))
    assert filter_urls(twice, URL_RULES).count() == 6
    assert filter_urls(pages.limit(0), URL_RULES).count() == 0
