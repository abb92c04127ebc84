from framehouse.llm import url_filter

URLS = [
    (1, "https://A.example.NET/en/x?utm_source=q#f"), (2, "https://a.example.net/de/"), (3, "http://example.com/de/y"),
    (4, "http://example.com/fr/y"), (5, "http://x.org/fr/"), (6, "http://badexample.com/de/"), (7, None), (8, "no scheme"),
    (9, ""), (10, "https://net"), (11, "https://net?x=/"), (12, "https://x.org:443/de/"), (13, "https://é.org/fr/" + "z" * 5000),
    (1, "https://A.example.NET/en/x?utm_source=q#f"), (None, "http://b.net/"),
]


def brute(url):
    """host, path, rule by reading the contract; the longest fitting rule wins."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("#")[0].split("?")[0]
    fits = [of + start for _, of, start in url_filter.RULES if (host == of or host.endswith("." + of)) and path.startswith(start)]
    return host, path, max(fits, key=len, default=None)


def test_rules_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in URLS], "page_id long, url string, canon string, listed string")
    got = sorted((str(r.page_id), r.host, r.path, r.rule or "") for r in url_filter.filter_urls(pages).collect())
    assert got == sorted((str(i), h, p, r or "") for i, u in URLS for h, p, r in [brute(u)])
    verdicts = {r.rule: r.verdict for r in url_filter.filter_urls(pages).where("rule IS NOT NULL").collect()}
    assert verdicts == {"net/": "block", "example.com/de/": "block", "example.net/en/": "allow", "org/fr/": "allow"}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_listed_urls_in_other_spellings(spark):
    listed = spark.createDataFrame([("http://www.spam.io/a/",), (None,)], "url string")
    rows = [(1, "https://spam.io/a?utm_x=1"), (2, "https://spam.io/b"), (3, "https://m.spam.io:443/a/index.html"), (4, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, listed).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow"}
    none = url_filter.filter_urls(pages, listed.limit(0))
    assert {r.verdict for r in none.collect()} == {"allow"}
