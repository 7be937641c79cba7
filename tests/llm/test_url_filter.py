import re

from turnstone.llm import url_filter


def brute(url, rules, default="allow"):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, default)))


def test_matches_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/fr", "http://xexample.net/en/", "http://b.example.com/de/1", "http://example.com/dex", "http://c.org/fr/", "http://c.org/fr", "a://b://c.net/x", "http://x..net/", "http://é.net/\n?q", "http://example.net:80/en/"]
    urls += [f"http://h{i % 7}.example.{('net', 'com', 'org')[i % 3]}/{('en', 'de', 'fr')[i % 5 % 3]}/{i}" for i in range(200)] + ["http://hot.net/same"] * 150
    pages = spark.createDataFrame([(i if i != 3 else None, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, html string, host string")
    nested = [*url_filter.RULES, ("a.example.net", "/", "block"), ("a.example.net", "/en/x", "allow"), ("h1.example.org", "", "block")]
    for rules in (url_filter.RULES, nested):
        got = url_filter.judge(pages, url_filter.rules_table(spark, rules), ranges=6).collect()
        want = [(i if i != 3 else None, *brute(u, rules)) for i, u in enumerate(urls)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark)).count() == 0
    assert {r.rule for r in url_filter.judge(pages, url_filter.rules_table(spark).limit(0)).collect()} == {None}
