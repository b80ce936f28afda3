"""Rules, links and components of URLs."""

import random

from codeloom.llm import urlfilter

URLS = [
    (1, "http://x.COM/en/1?q#f"), (2, "https://example.com/en/77"), (3, "http://notcom/en/1"), (4, None), (5, "no scheme"), (6, "http://a.net/de/8"), (7, "http://example.net/de/8x"),
    (8, "http://shop.org/es/"), (9, "http://ok.biz/p"), (10, "http://x.com/EN/1"), (11, "http://ok.biz/p"), (12, "http://host?x://y"), (13, "a://://b/en/"), (14, "http://com/en/"),
]
EXPECT = {1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("net/de/", "allow"), 7: ("example.net/de/8", "block"), 8: ("org/es/", "block"), 9: (None, "allow"), 10: (None, "allow"), 14: ("com/en/", "block")}


def test_rules(spark, folder):
    out = {r.page_id: r for r in urlfilter.op8_url_filter(spark, folder(pages=([(i, u, None, "h", 1) for i, u in URLS], "page_id long, url string, html string, host string, n int"))).collect()}
    assert len(out) == len(URLS)
    for i, want in EXPECT.items():
        assert (out[i].rule, out[i].verdict) == want, i
    assert (out[4].host, out[4].path) == ("", "") and (out[12].host, out[12].path) == ("host", "") and (out[13].host, out[13].path) == (":", "//b/en/")
    assert out[1].host == "x.com" and out[1].path == "/en/1"


def test_blocks_reach_aliases_and_not_explicit_allows(spark, folder):
    link = lambda u: f'<html><head><LINK href="{u}" rel=canonical></head>'
    pages = [
        (1, "http://a.biz/1", link("http://b.biz/2")),
        (2, "http://b.biz/2", '<meta http-equiv="refresh" content="0; url=http://bad.com/en/3">'),
        (3, "http://a.net/de/4", link("http://b.biz/2")),
        (4, "http://c.biz/5", link("/6")),
        (5, "http://c.biz/6", None),
        (6, "http://a.biz/1", None),
    ]
    out = {r.page_id: r.verdict for r in urlfilter.op8_url_filter(spark, folder(pages=(pages, "page_id long, url string, html string"))).collect()}
    assert out == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block"}


def test_links_of_pages():
    page = """<head><!-- <link rel=canonical href=http://no.com/1> --><script>'<link rel="canonical" href="/no">'</script>
      <link data-x="a>b href=/no" rel="alternate Canonical" href="../2?a&amp;b#f"><base href="//OTHER.biz/d/"><META content='5;URL="x"' HTTP-EQUIV=Refresh><link rel=canonical href="http://[">"""
    assert urlfilter.page_links("http://a.biz/p/q/1", page) == ["http://a.biz/p/2?a&b", "http://other.biz/d/x"]


def test_relative_targets_and_host_case(spark, folder):
    pages = [(1, "http://A.biz/en/1#x", '<link rel="canonical" href="2">'), (2, "http://a.BIZ/en/2", '<link rel=canonical href="http://x.COM/en/9">'), (3, "http://a.biz/en/1", None)]
    out = {r.page_id: r.verdict for r in urlfilter.op8_url_filter(spark, folder(pages=(pages, "page_id long, url string, html string"))).collect()}
    assert out == {1: "block", 2: "block", 3: "block"}


def test_components_equal_a_plain_walk(spark):
    rnd = random.Random(3)
    urls = [f"http://h{i}.{'com/en' if i % 9 == 0 else 'biz'}/{i}" for i in range(60)]
    edges = [(rnd.choice(urls), rnd.choice(urls)) for _ in range(40)]
    group = {u: {u} for u in urls}
    for a, b in edges:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for u in group[b]:
                group[u] = group[a]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    out = urlfilter.judge(pages, "url", spark.createDataFrame(edges, "src string, dst string"), urlfilter.rule_table(spark)).collect()
    assert {r.url: r.verdict for r in out} == {u: "block" if any(".com/en/" in v for v in group[u]) else "allow" for u in urls}


def test_empty(spark, empty_folder):
    assert urlfilter.op8_url_filter(spark, empty_folder).collect() == []
