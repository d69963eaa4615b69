import random

from corpuslab.llm import urlfilter

ODD = [None, "", "no-scheme/net/", "http://", "://net/", "http://NET", "http://Net/", "http://a.net?x=/en/", "http://example.net/en", "http://example.net/en/x", "http://xexample.net/en/", "HTTP://a.b.Example.COM/de/#f", "http://a.org//fr/", "http://a.org/fr/" + "x/" * 3000, "http://" + "a." * 3000 + "org/fr/", "http://net:80/", "http://u://v.net/x", "http://.net/", "http://a.net\n/x"]


def by_hand(url, rules):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if ("." + host).endswith("." + h) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def check(spark, urls, rules, **options):
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], "page_id long, url string, host string")
    rows = urlfilter.judge(pages, urlfilter.rules_frame(spark, rules), **options).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == by_hand(r.url, rules), r.url[:80] if r.url else r.url


def test_the_rules_of_the_query(spark):
    check(spark, ODD + ODD, urlfilter.RULES)


def test_many_rules_need_levels(spark):
    rnd = random.Random(7)
    hosts = [f"{rnd.choice('abcdef')}{rnd.randrange(60)}.{rnd.choice('xyz')}{rnd.randrange(9)}.net" for _ in range(400)]
    urls = [f"http://{h}/{rnd.choice(['en', 'de', ''])}/p{rnd.randrange(30)}/q" for h in hosts for _ in range(4)]
    rules = list({(h, p, "block" if (len(h) + len(p)) % 2 else "allow") for h in hosts[:150] for p in ("/", "/en/", f"/de/p{rnd.randrange(30)}/")})
    check(spark, urls, rules)
    check(spark, urls, rules, max_bits=64)  # beyond the bound: the join


def test_any_path_prefix_and_ties_both_ways(spark):
    urls = [*ODD, "http://zz.net/ab/x", "http://example.com/ads", "http://example.com/adserver/x", "http://a.example.com/ad", "http://bare.org", "http://x.bare.org/y?z", "http://a.b/c/d"]
    rules = [("net", "/ab/", "block"), ("zz.net", "/", "allow"), ("example.com", "/ads", "block"), ("bare.org", "", "block"), ("a.b/c", "/d", "block"), ("example", ".com/", "block")]
    check(spark, urls, rules)
    check(spark, urls, rules, max_bits=1)  # the join


def test_nothing(spark):
    check(spark, [], urlfilter.RULES)
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [r.verdict for r in urlfilter.judge(pages, urlfilter.rules_frame(spark, [("zz", "/", "block")])).collect()] == ["allow"]
