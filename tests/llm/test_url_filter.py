import random
from itertools import combinations

from capweave.llm import url_filter as U


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_given_rules_and_parts(spark):
    cases = {
        "http://A.Example.COM/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "x://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://example.net/fr/a": ("example.net", "/fr/a", "net/fr/", "block"),
        "http://net/es/": ("net", "/es/", "net/es/", "block"),
        "http://e.com": ("e.com", "", None, "allow"),
        "http://e.com?/": ("e.com", "", None, "allow"),
        "HTTP://ÄB.com/\n": ("Äb.com", "/\n", "com/", "allow"),
        "no mark": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    frame = pages(spark, [*cases, None])
    got = U.judge(frame.selectExpr("*", "'mine' AS host", "'mine' AS verdict", "'mine' AS tokens")).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        want = cases[r.url] if r.url is not None else ("", "", None, "allow")
        assert (r.host, r.path, r.rule) == want[:3] and (want[2] is None or r.verdict == want[3]), r
    assert U.judge(frame.limit(0)).count() == 0


def plain_rules(baskets, support, confidence):
    """All combinations, counted one by one."""
    n, found = len(baskets), {}
    items = sorted({t for tokens, _ in baskets for t in tokens})
    for size in range(1, U.LONGEST + 1):
        for part in combinations(items, size):
            hits = [v for tokens, v in baskets if set(part) <= set(tokens)]
            for verdict in set(hits):
                k = hits.count(verdict)
                if k >= support * n and (k + 1) / (len(hits) + 2) >= confidence:
                    found[frozenset(part), verdict] = (k + 1) / (len(hits) + 2)
    return {
        rule for rule, sure in found.items()
        if not any(other[1] == rule[1] and other[0] < rule[0] and found[other] >= sure for other in found)
    }


def test_mined_rules_equal_brute_force(spark):
    draw = random.Random(3)
    baskets = []
    for _ in range(400):
        tokens = sorted(draw.sample("abcdefg", draw.randrange(1, 5)))
        bad = "a" in tokens and "b" in tokens or "c" in tokens and draw.random() < 0.95
        baskets.append((tokens, "block" if bad else "allow"))
    frame = spark.createDataFrame(baskets, "tokens array<string>, verdict string")
    rules, counts = U.mine(frame, 0.05, 0.9)
    assert {(r.tokens, r.verdict) for r in rules} == plain_rules(baskets, 0.05, 0.9) and len(rules) > 2
    index = U.Index(rules, counts)
    for tokens, _ in baskets:
        fits = sorted((r for r in rules if r.tokens <= set(tokens)), key=lambda r: r.rank)
        assert index.verdict(tokens) == (fits[0].verdict if fits else None)
    assert U.mine(frame.limit(0)) == ([], {}) and U.Index([], {}).verdict(["a"]) is None


def test_unruled_urls_take_the_verdict_of_what_they_share(spark):
    urls = [f"http://h{i}.example.com/en/spam/{i}" for i in range(60)] + [f"http://h{i}.other.com/de/{i}" for i in range(60)]
    urls += ["http://z.example.org/en/spam/7", "http://z.other.org/de/7", "http://new.org/xx"]
    got = [r.verdict for r in U.judge(pages(spark, urls)).orderBy("page_id").collect()]
    assert got[-3:] == ["block", "allow", "allow"]
