import itertools
import random

import pytest

from treatlens.llm.url_filter import ALLOW, BLOCK, MAX_RULES, Rule, UrlTrie, filter_urls, split_url


def brute(rules, host, path):
    fits = [r for r in rules if (r.host == "" or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)


def test_trie_equals_brute_force():
    rng = random.Random(0)
    hosts = ["org", "a.org", "b.a.org", "com", "a.com", ""]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/bc", "/ab", "//"]
    pool = [Rule(rng.choice([ALLOW, BLOCK]), h, p) for h, p in itertools.product(hosts, paths)]
    for _ in range(60):
        rules = rng.sample(pool, 8)
        trie = UrlTrie(rules)
        for h, p in itertools.product([*hosts, "x.b.a.org", "xorg", ".org", "org."], [*paths, "/a/bcd/e", "/a/b/"]):
            got, want = trie.match(h, p), brute(rules, h, p)
            assert (got and got.text) == (want and want.text), (h, p, rules)


def test_urls_and_odd_rows(spark):
    assert split_url("HTTP://WWW.\u00c9x.Org:80/Path/x?q#f") == ("www.\u00c9x.org:80", "/Path/x")
    assert split_url("a://b?c/d") == ("b", "") and split_url("mailto:x") == ("", "") and split_url(None) == ("", "")
    assert split_url("x://y#/z?") == ("y", "") and split_url("x://y/z://w") == ("y", "/z://w")
    rules = [Rule(ALLOW, "org", "/"), Rule(BLOCK, "Example.org", "/en/1"), Rule(BLOCK, "dup.com"), Rule(ALLOW, "dup.com")]
    rows = [(1, "http://m.example.org/en/123"), (2, None), (3, "junk"), (4, "http://dup.com"), (4, "http://dup.com"), (None, "http://x.org/" + "a" * 100_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, verdict string")
    got = sorted(((r.page_id, r.rule, r.verdict) for r in filter_urls(frame, rules).collect()), key=str)
    assert got == [(1, "example.org/en/1", BLOCK), (2, None, ALLOW), (3, None, ALLOW), (4, "dup.com", BLOCK), (4, "dup.com", BLOCK), (None, "org/", ALLOW)]
    assert filter_urls(frame.filter("page_id > 9"), rules).count() == 0
    with pytest.raises(ValueError):
        filter_urls(frame, [Rule(BLOCK, "a")] * (MAX_RULES + 1))
