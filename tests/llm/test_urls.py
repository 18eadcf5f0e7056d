"""The trie against all rules tried one by one."""

import random

from eventlake.llm import urls
from eventlake.llm.queries import URL_RULES


def slow(rules, host, path):
    fits = [r for r in rules if (not r[1] or host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1].split(".")) if r[1] else 0, len(r[2]), r[0] == "block"), default=None)
    return best and (best[1] + best[2], best[0])


def test_trie_is_the_longest_match():
    rng = random.Random(1)
    part = lambda n: rng.choice("ab") * rng.randrange(1, n)
    host = lambda: ".".join(part(3) for _ in range(rng.randrange(0, 4)))
    path = lambda: "".join("/" + part(4) * rng.randrange(0, 2) for _ in range(rng.randrange(0, 4)))
    for _ in range(60):
        rules = [(rng.choice(["allow", "block"]), host(), path()) for _ in range(25)]
        trie = urls.Trie(rules)
        for _ in range(60):
            h, p = host(), path()
            assert trie.find(h, p) == slow(rules, h, p), (rules, h, p)


def test_split():
    cases = {
        None: ("", ""), "": ("", ""), "no": ("", ""), "a://": ("", ""), "http://WWW.Ex.com": ("www.ex.com", ""), "x://É.com/A?b#c": ("É.com", "/A"), "x://h?q/r": ("h", ""), "x://h#/": ("h", ""),
        "x://h/a://b?": ("h", "/a://b"), "x://u@h:80/": ("u@h:80", "/"),
    }
    assert {u: urls.host_and_path(u) for u in cases} == cases


def test_column(spark):
    pages = spark.createDataFrame([(1, "http://www.example.com/en/x", "a"), (1, "http://www.example.com/en/x", "a"), (2, "http://a.net/es/", "a"), (3, None, "a"), (4, "http://example.com/en", "a")], "page_id long, url string, rule string")
    found = urls.judge_urls(pages, URL_RULES)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted((r.page_id, r.rule, r.verdict) for r in found.where("page_id <> 3").collect()) == [(1, "www.example.com/en/", "allow")] * 2 + [(2, "net/es/", "block"), (4, "com/", "allow")]
    assert [(r.host, r.rule, r.verdict) for r in found.where("page_id = 3").collect()] == [("", None, "allow")]
    assert urls.judge_urls(pages.limit(0), URL_RULES).collect() == []


def test_columns_with_helper_names_stay(spark):
    pages = spark.createDataFrame([(1, "https://example.com/en/x", "a", "b")], "page_id long, url string, _judged string, host string")
    out = urls.judge_urls(pages, [("block", "example.com", "/en/")])
    assert [tuple(r) for r in out.collect()] == [(1, "https://example.com/en/x", "a", "example.com", "/en/x", "example.com/en/", "block")]
