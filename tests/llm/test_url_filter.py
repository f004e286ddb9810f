import random
import re

import pytest
from corpus import SF

from check_oracle import compare, connect
from starmill.llm import url_filter as u
from starmill.llm.queries import ORACLES, QUERIES, URL_RULES


def brute(url, rules, default="allow"):
    found = re.search("://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in found.group(1)) if found else ""
    path = found.group(2) if found else ""
    fits = [
        (len(h.split(".")) if h else 0, len(p), v == "block", h + p, v)
        for v, h, p in rules
        if host and (not h or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return (host, path, best[3] if best else None, best[4] if best else default)


RULES = [
    *URL_RULES, ("block", "a.example.org", "/x"), ("allow", "a.example.org", "/x/y"),
    ("block", "a.example.org", "/x/y"), ("allow", "", "/free/"), ("block", "bad.org", ""),
]
URLS = [
    None, "", "no scheme", "http://", "http://NET/", "http://net", "http://x.net?q", "https://é.NET/é",
    "http://a.example.org/x", "http://a.example.org/xyz", "http://b.a.example.org/x/y/z#f",
    "http://notexample.net/en/1", "http://example.net/en/", "http://example.net/en",
    "ftp://www.example.com/de/a://b", "http://org/fr/?x", "http://any.where/free/x", "http://bad.org",
    "http://x.bad.org?y", "http://a..net/", "http://example.net:80/en/1", "http://net/" + "a/" * 5000,
]


def rows(frame):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in frame.collect()}


@pytest.mark.parametrize("broadcast_rules", [100, 0])
def test_trie_and_join_match_brute_force(spark, broadcast_rules):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    found = rows(u.filter_urls(pages, RULES, broadcast_rules=broadcast_rules))
    assert found == {i: brute(url, RULES) for i, url in enumerate(URLS)}


def test_random_rules(spark):
    draw = random.Random(5)
    labels, parts = ["a", "b", "com", ""], ["", "x", "xy", "y"]
    given = {
        (draw.choice(["allow", "block"]), ".".join(draw.choices(labels[:3], k=draw.randint(1, 3))),
         "/" + "/".join(draw.choices(parts, k=draw.randint(1, 3)))) for _ in range(60)
    }
    urls = [
        "http://" + ".".join(draw.choices(labels, k=draw.randint(1, 4))) + "/"
        + "/".join(draw.choices(parts, k=draw.randint(0, 4))) for _ in range(300)
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    expected = {i: brute(url, given) for i, url in enumerate(urls)}
    frame = spark.createDataFrame(list(given), "verdict string, host string, path string")
    assert rows(u.filter_urls(pages, frame)) == expected
    assert rows(u.filter_urls(pages, frame, broadcast_rules=0)) == expected


def test_capitals_and_nulls_in_rules_count_alike_everywhere(spark):
    """The same rules as list and frame, below and beyond the number that is broadcast."""
    draw = random.Random(8)
    hosts = ["Example.COM", "example.com", "B.example.com", "É.com", "com", "", None]
    paths = ["/", "/a", "/A/", "/a/bc", "a", "", None]
    given = [(draw.choice(["allow", "block", None]), draw.choice(hosts), draw.choice(paths))
             for _ in range(12)]
    urls = [f"http://{h}{p}" for h in ("example.com", "b.EXAMPLE.com", "é.com", "x.com", "org")
            for p in ("", "/", "/a", "/abc", "/A/b", "/a/b", "/a/bcd/e", "/" + "a/" * 400)]
    pages = spark.createDataFrame(list(enumerate([*urls, None])), "page_id long, url string")
    frame = spark.createDataFrame(given, "verdict string, host string, path string")
    lowered = [(v or "block", "".join(c.lower() if c.isascii() else c for c in h or ""), p or "")
               for v, h, p in given]
    expected = {i: brute(url, lowered, "block") for i, url in enumerate([*urls, None])}
    for rules in (given, frame):
        for limit in (100, 0):
            found = rows(u.filter_urls(pages, rules, default="block", broadcast_rules=limit))
            assert found == expected


def test_a_folder_of_many_rules_is_looked_up_by_length(spark):
    trie = u.Trie([("block", "net", f"/{k}") for k in range(20_000)])
    place = trie.root.children["net"].paths.children[""]
    assert place.lengths == [5, 4, 3, 2, 1] and len(place.ends) == 20_000
    assert trie.match("x.net", "/1234567") == ("block", "net", "/12345")



def test_clashing_columns_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://x.net/", "old")], "page_id long, url string, Rule string")
    row = u.filter_urls(pages, URL_RULES).first()
    assert row.asDict() == {"page_id": 1, "url": "http://x.net/", "host": "x.net", "path": "/",
                            "rule": "net/", "verdict": "block"}
    assert u.filter_urls(pages.where("false"), URL_RULES).count() == 0
    assert u.filter_urls(pages, []).first().verdict == "allow"


def test_oracle(spark):
    verdict, _ = compare(spark, connect(SF), SF, "op1", QUERIES["op1_url_filter"], ORACLES["op1_url_filter"])
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict
