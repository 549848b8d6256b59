"""The URL filter over whole tables: rules and verdicts by brute force, and what the model blocks that it has not seen."""

import math
import re
import zlib

from claimweave.llm import queries, url_filter

SF = "/root/testdata/sf0.01"
#: Words in the hosts of the given pages that are not wanted there.
UNWANTED = re.compile("casino|bets|pills|ads-|spam|adult")


def test_verdicts_by_brute_force(spark):
    weights, bias = url_filter.train()
    expected = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, told) for told, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        grams = {zlib.crc32(s[i : i + n].encode()) % url_filter.BUCKETS for s in (f"^{host}$", "/" + path) for n in (3, 4, 5) for i in range(len(s) - n + 1)} if host or path else set()
        p = 1 / (1 + math.exp(-(sum(weights[g] for g in grams) / math.sqrt(len(grams)) + bias))) if grams else 0.0
        rule = max(fits) if fits else None
        expected[r.page_id] = (host, path, rule[1] if rule else None, rule[2] if rule else "block" if p >= 0.5 else "allow")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op8_url_filter(spark, SF).collect()}
    assert got == expected


def test_unseen_hosts_are_blocked(spark):
    """None of the hosts is in the labelled table; without rules, most unwanted ones are blocked, and no other."""
    rows = [r for r in url_filter.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), rules=()).collect() if r.host]
    seen = {url_filter._parts(u)[0] for u, _ in url_filter.LABELLED}
    unwanted, others = [r for r in rows if UNWANTED.search(r.host)], [r for r in rows if not UNWANTED.search(r.host)]
    assert not {r.host for r in rows} & seen and len(unwanted) > 50 and len(others) > 1000
    assert sum(r.verdict == "block" for r in unwanted) >= 0.85 * len(unwanted) and not any(r.verdict == "block" for r in others)


def test_rules_of_one_length(spark):
    """The earlier of two rules of one length wins; longer ones win over both."""
    rules = (("block", "a.org", "/x"), ("allow", "org", "/x/y"), ("allow", "b.a.org", "/x"))
    pages = spark.createDataFrame([(1, "http://c.a.org/x/y", "h"), (2, "http://b.a.org/x/y", "h"), (1, "http://c.a.org/x/y", "h"), (None, "http://org/x/y", "h")], "page_id long, url string, host string")
    got = {(r.page_id, r.host): (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    first = max(rules[:2], key=lambda r: len(r[1] + r[2]))
    assert got == {(1, "c.a.org"): (first[1] + first[2], first[0]), (2, "b.a.org"): ("b.a.org/x", "allow"), (None, "org"): ("org/x/y", "allow")}
