import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from archivist.llm import urlfilter

KIND = "page_id long, url string, bad boolean"


def test_unlabelled_urls_are_judged_by_their_branch(spark):
    rows = [(k, f"http://h.net/forum/{'abcdefgh'[k % 8]}/t", True) for k in range(40)] + [(100 + k, f"http://h.net/news/{'abcdefgh'[k % 8]}", False) for k in range(40)]
    rows += [(200, "http://h.net/forum/never-seen/x/y", None), (201, "http://h.net/news/other", None), (202, "http://clean.net/forum/a/t", None), (203, "http://h.net/other", None)]
    found = {r.page_id: (r.verdict, r.template) for r in urlfilter.filter_urls(spark.createDataFrame(rows, KIND), labels="bad").collect()}
    assert found[200] == ("block", "forum/*/x/y") and found[201] == ("allow", "news/*")
    assert found[202][0] == "allow" and found[203][0] == "allow"


def _brute(pages, z=2.0, prior=0.25, weight=4.0):
    """(template, rate) of each (host, shape) by walking the tree of all pages."""
    below = defaultdict(lambda: [0, 0])
    for host, shape, bad in pages:
        for n in range(len(shape) + 1):
            s = below[host, shape[:n]]
            s[0] += bad is not None
            s[1] += bool(bad)
    children = defaultdict(set)
    for host, branch in below:
        if branch:
            children[host, branch[:-1]].add(branch)

    def name(host, branch):
        beside = children[host, branch[:-1]]
        seen, blocked = below[host, branch]
        every, bad = (sum(below[host, b][k] for b in beside) for k in (0, 1))
        if len(beside) == 1:
            return branch[-1]
        if seen and every - seen:
            share = (bad + 0.5) / (every + 1)
            if abs(blocked / seen - (bad - blocked) / (every - seen)) > z * math.sqrt(share * (1 - share) * (1 / seen + 1 / (every - seen))):
                return branch[-1]
        return "*"

    template = {(h, s): tuple(name(h, s[: n + 1]) for n in range(len(s))) for h, s, _ in pages}
    merged = defaultdict(lambda: [0, 0])
    for host, shape, bad in pages:
        t = template[host, shape]
        for n in range(len(t) + 1):
            merged[host, t[:n]][0] += bad is not None
            merged[host, t[:n]][1] += bool(bad)
    out = {}
    for (host, shape), t in template.items():
        rate, before = prior, -1
        for n in range(len(t) + 1):
            seen, blocked = merged[host, t[:n]]
            if seen != before:
                rate, before = (blocked + weight * rate) / (seen + weight), seen
        out[host, shape] = "/".join(t), rate
    return out


def _literal(s):
    name = re.sub(r"\.[A-Za-z0-9]{1,5}$", "", s)
    varies = re.search(r"^[0-9]+$|^[0-9a-fA-F-]{16,}$|[0-9].*[0-9].*[0-9]", name)
    return "*" + s[len(name) :] if varies else s


def test_tree_of_all_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame([(10**6 + k, f"http://big.com/{'fr' if k % 3 else 'de'}/{k % 7}/a{k % 5}/b.html", ) for k in range(300)], "page_id long, url string"))
    found = urlfilter.filter_urls(pages).collect()
    rules = dict(urlfilter.RULES)
    rows = [(r.host, tuple(_literal(s) for s in r.path.split("/") if s), None if r.rule is None else rules[r.rule] == "block") for r in found]
    want = _brute(rows)
    for r, (host, shape, bad) in zip(found, rows, strict=True):
        template, rate = want[host, shape]
        assert (r.template, r.rate) == (template, pytest.approx(rate))
        assert r.verdict == ("block" if (rate > 0.5 if bad is None else bad) else "allow")
    assert len(found) == pages.count() and Counter(r.page_id for r in found).most_common(1)[0][1] == 1


def test_odd_tables(spark):
    assert urlfilter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0
    long = "http://x.net/" + "/".join(["seg"] * 600)
    rows = [(1, long), (2, "http://x.net/" + "a" * 20_000), (3, None), (3, None), (None, "http://x.net//")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "shape", "rate", "_u_host", "level", "row")})
    found = urlfilter.filter_urls(pages).collect()
    assert len(found) == 5 and all(r.row == "clash" and r.level == "clash" and r.verdict == "allow" for r in found)
    assert {r.template for r in found if r.page_id == 1} == {"*/" + "/".join(["seg"] * 599)}
