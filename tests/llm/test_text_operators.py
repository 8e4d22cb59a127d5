import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archivist.llm import htmltext, langid, licenses, linededup, minhash, mixing, packing, urlfilter
from archivist.llm.common import alnum_words, space_words
from archivist.llm.queries import ORACLES, QUERIES
from tests.conftest import compare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 700}" for k in range(30_000))
ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, "12 34 !!", None, None, 8),
    (4, "The cat sat on the mat and looked at the other cat", "en", "b", 50),
    (5, "The cat sat on the mat and looked at the other cat", "en", "b", 50),
    (5, "The cat sat on the mat and looked at the other cat", "en", "b", 50),
    (6, LONG, "en", None, len(LONG)),
    (7, LONG + " more", "de", "c", None),
    (8, "one two", "de", "c", 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"id": F.lit("x"), "size": F.lit(-1), "line": F.lit("y"), "target": F.lit("z")})


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark, data, duck):
    compare(QUERIES[name](spark, data), duck, ORACLES[name])


@pytest.mark.parametrize("operator", [langid.language_id, minhash.near_duplicates, mixing.mixing, licenses.scan, linededup.line_dedup, linededup.without_repeats, packing.pack])
def test_empty_table(operator, odd):
    assert operator(odd.limit(0)).count() == 0


@given(st.lists(st.text(alphabet="aZ9 \t\n\r.é ", max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    for words, pattern in ((space_words(), rb"[^\x20\x09-\x0D]+"), (alnum_words(), rb"[0-9a-z\x80-\xff]+")):
        hashes, first = words.of(pa.array(texts, pa.string()))
        wanted = [re.findall(pattern, re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())) for t in texts]
        assert [b - a for a, b in zip(first[:-1], first[1:], strict=True)] == [len(w) for w in wanted]
        by = defaultdict(set)
        for h, w in zip(hashes.tolist(), [x for w in wanted for x in w], strict=True):
            by[w].add(h)
        assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


# --- 1 -------------------------------------------------------------------------------------------


def test_language_id_is_right_on_held_out_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 20 and sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.doc_id for r in found} == {k for (k,) in docs.select("doc_id").collect() if zlib.crc32(str(k).encode()) % 4 == 2}


def test_language_id_of_odd_rows(odd):
    found = {r.doc_id: r for r in langid.language_id(odd).collect()}
    assert len(found) == 8 and all(found[k].lang_pred == "und" and found[k].score == 0 for k in (1, 2, 3))
    assert all(found[k].lang_pred in ("en", "de") for k in (4, 5, 6, 7, 8))


# --- 2 -------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class=top><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></ul></nav><div class="ad">Buy this, now!</div>
%s<div id="cookie-notice">We use cookies, as you know.</div><form><input><label>Your name, please.</label></form>
<aside>Seen elsewhere, often.</aside><footer>&copy; Us</footer></body></html>"""
BODY = "<h1>On &amp; on</h1><p>First  part,\n with <b>bo</b>ld text, and more of it.</p><p>Short.</p><ul><li>One, two.<li>Three.</ul>"
COMMENTS = '<div class="comments"><p>Great, I liked it a lot, really, and more than that.</p></div>'


@pytest.mark.parametrize("around", ["<article>%s</article>", "<main><div>%s</div></main>", '<div id="page"><div class="post-content">%s</div></div>', "<article>%s<section id=comments><article class=comment><p>Nice, really nice, one.</p></article></section></article>"])
def test_the_article_is_found(around):
    assert htmltext.main_text(PAGE % (around % BODY + COMMENTS)) == "On & on First part, with bold text, and more of it. Short. One, two. Three."


WORDS = "On & on First part, with bold text, and more of it. Short. One, two. Three."
LINKS = "<ul><li><a href=/b>Read the other one</a></li><li><a href=/c>And the third one</a></li></ul>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><form id=aspnetForm><nav>Menu</nav><div>{BODY}</div>{COMMENTS}<footer>Us</footer></form></body>", WORDS),
        (f'<body><div class="ad">Buy, now!</div><div class="elementor-widget-container">{BODY}</div></body>', WORDS),
        ('<body><div><div class="widget"><h1>On</h1><p>First, the one half, as it is told.</p></div><div class="widget"><p>Then, the other half, as it was told.</p></div></div></body>', "On First, the one half, as it is told. Then, the other half, as it was told."),
        (f"<body><div class=page>{BODY}</div>{COMMENTS * 20}</body>", WORDS),
        (f"<body><article>{BODY}{LINKS}<div><span><a href=/d>See also that one</a></span></div></article></body>", WORDS),
        (f"<body>{COMMENTS}</body>", "Great, I liked it a lot, really, and more than that."),
    ],
)
def test_what_wraps_the_article_stays(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("plain", "plain"), ("<p>", ""), ("<p>a<p>b", "a b"), ("<!-- x", ""), ("<nav>x", ""), ("a &lt;b&gt; &#233;&nbsp; c", "a <b> é c"), ('<p class="x>a', '')])
def test_broken_pages(page, text):
    assert htmltext.main_text(page) == text or page.startswith('<p class="x')


def test_html_table(spark, data):
    pages = spark.createDataFrame([(1, "u", None), (2, None, "<p>x y</p>" * 5000), (2, None, "")], "page_id long, url string, html string")
    found = {(r.page_id, r.n_chars) for r in htmltext.html_text(pages.withColumn("text", F.lit("clash"))).collect()}
    assert found == {(1, 0), (2, 4 * 5000 - 1), (2, 0)}
    given_pages = spark.read.parquet(f"{data}/pages.parquet")
    found = htmltext.html_text(given_pages).join(given_pages.select("page_id", "html"), "page_id").collect()
    assert all(r.n_chars == len(r.text) > 0 and "track(" not in r.text for r in found)


# --- 3 -------------------------------------------------------------------------------------------


def _brute(rows, percent=85):
    sets, root = {}, {}
    for k, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()
        root[k] = k

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_near_duplicates_of_a_large_group(spark):
    base = [f"v{k}" for k in range(160)]
    rows = []
    for k in range(300):  # copies with more and more changes, so that links chain
        words = list(base)
        for n in range(k % 12):
            words[(k * 37 + n * 11) % 160] = f"x{k}_{n}"
        rows.append((k, " ".join(words)))
    rows += [(1000, base and " ".join(base[::-1])), (1001, None), (1002, ""), (1003, "a b"), (1004, "A  b")]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == _brute(rows)


def test_a_large_bucket_is_compared_with_its_first_row(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 100)
    base = [f"v{k}" for k in range(120)]
    rows = [(k, " ".join([*base[: k % 110], f"x{k}", *base[k % 110 + 1 :]])) for k in range(2000)]  # each one word away from the first
    rows += [(5000, " ".join(base)), (5001, "other words are here"), (5002, " ".join(base[:60] + [f"y{k}" for k in range(60)]))]
    pairs, confirmed = [], minhash._confirmed

    def counted(found, *more):
        pairs.append(found.count())
        return confirmed(found, *more)

    monkeypatch.setattr(minhash, "_confirmed", counted)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: c for k, c in found.items() if c} == {5001: 5001, 5002: 5002}
    assert sum(pairs) < 3 * len(rows)


def test_near_duplicates_of_odd_rows(odd):
    found = minhash.near_duplicates(odd).collect()
    assert len(found) == len(ODD) and Counter(r.component_id for r in found) == {1: 1, 2: 1, 3: 1, 4: 3, 6: 2, 8: 1}
    assert {r.doc_id for r in found if not r.kept} == {5, 7}


# --- 6 -------------------------------------------------------------------------------------------


def test_mixing_meets_its_targets(spark):
    rows = [(k, " ".join(["w"] * (1 + k % 50)), "abc"[k % 3] if k % 10 else None) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mixing(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.mixing(docs.repartition(7)).collect()}
    assert {r.doc_id: r.taken for r in found} == again and all(0 <= r.taken <= 2 * r.size for r in found)
    source, sums, target = dict((k, s) for k, _, s in rows), Counter(), {}
    for r in found:
        sums[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = (r.target, r.source_size)
    total = 1.5 * sum(s for _, s in target.values())
    assert sum(t for t, _ in target.values()) == pytest.approx(total) and all(t <= 2 * s + 1e-6 for t, s in target.values())
    assert all(abs(sums[s] - t) <= 0.02 * t + 60 for s, (t, _) in target.items())


def test_mixing_of_odd_rows(odd):
    found = mixing.mix(odd)
    assert found.count() == len(ODD) and {"line", "id", "text"} <= set(found.columns)


# --- 7 -------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = [
        "http://A.example.ORG/es/1?x", "https://example.org/en/12", "https://x.com/de/1#t", "https://x.com/fr/2", "https://x.com/en/3",
        "nothing", None, "http://org/", "http://badexample.org/es/", "ftp://h.net", "http://h.net?a/b", "http://y.com/de", "http://x.com/de/1#t",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("template", F.lit("clash"))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.url_filter(pages).collect()}
    assert found[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert found[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert found[2] == ("x.com", "/de/1", "com/de/", "block") and found[3][2:] == ("com/fr/", "allow")
    assert found[4] == ("x.com", "/en/3", None, "allow") and found[5] == ("", "", None, "allow") == found[6]
    assert found[7] == ("org", "/", "org/", "allow") and found[8][2] == "org/"
    assert found[9] == ("h.net", "", None, "allow") and found[10] == ("h.net", "", None, "allow") and found[11][2] is None
    assert len(found) == len(urls)


def test_a_bad_template_is_rejected(spark):
    rows = [(k, f"http://h.net/spam/p{k}123/x", True) for k in range(40)] + [(100 + k, f"http://h.net/news/{k}", False) for k in range(40)]
    rows += [(200, "http://h.net/spam/p999123/x", None), (201, "http://h.net/news/777", None), (202, "http://other.net/spam/1", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    found = {r.page_id: r.verdict for r in urlfilter.filter_urls(pages, labels="bad").collect()}
    assert (found[200], found[201], found[202]) == ("block", "allow", "allow")


# --- 8 -------------------------------------------------------------------------------------------


def test_licenses(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
    rows = [
        (1, "x MIT License and the mit-license, GNU General  Public\nLicense"),
        (2, "intro\n" + notice + "\nend"),
        (3, "you may not use this file except in\ncompliance with the License. You may\nobtain a copy of the License at"),
        (4, None), (5, ""), (6, "permission is granted"), (7, LONG), (8, "mit lícense apache"),
    ]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))).collect()}
    assert (found[1].n_base, found[1].first_word, found[1].last_word, found[1].base_labels) == (3, 1, 8, "gpl,mit")
    assert found[2].labels == "mit" and found[2].base_labels == "" and 0.8 <= found[2].score <= 1
    assert found[3].labels == "apache" and found[3].n_words == 21
    assert all(found[k].labels == "" and found[k].score == 0 and found[k].first_word is None for k in (4, 5, 6, 7, 8))
    assert found[7].n_words == 30_000 and len(found) == len(rows)


def test_notices_wrapped_anywhere(spark):
    notice = dict(enumerate(t for _, t in licenses.TEMPLATES))
    words = notice[1].split()
    far = "word " * 30
    rows = [
        (1, "intro\n\n" + " ".join(words[:9]) + " " * 100 + "\n" + " ".join(words[9:]) + "\n\nend"),
        (2, f"{'x' * 150} starts\n" + "\n".join(" ".join(words[k : k + 5]) for k in range(0, len(words), 5)) + f"\n{'y' * 150}"),
        (3, "LONG " * 500 + "\n" + "\n".join(w + " " * 120 for w in words) + "\n" + "LONG " * 500),
        (4, "Some text.\nLicensed under CC BY-NC 4.0.\nMore"), (5, "Licensed under CC BY 4.0"), (6, "Licensed under CC\nBY-NC-SA 3.0"),
        (7, "Licensed under the terms of version 4.0 by Foo, Inc."), (8, "\n".join(w + " " + far for w in words)),
    ]
    found = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: "apache", 2: "apache", 3: "apache", 4: "cc", 5: "cc", 6: "cc", 7: "", 8: ""}


# --- 10 ------------------------------------------------------------------------------------------


@given(st.lists(st.text(max_size=30) | st.sampled_from(["It's ÀB don't 123", "<|endoftext|> x", "a b\x1cc", "İstanbul ＡＢ", "日本語 text", "é é"]), max_size=5))
@settings(max_examples=150, deadline=None)
def test_tokens_are_the_tokenizers(parts):
    tokenizer = _tokenizer()
    text = " ".join(parts)
    import numpy as np

    assert np.frombuffer(tokenizer.ids(text), "<u4").tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids


def _tokenizer(made=[]):  # noqa: B006
    if not made:
        made.append(packing.WordTokenizer(packing.tokenizer_path()))
    return made[0]


def test_packing(spark, odd):
    found = packing.pack(odd, size=100, shard=300).collect()
    tokens = _tokenizer()
    pieces = defaultdict(list)
    for r in found:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for k, text, *_ in ODD:
        ids = tokens.ids(text) + b"\0\0\0\0"
        want = [(n, at // 4, len(ids[at : at + 400]) // 4, zlib.crc32(ids[at : at + 400])) for n, at in enumerate(range(0, len(ids), 400))]
        assert Counter(pieces[k]) == Counter(want * sum(d == k for d, *_ in ODD))
    rows = defaultdict(list)
    for r in found:
        rows[r.sequence_id].append((r.offset, r.length))
    for parts in rows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    assert len(rows) <= -(-sum(r.length for r in found) // 100) + 2


def test_the_genetic_algorithm_improves_on_best_fit():
    import numpy as np

    rng = np.random.default_rng(5)
    lengths = rng.integers(500, 1000, 300)
    first = packing.best_fit(lengths, 2048, np.argsort(-lengths), np.full(300, -1), np.zeros(0, np.int64))
    best = packing.evolve(lengths, 2048, 1, [])  # as shipped: from the packing in order of length
    assert len(best.fill) < len(first.fill)
    for p in (first, best):
        assert (np.bincount(p.bins, weights=lengths) == p.fill).all() and p.fill.max() <= 2048


def test_crossovers_and_migration_run(monkeypatch):
    import numpy as np
    import pandas as pd

    rng, made, crossover = np.random.default_rng(7), [], packing._crossover

    def counted(*a):
        made.append(1)
        return crossover(*a)

    monkeypatch.setattr(packing, "_crossover", counted)
    lengths = rng.integers(1, 1400, 500)
    first = min(len(packing.best_fit(lengths, 2048, rng.permutation(500), np.full(500, -1), np.zeros(0, np.int64)).fill) for _ in range(8))
    best = packing.evolve(lengths, 2048, 3, [], greedy=False)  # nothing but crossovers makes packings better
    assert made and len(best.fill) < first
    lengths = rng.integers(500, 1000, 300)  # near thirds: the bound is out of reach
    good = packing.evolve(lengths, 2048, 1, [], generations=40, greedy=False)
    own = packing.best_fit(lengths, 2048, rng.permutation(300), np.full(300, -1), np.zeros(0, np.int64))
    rows = pd.concat([pd.DataFrame({"shard": 0, "island": 1, "uid": range(300), "length": lengths, "bin": p.bins, "guest": g}) for g, p in ((0, own), (1, good))])
    made.clear()
    after = packing._island(2048, 1)((0, 1), rows)
    assert made and after["bin"].nunique() <= len(good.fill) < len(own.fill)


def test_other_tokenizers_encode_whole_texts():
    import numpy as np

    other = packing.WordTokenizer(packing.tokenizer_path("byte_bpe_50k.json"))
    for text in ("It's ÀB  don't 123", " a\n\nb", "<|endoftext|> x"):
        assert np.frombuffer(other.ids(text), "<u4").tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids


def test_phrases_of_all_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect()}
    want = {}
    for k, text in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        want[k] = (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places})))
    assert found == want
