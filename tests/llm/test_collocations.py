import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivist.llm import collocations


def _brute(rows, best=2000):
    count, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                count[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        mine = {p: a for p, a in f.items() if len(p) > 1 and a >= 30}
        gone = {p[i:j] for p, a in mine.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * f[p[i:j]]}
        rows = []
        for p, a in mine.items():
            if p not in gone:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:best])]
    return sorted(out)


def _rows(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["É", "Z" * 3000, "a", "\x00", "\x1f"]
    text = lambda: "".join(rng.choice(words[: rng.randrange(2, len(words) + 1)]) + rng.choice(["  ", " ", " ", " ", "\t", ". ", "\n", ":"]) for _ in range(rng.randrange(80)))
    return [(text(), rng.choice(["en", "en", "de", None, "und"])) for _ in range(250)] + [(None, "en"), ("", None), (" ,. ", "fr"), ("x y " * 9000, "fr"), ("same words here", "it")] + [("same words here", "it")] * 40


@pytest.mark.parametrize(("held", "at_once", "pairs"), [(1 << 20, 500_000, 1_000_000), (50, 4, 1_000_000), (1 << 20, 500_000, 3)])
def test_against_brute_force(spark, monkeypatch, held, at_once, pairs):
    """Also with windows counted in many turns, words looked up in many parts, and rare pairs not cut."""
    monkeypatch.setattr(collocations, "PAIRS", pairs)
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "AT_ONCE", at_once)
    rows = _rows(at_once)
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumns({c: F.lit(1) for c in ("n", "word", "score", "key")})
    found = collocations.collocations(frame)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == _brute(rows)
    assert sorted(tuple(r) for r in collocations.collocations(frame, best=3).collect()) == _brute(rows, 3)


def test_windows_are_padded_and_counted_once(spark):
    """A row for each window of three words and more, whose prefixes are all longer phrases."""
    docs = spark.createDataFrame([("a b c d e. a b", "en"), ("a rare b a", "en")], "text string, lang string")
    words = spark.createDataFrame([("en", w, k + 1) for k, w in enumerate("abcde")], "lang string, word string, id long")
    rows = collocations.windows(docs, words).groupBy("pair", "third", "fourth").agg(F.sum("n").alias("n")).collect()
    split = lambda r: (r.pair >> 32, r.pair & 0xFFFFFFFF, r.third, r.fourth, r.n)
    cut = collocations.windows(docs, words, pairs=np.array([(1 << 32) | 2, (2 << 32) | 3])).groupBy("pair", "third", "fourth").agg(F.sum("n").alias("n")).collect()
    assert sorted(map(split, cut)) == [(1, 2, 3, 0, 1)]
    assert sorted(map(split, rows)) == [(1, 2, 3, 4, 1), (2, 3, 4, 5, 1), (3, 4, 5, 0, 1)]
    pairs, _ = collocations.frequent_pairs(docs, words, least=1)
    assert sorted((r.pair >> 32, r.pair & 0xFFFFFFFF, r.f) for r in pairs.collect()) == [(1, 2, 2), (2, 1, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1)]


def test_scores_beyond_64_bits(spark):
    big = 10**15
    key = lambda *w: ((w + (0,) * 4)[0] << 32 | (w + (0,) * 4)[1], (w + (0,) * 4)[2] << 32 | (w + (0,) * 4)[3])
    found = spark.createDataFrame([(key(1, 2), 2, 3 * big)], "key struct<head:long,tail:long>, size int, f long")
    words = spark.createDataFrame([(1, 7 * big), (2, 5 * big)], "id long, n long")
    assert [(r.score, r.l, r.r) for r in collocations.scored(found, words).collect()] == [(2_000_000 * 3 // 12, 7 * big, 5 * big)]


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
