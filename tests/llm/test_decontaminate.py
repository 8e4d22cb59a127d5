import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from archivist.llm import decontaminate

LONG = " ".join(f"w{k % 977}" for k in range(60_000))


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(docs, items):
    out = []
    windows = {}
    for item, text in items:
        own = _words(text)
        n = min(len(own), 10)
        for k in range(len(own) - n + 1 if n else 0):
            windows.setdefault(tuple(own[k : k + n]), set()).add(item)
    for doc, text in docs:
        own, hit, found = _words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                if (w := tuple(own[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= {str(i) for i in windows[w] if i is not None}
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("at_once", [250_000, 7])
def test_against_brute_force(spark, at_once):
    """Small alphabets, so windows overlap and repeat; at_once 7: windows go to the tasks in many parts."""
    rng = random.Random(3)
    text = lambda n, k: "".join(rng.choice(["A", "b", "é", "7", "zz"][:k]) + rng.choice([" ", ", ", "\n", "\x1f"]) for _ in range(n))
    docs = [(k, text(rng.randrange(60), 2 + k % 4)) for k in range(150)] + [(3, None), (None, "a b"), (200, ""), (201, " .,"), (202, LONG), (202, LONG)]
    items = [(k, text(rng.randrange(9, 14), 5)) for k in range(30)] + [(30, "zz zz é"), (None, "7 7 7 7"), (31, ""), (32, None), (30, "b 7"), (33, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15")]
    found = decontaminate.benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), at_once)
    assert sorted((tuple(r) for r in found.collect()), key=str) == _brute(docs, items)


def test_a_shared_hash_is_no_hit(spark, monkeypatch):
    """Hits are compared word by word: with every hash equal results are the same."""
    monkeypatch.setattr(decontaminate.Texts, "windows", lambda self, width: (self.hashes * 0)[: max(len(self.hashes) - width + 1, 0)])
    words, tables = decontaminate.Texts, decontaminate.Windows
    import pyarrow as pa

    table = tables.of(2, {(0, b"a b "): [0], (0, b"ab c "): [1], (0, b"b c "): [2]})
    where, which = table.find(words(pa.array(["a b c", "x ab C", None, "c"])))
    assert sorted(zip(where.tolist(), [table.words[k] for k in which], strict=True)) == [(0, b"a b "), (1, b"b c "), (4, b"ab c ")]


def test_spans_and_documents_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Keep this: {item.upper()}! And this.", "x"), (2, item, "x"), (3, "é clean ü", "y"), (4, f"{item} " + "w " * 20 + f"é{item} {item}, ü", None), (5, None, "z"), (6, "", "z")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, found string").withColumn("row", F.lit(1))
    items = spark.createDataFrame([("i", item)], "item_id string, text string")
    kept = decontaminate.without_passages(frame, items, share=0.8)
    assert kept.columns == frame.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "Keep this: ! And this.", 3: "é clean ü", 4: " " + "w " * 20 + f"é{item.split()[0]} , ü", 5: None, 6: ""}
    assert {r.doc_id for r in decontaminate.without_passages(frame, items, share=0).collect()} == {3, 5, 6}


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumns({c: F.lit(0) for c in ("row", "found", "hits", "id")})
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string").withColumn("words", F.lit("x"))
    assert decontaminate.benchmark_hits(docs, items.limit(0)).first().n_hit == 0
    assert decontaminate.benchmark_hits(docs.limit(0), items).collect() == []
    assert decontaminate.benchmark_hits(docs, items).first().n_hit == 2
