import inspect
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from archivist.llm import linededup

KIND = "doc_id long, text string"
LINE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def _brute(rows, threshold=0.8):
    """(doc_id, line): kept of all lines, each compared with all before it."""
    lines = sorted((k, n, value) for k, text in rows if text is not None for n, value in enumerate(text.split("\n")))
    sets, out = [], {}
    for k, n, value in lines:
        w = value.lower().split()
        own = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
        out[k, n] = not any(own and len(own & x) >= threshold * len(own | x) - 1e-9 for x in sets)
        sets.append(own)
    return out


def _kept(frame):
    return {(r.doc_id, r.line): r.kept for r in frame.collect()}


def test_lines(spark):
    near = LINE + " twentyone"
    rows = [(2, f"{near}\nshort line\n\n{LINE}"), (1, f"{LINE}\nshort line\nfresh words that nobody else has written"), (3, LINE), (4, None), (5, ""), (6, LINE.upper())]
    docs = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("clash") for c in ("tokens", "gone", "_gone", "_left", "lines", "row")})
    assert _kept(linededup.line_dedup(docs)) == _brute(rows)
    left = linededup.without_repeats(docs).collect()
    assert {r.doc_id: r.text for r in left} == {1: rows[1][1], 4: None, 5: ""}
    assert all(r["_gone"] == "clash" and r["row"] == "clash" for r in left)


def test_short_lines(spark):
    rows = [(1, "And ornd.\none two three four five\n\nAnd  ORND."), (2, "and ornd.\n\nand\none two three four"), (3, " \nand ornd. it\none two three four\nAnd"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, KIND)
    gone = {tuple(r) for r in linededup.repeated_lines(docs).collect()}
    assert gone == {(1, 3), (2, 0), (3, 2), (3, 3)}
    left = {r.doc_id: r.text for r in linededup.without_repeats(docs).collect()}
    assert left == {1: "And ornd.\none two three four five\n", 2: "\nand\none two three four", 3: " \nand ornd. it", 4: None, 5: ""}


def test_an_exact_repeat_of_a_short_line_goes(spark):
    docs = spark.createDataFrame([(1, "a text\nall rights reserved"), (2, "All rights reserved\nother")], KIND)
    assert {r.doc_id: r.text for r in linededup.without_repeats(docs).collect()} == {1: "a text\nall rights reserved", 2: "other"}


@pytest.mark.parametrize("seed", [1])
def test_random_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 6, 12, 30, 60]))] for _ in range(12)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            words = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
            lines.append(rng.choice(["", " ", "\t"]) + rng.choice([" ", "  ", "\t "]).join(words))
        rows.append((k, "\n".join(lines) if k % 11 else None))
    assert _kept(linededup.line_dedup(spark.createDataFrame(rows, KIND))) == _brute(rows)


def test_lines_with_one_frame_do_not_meet_pairwise(spark, monkeypatch):
    frame = [f"f{k}" for k in range(60)]
    rows = [(k, " ".join([*frame[:30], *[f"x{k}_{n}" for n in range(8 + k % 5)], *frame[30:]])) for k in range(2000)]  # 0.6 to 0.7 alike
    met, verified = [], linededup._verified

    def counted(pairs, *more):
        met.append(pairs.select("x_id", "y_id").distinct().count())
        return verified(pairs, *more)

    monkeypatch.setattr(linededup, "_verified", counted)
    assert all(_kept(linededup.line_dedup(spark.createDataFrame(rows, KIND))).values())
    assert sum(met) < 2000


def test_odd_rows(spark):
    long = " ".join(f"w{k % 700}" for k in range(30_000))
    rows = [(None, "one two"), (1, "one two"), (None, "x y z"), (7, long), (8, long + " more"), (9, "\n" * 5_000 + "one two"), (9, "\n" * 5_000 + "one two")]
    docs = spark.createDataFrame(rows, KIND).withColumn("n_chars", F.length("text").cast("long"))
    found = linededup.line_dedup(docs).where("not kept").collect()
    assert sorted((r.doc_id or -1, r.line) for r in found) == [(-1, 0), (8, 0), (9, 5_000), (9, 5_000)]
    left = {(r.doc_id, r.text, r.n_chars) for r in linededup.without_repeats(docs).collect()}
    assert left == {(1, "one two", 7), (None, "x y z", 5), (7, long, len(long))}


def test_no_python_on_the_main_path():
    source = inspect.getsource(linededup)
    assert not any(name in source for name in ("udf", "mapInPandas", "mapInArrow", "applyIn", ".rdd"))


def test_shared_tokens_are_shuffled_once(spark):
    tokens = spark.createDataFrame([(1, 1, 0), (1, 2, 5), (2, 1, 1), (3, 3, 0), (3, 1, 2), (3, 2, 2)], "token long, id long, np long")
    found = linededup._shared(tokens)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 0), (1, 2, 5), (3, 1, 2), (3, 2, 2), (3, 3, 0)]
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


@pytest.mark.parametrize("width", [1, 2, 3, 5, 6, 7])
def test_tokens_are_plain_numbers_ranked_by_the_count_of_the_same_hash(spark, width):
    frame = " ".join(f"f{k}" for k in range(9))
    rows = [(k, 0, f" {frame}\t" + " ".join(f"x{k}_{n}" for n in range(4)) + " ") for k in range(5)]
    lines = spark.createDataFrame(rows, "doc_id long, line int, value string")
    made = linededup.line_tokens(lines, width, linededup.shingle_ranks(lines, width))
    assert not made.schema["tokens"].dataType.containsNull  # else they are sorted as objects
    tokens = [r.tokens for r in made.collect()]
    assert all(len(t) == 13 - width + 1 for t in tokens)
    assert len({tuple(t[-(9 - width + 1) :]) for t in tokens}) == 1  # what all lines have comes last


def test_frequent_tokens_of_prefixes_come_last_without_a_count_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(linededup, "OFTEN", 3)
    monkeypatch.setattr(linededup, "shingle_ranks", None)  # no pass over all texts before they are cut into tokens
    remade, often_last, frequent, counted = [], linededup._often_last, set(), linededup._frequent

    def kept(tokens):
        out = counted(tokens)
        frequent.update(r.token for r in out.collect())
        return out

    monkeypatch.setattr(linededup, "_frequent", kept)

    def noted(tokens, *more):
        out = often_last(tokens, *more)
        before, after = ({(r.id, r.p, r.n, r.token) for r in t.collect()} for t in (tokens, out))
        assert {t for t, n in Counter(r[3] for r in before).items() if n > 3} <= frequent
        assert {r[0] for r in before ^ after} <= {r[0] for r in before if r[3] in frequent}
        assert Counter(r[0] for r in before) == Counter(r[0] for r in after)
        by = {k: [r[3] for r in sorted(r for r in after if r[0] == k)] for k in {r[0] for r in after}}
        assert all(t == sorted(t, key=lambda x: (x in frequent, x)) for t in by.values())
        remade.append(len(before ^ after))
        return out

    monkeypatch.setattr(linededup, "_often_last", noted)
    rng = random.Random(5)
    frame = [f"f{k}" for k in range(24)]
    rows = [(k, " ".join([*frame, *[f"x{rng.randrange(40)}" for _ in range(k % 9)]]) + "\n" + " ".join(f"y{rng.randrange(9)}" for _ in range(7))) for k in range(60)]
    assert _kept(linededup.line_dedup(spark.createDataFrame(rows, KIND))) == _brute(rows)
    assert remade[0] > 0
