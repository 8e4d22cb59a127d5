import random

import pytest

from archivist.llm import minhash


def _sets(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset({tuple(words)} if words else ())


def _brute(rows, percent=85):
    """(doc_id, size of the set, component) of every row, where rows of one id are one document."""
    sets = [_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
            if rows[i][0] == rows[j][0] or both:
                root[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), doc), doc)
    return sorted((rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows)))


def _found(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame).collect())


@pytest.mark.parametrize("turned", [False, True])
def test_every_text_of_a_repeated_id_counts(spark, turned):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, f"{a} x"), (3, f"{b} y"), (4, "other words"), (1, "")]
    found = _found(spark, rows[::-1] if turned else rows)
    assert found == _brute(rows) and [c for k, _, c in found if k in (1, 2, 3)] == [1] * 5


@pytest.mark.parametrize("seed", [1, 2])
def test_random_repeated_ids_against_brute_force(spark, seed):
    """Chains of documents that are joined by ids and by similar texts, in random order."""
    rng = random.Random(seed)
    bases = [[f"v{b}_{k}" for k in range(40 + 5 * b)] for b in range(12)]
    rows = []
    for _ in range(90):
        words = list(rng.choice(bases))
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "x"
        rows.append((rng.randrange(40), " ".join(words)))
    rows += [(50, None), (50, "a b"), (51, "A b"), (52, "")]
    assert _found(spark, rows) == _brute(rows)
