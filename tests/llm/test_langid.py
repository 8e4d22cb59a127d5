import math
import random

import numpy as np
import pytest

from archivist.llm import langid


def _grams(text, n):
    """n-grams of letters, all runs of other characters as one blank, as hashed by the operator."""
    return set(np.flatnonzero(langid.presence(text)[langid._START[n - 1] : langid._START[n]]).tolist())


def _texts(seed, letters, count):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(3, 40))) for _ in range(count)]


def test_presence_is_that_of_the_text():
    text = "Ab, ab!  Zé 12 b"
    clean, blank = "", False
    for c in text.lower():
        blank = not c.isalpha()
        if not blank or not clean.endswith(" "):
            clean += " " if blank else c
    for n, bits in enumerate((12, 14, 16), 1):
        assert len(_grams(text, n)) <= len({(clean + " ")[k : k + n] for k in range(len(clean))})
        assert langid.presence(text)[langid._START[n - 1] : langid._START[n]].sum() == len(_grams(text, n)) <= 1 << bits
    assert langid.presence("12 !?") is None and langid.presence("") is None and langid.presence(None) is None
    long = "ab cd " * 400_000  # cut into pieces: no n-gram is lost or new
    assert (langid.presence(long) == langid.presence("ab cd " * 5)).all()


def test_kernel_and_ridge_against_their_definitions():
    sample = [("x", t) for t in _texts(1, "abcdefg ", 30)] + [("y", t) for t in _texts(2, "efghijk ", 20)]
    model = langid.fit([(lang, np.packbits(langid.presence(t)).tobytes()) for lang, t in sample], landmarks=12)
    first = {lang: [t for name, t in sample if name == lang][:6] for lang in ("x", "y")}
    marks = [t for pair in zip(first["x"], first["y"], strict=True) for t in pair]

    def kernel(a, b):
        return sum(len(_grams(a, n) & _grams(b, n)) / math.sqrt(len(_grams(a, n)) * len(_grams(b, n))) for n in (1, 2, 3)) / 3

    within = np.array([[kernel(a, b) for b in marks] for a in marks])
    across = np.array([[kernel(t, b) for b in marks] for _, t in sample])
    assert model.kernel([langid.presence(t) for _, t in sample]) == pytest.approx(across, abs=1e-5)
    values, vectors = np.linalg.eigh(within)
    root = vectors / np.sqrt(values)
    x, wanted = across @ root, np.array([[1.0 if lang == name else -1.0 for name in ("x", "y")] for lang, _ in sample])
    weigh = np.array([len(sample) / (2 * sum(o == lang for o, _ in sample)) for lang, _ in sample])[:, None]
    direct = x @ np.linalg.solve(x.T @ (weigh * x) + 1e-3 * len(sample) * np.eye(len(marks)), x.T @ (weigh * wanted))
    assert model.scores([langid.presence(t) for _, t in sample]) == pytest.approx(direct, abs=1e-2)
