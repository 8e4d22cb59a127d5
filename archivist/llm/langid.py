"""Language identification with string kernels.

Two texts are compared by the blended spectrum of their character n-grams: for n = 1, 2 and 3 the
presence kernel ``|N(x) & N(y)| / sqrt(|N(x)| |N(y)|)``, averaged over n. A bounded sample of
labelled texts trains one-versus-rest kernel ridge regression on Nystroem features of a few
landmark texts; every text is then scored by two matrix products for a whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archivist.llm.common import small_batches, unit_hash

#: Hash bits for the n-grams of each length from 1.
_BITS = (12, 14, 16)
_START = np.concatenate([[0], np.cumsum([1 << b for b in _BITS])])
_SIZE = int(_START[-1])
_PIECE = 1 << 20
_LETTER: list[np.ndarray] = []
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    if not _LETTER:
        table = np.zeros(0x110000, np.uint64)
        for code in range(0x110000):
            if chr(code).isalpha():
                table[code] = code
        _LETTER.append(table)
    return _LETTER[0]


def presence(text: str | None) -> np.ndarray | None:
    """Which hashed n-grams of letters the whole text has (runs of other characters count as one
    blank); None without a letter."""
    if not text:
        return None
    table, out, found = _letters(), np.zeros(_SIZE, np.uint8), False
    before, end = np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    for at in range(0, len(text), _PIECE):
        piece = text[at : at + _PIECE].lower()
        codes = table[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
        found |= bool(codes.any())
        codes = np.concatenate([before, codes, end if at + _PIECE >= len(text) else end[:0]])
        blank = codes == 0
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1]
        keep[:1] = True
        codes = codes[keep]
        before = codes[1 - len(_BITS) :]  # what the next piece's first n-grams begin with
        total = np.zeros(len(codes), np.uint64)
        for n, bits in enumerate(_BITS, 1):
            if len(codes) < n:
                break
            total = total[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
            spread = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[(spread >> np.uint64(64 - bits)).astype(np.int64) + _START[n - 1]] = 1
    return out if found else None


@dataclass
class Model:
    """``columns``: n-grams that a landmark has; ``landmarks``: their scaled presence, one column a
    landmark; ``weights``: from kernel values to one score a language."""

    langs: list[str]
    columns: np.ndarray
    group: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    sharpness: float

    def kernel(self, rows: list[np.ndarray]) -> np.ndarray:
        scaled = np.empty((len(rows), len(self.columns)), np.float32)
        for k, row in enumerate(rows):
            sizes = np.add.reduceat(row, _START[:-1], dtype=np.int64)
            scaled[k] = row[self.columns] * (1 / np.sqrt(np.maximum(sizes, 1))).astype(np.float32)[self.group]
        return scaled @ self.landmarks

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.kernel(rows) @ self.weights


def _scaled(rows: np.ndarray, columns: np.ndarray, group: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return rows[:, columns] / np.sqrt(np.maximum(sizes, 1))[:, group] / len(_BITS)


def fit(sample: list[tuple[str, bytes]], landmarks: int = 192, ridge: float = 1e-3) -> Model | None:
    """Train on rows of (language, packed presence bits); None without rows."""
    if not sample:
        return None
    langs = sorted({lang for lang, _ in sample})
    unpacked = lambda k: np.unpackbits(np.frombuffer(sample[k][1], np.uint8), count=_SIZE)
    target = np.array([langs.index(lang) for lang, _ in sample])
    turn = np.zeros(len(sample), int)  # a landmark from each language in turn
    for k in range(len(langs)):
        turn[target == k] = np.arange(int((target == k).sum()))
    chosen = np.lexsort((target, turn))[:landmarks]
    base = np.stack([unpacked(k) for k in chosen])
    columns = np.flatnonzero(base.any(axis=0))
    group = np.searchsorted(_START, columns, "right") - 1
    marks = _scaled(base, columns, group, np.add.reduceat(base, _START[:-1], axis=1, dtype=np.int64)).T
    model = Model(langs, columns, group, marks.astype(np.float32), np.zeros((len(chosen), len(langs)), np.float32), 1.0)
    within = model.kernel(list(base)).astype(np.float64)
    values, vectors = np.linalg.eigh((within + within.T) / 2)
    keep = values > values[-1] * 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nystroem: features are kernel @ root
    features = np.concatenate([model.kernel([unpacked(n) for n in range(k, min(k + 128, len(sample)))]) for k in range(0, len(sample), 128)]).astype(np.float64) @ root
    wanted = np.where(target[:, None] == np.arange(len(langs)), 1.0, -1.0)
    share = np.bincount(target, minlength=len(langs))
    weigh = (len(target) / (len(langs) * share))[target][:, None]  # each language counts the same
    gram = features.T @ (weigh * features) + ridge * len(target) * np.eye(features.shape[1])
    model.weights = (root @ np.linalg.solve(gram, features.T @ (weigh * wanted))).astype(np.float32)
    model.sharpness = 4.0
    return model


def packed_presence(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([None if (row := presence(text)) is None else np.packbits(row).tobytes() for text in batch], dtype=object)


def training_sample(labelled: DataFrame, text: str, lang: str, key: str, rows: int) -> list[tuple[str, bytes]]:
    """At most ``rows`` rows, alike from each language, chosen by a hash of ``key``; what comes to
    the driver are their presence bits, 11 kB each however long the texts are."""
    labelled = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    if not counts:
        return []
    want = max(1.0, rows / len(counts))
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col(lang) == name, F.lit(min(1.0, want / n))).otherwise(share)
    pack = F.pandas_udf(packed_presence, "binary")
    order = unit_hash(F.col(key), seed=11)
    some = labelled.where(order < share).select(F.col(lang).alias("lang"), pack(F.col(text)).alias("bits"), order.alias("h"), F.col(key).alias("k"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("h", "k", "bits"))  # of each language by hash, so none is cut for another
    picked = some.where("bits is not null").withColumn("place", place).where(F.col("place") <= -(-rows // len(counts))).collect()
    return [(r["lang"], r["bits"]) for r in picked]


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """A struct column (lang_pred, score) for every row of ``docs``.

    ``und`` with score 0 for null, for texts without a letter, and if there is no model. The score
    is the softmax of the one-versus-rest outputs, 0 to 1. Ties go to the language first by name.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most landmarks x n-grams of the landmarks

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in texts:
            lang, score = np.full(len(batch), UNDETERMINED, object), np.zeros(len(batch))
            values = list(batch)
            for at in range(0, len(values), 64):
                rows = [(k, r) for k, v in enumerate(values[at : at + 64], at) if m is not None and (r := presence(v)) is not None]
                if not rows:
                    continue
                out = m.scores([r for _, r in rows]).astype(np.float64) * m.sharpness
                out = np.exp(out - out.max(axis=1, keepdims=True))
                out /= out.sum(axis=1, keepdims=True)
                where = [k for k, _ in rows]
                lang[where] = np.array(m.langs, object)[out.argmax(axis=1)]
                score[where] = out.max(axis=1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return F.pandas_udf(predict, "lang_pred string, score double")(F.col(text))


def is_held_out(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = 2000, landmarks: int = 192) -> Model | None:
    """Fit on at most ``max_rows`` labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    return fit(training_sample(docs.where(~is_held_out(key)).select(text, lang, key), text, lang, key, max_rows), landmarks)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    An empty table gives an empty result; repeated rows are scored alike; very long texts are read whole;
    rows without id are not held out; other columns of ``docs`` are ignored, whatever their names.
    """
    model = train(docs)
    found = docs.select("doc_id", is_held_out().alias("held_out"), identify(docs, model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
