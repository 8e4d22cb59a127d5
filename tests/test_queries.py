import duckdb
import pytest
from pyspark.sql import functions as F

from archivist.functions import text as T
from archivist.plans.registry import ORACLES, QUERIES
from tests.conftest import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    found = QUERIES[name](spark, data)
    if name in ORACLES:
        compare(found, duck, ORACLES[name])
    else:
        assert found.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _same_on(spark, path, name, texts):
    """A query and its SQL agree on documents of these texts, each six times for six types of files."""
    rows = [(6 * i + k, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts) for k in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    compare(QUERIES[name](spark, str(path)), connection, ORACLES[name])


def test_documents_without_text_are_indexed(spark, tmp_path):
    _same_on(spark, tmp_path, "x6_stream_index", ["a", "", " ", None, "\n\t", "\u2003", "\x0b"])


@pytest.mark.parametrize("texts", [["the", "", " ", None, "\n\t"], ["the\x0bthe b", "\x0b", "a\x0cthe", "a\u2003the b", "a\r\nthe"]])
def test_words_and_relevance_of_odd_texts(texts, spark, tmp_path):
    _same_on(spark, tmp_path, "t9_t12_keyword_measures", texts)


def test_relevance_is_rounded_as_in_sql(spark):
    """Quotients of whole numbers whose tenth digit is a 5, or next to it."""
    pairs = [(k, n) for n in (512, 1024, 5120, 10240, 20480, 15625) for k in range(1, n)]
    mine = [r[0] for r in spark.createDataFrame(pairs, "k long, n long").coalesce(1).select(T.rounded(F.col("k") / F.col("n"), 9)).collect()]
    pairs_sql = ", ".join(f"({i}, {k}, {n})" for i, (k, n) in enumerate(pairs))
    assert mine == [r[0] for r in duckdb.sql(f"SELECT round(k / n, 9) FROM (VALUES {pairs_sql}) v(i, k, n) ORDER BY i").fetchall()]
