import random

import pytest
from pyspark.sql import functions as F

from archivist.operators import keywords, search
from archivist.operators.keywords import KeywordIndex, keyword_save


@pytest.fixture(scope="module")
def docs(spark, data):
    rows = [(10**6, None, "x"), (10**6 + 1, "", "x"), (10**6 + 2, "ab", "y"), (10**6 + 3, "ÄÖÜ straße İstanbul", None), (10**6 + 3, "another text of that key", None)]
    return spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").unionByName(spark.createDataFrame(rows, "doc_id long, text string, source string"))


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    path, block = str(tmp_path_factory.mktemp("keywords")), keywords.BLOCK
    keywords.BLOCK = 30  # several folders and posting rows
    keyword_save(docs.where("doc_id % 2 = 0"), path)
    keyword_save(docs.where("doc_id % 2 = 1"), path, mode="append")
    keywords.BLOCK = block
    return KeywordIndex(spark, path)


def _queries(docs, n=25):
    rng, texts = random.Random(7), [r.text for r in docs.where("length(text) > 20").collect()]
    out = ["a", "é", "ab", "äö", "zzzzqq", "İ", "THE", "  ", "\n"]
    for _ in range(n):
        text = rng.choice(texts)
        at = rng.randrange(len(text) - 12)
        out.append("".join(rng.choice([str.upper, str.lower])(c) for c in text[at : at + rng.randrange(3, 12)]))
    return out


def test_one_query_finds_what_a_scan_finds(index, docs):
    for query in _queries(docs)[:14]:
        want = sorted(r.doc_id for r in search.keyword_rank(docs, query, 10**6).collect())
        assert sorted(r.doc_id for r in index.find(query).collect()) == want, query
    assert index.find("license").columns == docs.columns
    with pytest.raises(ValueError):
        index.find("")


def test_many_queries_find_what_a_scan_finds(spark, index, docs):
    queries = list(enumerate(_queries(docs, 60))) + [(500, None), (501, "")]
    found = index.find_all(spark.createDataFrame(queries, "query_id long, query string")).collect()
    low = [(r[0], r[1]) for r in docs.select("doc_id", F.lower("text")).collect()]
    lowered = {r[0]: r[1] for r in spark.createDataFrame(queries, "k long, q string").select("k", F.lower("q")).collect()}
    want = {(k, d) for k, q in lowered.items() if q for d, t in low if t is not None and q in t}
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_ranks_and_snippets(index, docs):
    same = lambda a, b, *columns: [tuple(r[c] for c in columns) for r in a.collect()] == [tuple(r[c] for c in columns) for r in b.collect()]
    assert same(index.rank("License", 10), search.keyword_rank(docs, "License", 10), "doc_id", "occurrences", "relevance")
    assert same(index.snippets("the", 5, memory="src1"), search.keyword_snippets(docs, "the", 5, memory="src1"), "doc_id", "match_start", "snippet")


def test_only_postings_and_folders_of_hits_are_read(index, docs):
    text = docs.where("doc_id = 3").first().text
    keys = index.candidates(text[:40])
    assert 1 <= keys.count() <= docs.count() / 6
    plan = index.find(text[:40])._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "_part" in filters and filters.count(",") <= 20
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "IsNotNull(gram)" in plan or "In(gram" in plan
    assert index.postings.select(F.max(F.size("ids"))).first()[0] <= 100  # no list of all documents


def test_an_empty_table(spark, tmp_path):
    keyword_save(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "k"))
    index = KeywordIndex(spark, str(tmp_path / "k"))
    assert index.find("abc").collect() == []
    assert index.find_all(spark.createDataFrame([(1, "abc")], "query_id long, query string")).collect() == []


def test_postings_of_a_block_are_made_in_one_go(spark, docs, tmp_path, monkeypatch):
    """Each gram has one row a block with the keys that a scan finds, however few characters are sorted at once."""
    rows = docs.where("doc_id % 9 = 0 or doc_id >= 1000000").unionByName(spark.createDataFrame([(None, "no key", "x"), (7, "a\0b\U0001f600", "y"), (7, "ba", "y")], docs.schema))
    monkeypatch.setattr(keywords, "CHARACTERS", 3000)
    keyword_save(rows, str(tmp_path / "k"))
    index, want = KeywordIndex(spark, str(tmp_path / "k")), {}
    for key, low in rows.where("doc_id is not null and text is not null").select("doc_id", F.lower("text")).collect():
        for gram in {low[k : k + n] for n in (1, 2, 3) for k in range(len(low) - n + 1)}:
            want.setdefault(gram, set()).add(key)
    made = index.postings.collect()
    found = {}
    for r in made:
        assert list(r.ids) == sorted(set(r.ids)) and not found.get(r.gram, set()) & set(r.ids)
        found.setdefault(r.gram, set()).update(r.ids)
    assert found == want and len({(r.gram, r.block) for r in made}) == len(made)
    assert {r.gram: r.n for r in index.counts.collect()} == {g: len(k) for g, k in want.items()}
    blocks = {r.block for r in made}
    assert len(blocks) > 3  # by characters; by rows it would be one
