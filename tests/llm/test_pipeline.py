import corpus_pipeline
from pyspark.sql import functions as F

from archivist.llm import langid, linededup, minhash, mixing


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(90001, "123 !?", None, "src1", 6), (90002, None, None, None, None)], docs.schema))
    (tmp_path / "sf").mkdir()
    docs.write.parquet(str(tmp_path / "sf/documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path / "sf"))
    kept = docs.where(~F.col("doc_id").isin(90001, 90002))
    assert langid.language_id(docs).where("lang_pred <> 'und'").count() == kept.count()
    lines = linededup.without_repeats(kept)
    assert lines.columns == docs.columns and lines.count() <= kept.count()
    one = lines.join(minhash.near_duplicates(lines).where("kept").select("doc_id"), "doc_id", "left_semi")
    want = mixing.mix(one.select(*docs.columns)).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    got = found.where("piece = 0").groupBy("doc_id").count()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]


def test_near_dedup_takes_a_similarity_of_four_fifths(spark):
    words = [f"v{k}" for k in range(96)]  # 92 shingles
    alike = [*words[:41], "x", *words[42:54], "y", *words[55:]]  # 10 of 92 differ: 82 / 102 = 0.804
    other = [*words[:30], "x", *words[31:50], "y", *words[51:70], "z", *words[71:]]  # 15 of 92: 77 / 107 = 0.72
    rows = [(1, words), (2, alike), (3, other)]
    docs = spark.createDataFrame([(k, " ".join(w), "en", "a", 1) for k, w in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {1, 3}


def test_stages_of_odd_rows(spark):
    long = " ".join(f"w{k % 700}" for k in range(20_000))
    words = " ".join(f"v{k}" for k in range(60))
    rows = [(1, words, "en", "a", 1), (1, words, "en", "a", 1), (2, None, None, None, None), (None, words, "en", "a", 1), (None, "one two three", "en", "b", 1), (None, "one two three", "en", "b", 1), (3, long, "en", "b", 1), (4, long + " x", "en", "b", 1), (5, "", "en", "c", 0), (6, words + "\n" + words, "de", "c", 1), (6, "other text of six", "de", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.lit("clash") for c in ("_p", "_h", "_gone", "_left", "row", "size", "copies", "count", "found", "lines", "kept", "copy", "_src")}
    docs = docs.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
        got = stage(spark, docs, "")
        if name != "packing":
            assert got.columns == docs.columns and got.where(" or ".join(f"`{c}` <> 'clash'" for c in extra)).count() == 0
    near = sorted((r.doc_id or -1, (r.text or "")[:9]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert near == [(-1, "one two t"), (1, "v0 v1 v2 "), (2, ""), (3, "w0 w1 w2 "), (5, "")]  # both texts of 6 are one document
