import gzip
import base64

import pytest
from pyspark.sql import functions as F

from archivist.functions import text as T
from archivist.functions import vectors as V
from archivist.functions.registry import TextExtractors, register_search
from archivist.operators import chunking, documents, integrity, rag, search, versions
from archivist.plans import pipelines
from archivist.sources import archive

FILES = "archive_id string, source_file string, content string"


def test_chunk_size_is_checked():
    for bad in (0, 200, 4001, 5000):
        with pytest.raises(ValueError):
            chunking.payload_size(bad)
    assert chunking.payload_size(201) == 1


@pytest.mark.parametrize("password", [None, "secret"])
def test_extract_gives_back_what_was_converted(spark, password):
    files = spark.createDataFrame([("a", "x.txt", "é" * 700), ("a", "y.bin", ""), ("b", "z.txt", "same"), ("b", "w.txt", "same")], FILES)
    files = files.withColumn("content", F.col("content").cast("binary"))
    chunks, contents = pipelines.convert(files, 300, password)
    shuffled = chunks.unionByName(chunks.limit(3)).orderBy(F.rand(1))
    found = pipelines.extract(shuffled, contents, password)
    assert {(r.source_file, bytes(r.content)) for r in found.collect()} == {(r.source_file, bytes(r.content)) for r in files.collect()}
    assert {r.status for r in found.collect()} == {"complete"}


def test_wrong_password_leaves_the_input(spark):
    rows = spark.createDataFrame([(1, "text"), (2, None)], "id int, v string")
    sealed = chunking.encrypt(rows, "v", "one")
    other = chunking.decrypt(sealed, "v", "two").collect()
    assert {(r.id, r.v) for r in other} == {(r.id, r.v) for r in sealed.collect()} or not any(r.decrypted for r in other)
    assert "one" not in sealed._jdf.queryExecution().toString()


def test_faults_are_found(spark):
    files = spark.createDataFrame([("a", "x", "abcdefghij" * 60)], FILES)
    chunks, _ = pipelines.convert(files, 300)
    broken = chunks.where("chunk_index <> 1")
    row = integrity.completeness(broken).first()
    assert (row.status, row.first_missing) == ("missing", 1)
    assert pipelines.extract(broken).first().content is None
    flipped = chunks.withColumn("payload", F.when(F.col("chunk_index") == 2, F.lit("?")).otherwise(F.col("payload")))
    row = integrity.verify(flipped).first()
    assert (row.status, row.ok_frames, row.failed_frames, row.first_failures) == ("DEGRADED", 5, 1, [2])
    assert integrity.verify(chunks).first().status == "GOOD"


def test_inflate(spark):
    packed = "GZ:" + base64.b64encode(gzip.compress(b"hello")).decode()
    rows = spark.createDataFrame([(packed,), ("GZ:nonsense",), ("plain",), (None,)], "v string")
    assert [r[0] for r in rows.select(chunking.inflate_tagged(F.col("v"))).collect()] == ["hello", "GZ:nonsense", "plain", None]


def test_sizes_and_text(spark):
    rows = spark.range(1).select(*[T.human_size(F.lit(n)).alias(str(n)) for n in (0, 1023, 1024, 1280, 1 << 20)])
    assert list(rows.first()) == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.0 MB"]
    row = spark.range(1).select(T.clean_text(F.lit("  a \n\n\t b \n")), T.preview(F.lit("x" * 201)), T.relevance(F.lit(""), "a"), T.snippet(F.lit("abc"), "c")).first()
    assert list(row) == ["a\nb", "x" * 200 + "...", None, "abc"]


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    row = spark.range(1).select(V.cosine(a, b), V.cosine(b, a), V.cosine(a, F.array(F.lit(1.0))), V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))).first()
    assert row[0] == row[1] == pytest.approx(0.5**0.5) and row[2] == row[3] == 0


def test_search(spark, data):
    frames = spark.read.parquet(f"{data}/embeddings.parquet")
    with pytest.raises(ValueError):
        search.top_k(frames, [])
    query = [float(x) for x in frames.where("vec_id = 3").first().embedding]
    plan = search.top_k(frames, query, 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan
    assert search.threshold_search(frames, query).count() == 1
    many = search.batch_top_k(frames, frames.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), "embedding"), 3, block=64)
    one = search.top_k(frames, query, 3)
    assert [r.vec_id for r in many.where("query_id = 3").orderBy("rank").collect()] == [r.vec_id for r in one.orderBy("rank").collect()]
    pairs = search.similarity_join(frames, 0.4, block=100)
    both = pairs.selectExpr("left_id AS v").union(pairs.selectExpr("right_id")).groupBy("v").count().collect()
    counts = search.neighbour_counts(frames, 0.4).where("neighbours > 0").collect()
    assert {(r.v, r["count"]) for r in both} == {(r.vec_id, r.neighbours) for r in counts}
    near = search.ann_search(frames, frames.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding"), 1)
    assert near.where("query_id = vec_id").count() == 20


def test_search_from_sql(spark, data):
    frames = spark.read.parquet(f"{data}/embeddings.parquet")
    name = register_search(spark, frames)
    got = spark.sql(f"SELECT a.vec_id, archive_cosine(a.embedding, b.embedding) AS s FROM {name} a, {name} b WHERE b.vec_id = 1 ORDER BY s DESC LIMIT 1").first()
    assert got.vec_id == 1 and got.s == pytest.approx(1)


def test_keyword_search(spark):
    docs = spark.createDataFrame([(1, "Cat cat dog"), (2, "a CAT"), (3, "dog"), (4, "")], "doc_id long, text string")
    assert [(r.doc_id, r.occurrences) for r in search.keyword_rank(docs, "cat").collect()] == [(1, 2), (2, 1)]
    assert [r.doc_id for r in search.keyword_rank(docs, "cat", scan_limit=1).collect()] == [1]
    with pytest.raises(ValueError):
        search.keyword_rank(docs, "")
    pages = [r.doc_id for o in (0, 2) for r in search.page(docs, 2, o, "doc_id", "doc_id").collect()]
    assert pages == [4, 3, 2, 1]


def test_versions(spark):
    kind = "memory_id long, frame long, hash string, payload string"
    old = spark.createDataFrame([(1, 0, "a", "A"), (1, 1, "b", "B"), (1, 2, "c", "C")], kind)
    new = spark.createDataFrame([(1, 0, "a", "A"), (1, 2, "x", "X"), (1, 3, "d", "D")], kind)
    ops = versions.snapshot_diff(old, new).withColumn("version", F.lit(2))
    assert {(r.frame, r.type) for r in ops.collect()} == {(1, "delete"), (2, "replace"), (3, "insert")}
    rebuilt = versions.reconstruct(old, ops, 2)
    assert {tuple(r) for r in rebuilt.collect()} == {tuple(r) for r in new.collect()}
    assert {tuple(r) for r in versions.reconstruct(old, ops, 1).collect()} == {tuple(r) for r in old.collect()}
    log = spark.createDataFrame([(1, 1, "f1")], "memory_id long, version int, file string")
    branches = versions.create_branch(spark.createDataFrame([], "memory_id long, branch string, version int"), log, 1, "main", 1)
    with pytest.raises(ValueError):
        versions.create_branch(branches, log, 1, "main", 1)
    with pytest.raises(ValueError):
        versions.create_branch(branches, log, 1, "other", 9)


def test_documents(spark):
    rows = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [2.0]), ("", 1, [1.0]), ("b", 1, None)], "id string, updated_at int, embedding array<double>")
    good, bad = documents.upsert(rows.limit(0), rows)
    assert [tuple(r) for r in good.collect()] == [("a", 2, [2.0])] and bad.count() == 2
    with pytest.raises(KeyError):
        documents.delete(good, spark.createDataFrame([("zz",)], "id string"))
    assert documents.admit([0, 1, 2, 61], [], 2, 60) == ([True, True, False, True], [61])
    extractors = TextExtractors()
    extractors.register(".up", lambda b: b.decode().upper())
    files = spark.createDataFrame([("a.txt", b"t"), ("b.up", b"u"), ("c.pdf", b"p"), ("d.txt", b"\xff")], "name string, content binary")
    assert [r[0] for r in files.select(extractors.text("name", "content")).collect()] == ["t", "U", None, None]


def test_prompts(spark):
    rows = spark.createDataFrame([("p1",), ("p2",)], "prompt string")

    def fails(prompts):
        raise RuntimeError("down")

    assert {r.error for r in rag.complete(rows, fails).collect()} == {"down"}
    assert {(r.response, r.error) for r in rag.complete(rows, lambda p: [None if x == "p1" else x for x in p]).collect()} == {(None, "no answer"), ("p2", None)}


def test_archive_on_disk(spark, tmp_path):
    files = spark.createDataFrame([("a", "x.txt", "hello"), ("b", "y.txt", "there")], FILES)
    chunks, contents = pipelines.convert(files)
    archive.archive_write(chunks, contents, str(tmp_path / "arc"))
    assert pipelines.extract(archive.archive_read(spark, str(tmp_path / "arc"), "a")).first().content == "hello"
    assert archive.contents_list(spark, str(tmp_path / "arc"), "b").first().name == "y.txt"
    with pytest.raises(ValueError):
        archive.archive_read(spark, str(tmp_path / "arc"), "none")
    archive.extract_sink(chunks, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    archive.dated_export(files.withColumn("ts", F.lit("2024-03-05").cast("timestamp")), str(tmp_path / "dated"), "ts")
    assert (tmp_path / "dated/y=2024/m=03/d=05").is_dir()
    frames = chunks.withColumnRenamed("archive_id", "memory_id")
    archive.index_save(frames, str(tmp_path / "index"))
    assert archive.index_load(spark, str(tmp_path / "index"), "a").count() == 1
    with pytest.raises(FileNotFoundError):
        archive.index_load(spark, str(tmp_path / "index"), "zz")
    archive.versions_save(contents, str(tmp_path / "versions"), "json")
    assert archive.versions_load(spark, str(tmp_path / "versions"), "json").count() == 2
    (tmp_path / "files").mkdir()
    (tmp_path / "files/one.txt").write_text("1")
    (tmp_path / "files/two.md").write_text("2")
    assert archive.corpus_scan(spark, str(tmp_path / "files"), "*.md").count() == 1
    assert archive.prefix_list(spark, str(tmp_path / "files"), "one").columns == ["path", "modificationTime", "length"]


def test_decrypt_leaves_rows_that_are_not_encrypted(spark):
    from archivist.operators import chunking

    plain = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 512).cast("binary").alias("payload"))
    told = chunking.decrypt(plain.withColumn("encrypted", F.lit(False)), "payload", "p")
    assert told.where("decrypted").count() == 0 and told.join(plain, ["id", "payload"]).count() == 3000
    with pytest.raises(ValueError, match="salts"):
        chunking.decrypt(plain, "payload", "p")


def test_missing_frames_can_be_an_error(spark):
    from archivist.operators import search

    frames = spark.createDataFrame([(1, "a"), (2, None)], "frame_number long, name string")
    found = search.in_request_order(frames, [2, 7, 1]).collect()
    assert [(r.frame_number, r.found) for r in found] == [(2, True), (7, False), (1, True)]
    with pytest.raises(KeyError):
        search.in_request_order(frames, [2, 7], strict=True)


def test_chunks_in_order(spark):
    rows = [("a", f"f{n % 3}", "h", k, 5, bytes([n, k])) for n in range(6) for k in (4, 0, 2, 1, 3)]
    chunks = spark.createDataFrame(rows, "archive_id string, source_file string, file_hash string, chunk_index int, chunk_total int, payload binary")
    found = {}
    for r in integrity.ordered_chunks(chunks).rdd.mapPartitionsWithIndex(lambda p, rows: [(p, r.source_file, r.chunk_index, bytes(r.payload)) for r in rows]).collect():
        found.setdefault((r[1], r[0]), []).append(r[2:])
    assert len(found) == 3 and all([k for k, _ in v] == [0, 1, 2, 3, 4] for v in found.values())
    whole = {r.source_file: bytes(r.content) for r in integrity.reassemble(integrity.dedup_chunks(chunks)).collect()}
    assert whole == {f: b"".join(x for _, x in v) for (f, _), v in found.items()}


def test_recall_of_approximate_search(spark, data):
    frames = spark.read.parquet(f"{data}/embeddings.parquet")
    queries = frames.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    best = search.batch_top_k(frames, queries, 6).select("query_id", "vec_id")
    found = search.ann_search(frames, queries, 6).select("query_id", "vec_id")
    assert found.join(best, ["query_id", "vec_id"]).count() >= 0.9 * best.count()


def test_whole_texts_are_embedded(spark):
    from archivist.plans.stored import LetterEmbedder

    rows = spark.createDataFrame([(1, "a " * 20_000), (2, "b c"), (3, ""), (4, None)], "doc_id long, text string")
    sizes = lambda **width: {r.doc_id: r.embedding for r in search.embed(rows, LetterEmbedder(), **width).collect()}
    assert sizes() == {1: [40_000.0, 20_000.0], 2: [3.0, 1.0], 3: None, 4: None}
    assert sizes(width=500)[1] == [500.0, 250.0]
