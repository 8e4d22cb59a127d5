"""Removal of repeated lines by an exact set-similarity join, in DataFrame operations only.

A line's tokens are its distinct 5-word shingles; a line of fewer words is one token. Tokens are in
order of their hashes, but those that stand in many prefixes come last: they are counted in the
prefixes, and only lines that have one there get another prefix. Two lines of Jaccard similarity t or
more share one of the first n - ceil(t * n) + 1 tokens in that order (prefix filter), have sizes
within t of each other (length filter), and enough tokens left where they meet (positional filter). What is left is verified on all tokens. A line is removed if a line before
it, by document and line number, is as similar.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archivist.llm.common import FEW, packed, rows_with, unpacked, written

#: Tokens are counted in so many hash buckets, so the table of counts has this fixed size. What is
#: frequent beyond the noise of its bucket comes last, so that many lines with the same frame don't meet.
BUCKETS_LOG2 = 13
#: A token is frequent if it stands in more prefixes than this, and than four deviations of a bucket's count.
OFTEN = 100
#: Hashes don't repeat and hardly compress; a dictionary of them is only tried and thrown away.
_PLAIN = {"parquet.enable.dictionary": "false", "compression": "lz4_raw"}
_OTHER_BLANKS = ("\t", "\x0b", "\x0c", "\r")


def _lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    # outer generators and no filters on what comes of them: the optimizer would repeat the splitting for each
    return docs.select(F.col(key).alias("doc_id"), F.posexplode_outer(F.split(text, "\n")).alias("line", "value"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words() -> Column:
    """The words of value in lower case."""
    value = F.lower("value")
    other = reduce(Column.__or__, [F.contains(value, F.lit(blank)) for blank in _OTHER_BLANKS])
    return F.array_remove(F.when(other, F.split(value, "[ \t\\x0B\f\r]")).otherwise(F.split(value, " ")), "")


def _pairs(width: int) -> list[int]:
    """Where in a run of ``width`` words the pairs of words begin that cover it."""
    return [*range(0, width - 1, 2), width - 2][: width // 2 + width % 2]


def _from(array: Column, k: int) -> Column:
    return F.slice(array, F.lit(k + 1), F.greatest(F.size(array), F.lit(0)))


def _shingles(words: Column, width: int) -> Column:
    """The hash of every run of ``width`` words: that of the hashes of its pairs, so that few arrays are made."""
    if width == 1:
        return F.transform(words, lambda w: F.xxhash64(w))
    pairs = F.zip_with(words, _from(words, 1), lambda w, x: F.xxhash64(w, x))
    whole = lambda p: F.slice(p, F.lit(1), F.greatest(F.size(p) - (width - 1), F.lit(0)))
    return _let(pairs, lambda p: F.transform(whole(p), lambda x, i: F.xxhash64(x, *[F.get(p, i + k) for k in _pairs(width)[1:]])))


def _bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND((1 << BUCKETS_LOG2) - 1).cast("int")


def _hashes(lines: DataFrame, width: int) -> DataFrame:
    """doc_id, line and s, the hashes of the shingles of each line: that of all its words if there are
    fewer than ``width``, null for a blank line."""
    some = lambda w: F.when(F.size(w) >= width, _shingles(w, width)).when(F.size(w) > 0, F.array(F.xxhash64(F.size(w), w)))
    return lines.select("doc_id", "line", _let(_words(), some).alias("s"))


def shingle_ranks(lines: DataFrame, width: int) -> Column:
    """A constant array: for each bucket of shingles its rank by occurrences in all texts, rarest
    first, as the highest bits of a signed number."""
    # every run of words a row: one array of structs costs less than functions of arrays
    parts = [f"w{k}" for k in range(width)]
    words = lines.select(_words().alias("w"))
    shingles = words.select(F.inline_outer(F.arrays_zip(*[_from(F.col("w"), k).alias(c) for k, c in enumerate(parts)])))
    hashed = F.xxhash64(*[F.xxhash64(parts[k], parts[k + 1]) for k in _pairs(width)]) if width > 1 else F.xxhash64(*parts)
    # where a line ends there are no whole shingles; they have a bucket of their own
    counts = dict(shingles.groupBy(F.when(F.col(parts[-1]).isNotNull(), _bucket(hashed)).alias("b")).count().collect())
    rank = [0] * (1 << BUCKETS_LOG2)
    for k, b in enumerate(sorted(range(len(rank)), key=lambda b: (counts.get(b, 0), b))):
        rank[b] = (k - len(rank) // 2) << (64 - BUCKETS_LOG2)
    return F.split(F.lit(",".join(map(str, rank))), ",").cast("array<long>")  # the optimizer makes it one literal


def line_tokens(lines: DataFrame, width: int, ranks: Column | None = None) -> DataFrame:
    """doc_id, line and tokens of every line: distinct numbers in order, null for a blank line. A token
    is the hash of a shingle; with ``ranks``, its lowest bits, the bucket, made the bucket's rank in front."""
    if ranks is None:
        return _hashes(lines, width).select("doc_id", "line", F.sort_array(F.array_distinct("s")).alias("tokens"))
    # a bucket is never out of range; an array that can hold no null is sorted as plain numbers
    ranked = F.transform("s", lambda x: F.coalesce(F.get(ranks, _bucket(x)), F.lit(0)).bitwiseOR(F.shiftrightunsigned(x, BUCKETS_LOG2)))
    return _hashes(lines, width).select("doc_id", "line", F.sort_array(F.array_distinct(ranked)).alias("tokens"))


def _parity() -> Column:
    """64 bits, each the parity of how many tokens hash to it."""
    return F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))))


def _same(tokens: str) -> list[Column]:
    return [F.xxhash64(tokens).alias("k1"), F.xxhash64(F.lit(1), tokens).alias("k2")]


def _sent(few: DataFrame) -> DataFrame:
    """To every task, if its rows, which are counted, are few; else it meets others by a shuffle."""
    return F.broadcast(few) if few.count() <= FEW else few


def _marked(docs: DataFrame, text: str, key: str, width: int, threshold: float) -> DataFrame:
    """doc_id, line and gone of every line of every row of ``docs``.

    Equal lines are one node. First each node meets one other: of the first nodes of its prefix tokens
    the one with which it shares most of them; only nodes that it doesn't beat then meet all before
    them, so that a group of many similar lines does not meet pairwise.
    """
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    full = line_tokens(_lines(docs, text, key), width)
    lines = written(full.select("doc_id", "line", *_same("tokens"), F.size("tokens").alias("n"), _parity().alias("parity"), _prefix("tokens", threshold).alias("prefix")).withColumn("id", F.monotonically_increasing_id()), **_PLAIN)
    at = F.struct((F.col("doc_id.doc_id") if key == "doc" else F.col("doc_id")).isNull().alias("none"), "doc_id", "line")  # null keys come last
    filled = lines.where("prefix is not null")
    often = written(filled.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("k1", "k2"))
    heads = filled.select("k1", "k2", F.struct(at.alias("at"), "id").alias("one")).join(_sent(often), ["k1", "k2"], "left_semi")
    heads = written(heads.groupBy("k1", "k2").agg(F.min("one").alias("one")).select("k1", "k2", F.col("one.id").alias("head")))
    told = filled.join(_sent(heads), ["k1", "k2"], "left").where("head is null or head = id")
    nodes = written(told.select("id", "k1", "k2", at.alias("at"), "n", "parity", "prefix", F.col("head").isNotNull().alias("copied")), **_PLAIN)
    # one number for size and place keeps what is shuffled for each token small
    tokens = nodes.select("id", F.shiftleft(F.col("n").cast("long"), 32).alias("n"), F.posexplode("prefix").alias("p", "token")).where("token is not null")
    tokens = _often_last(tokens, nodes, texts, width, threshold)
    tokens = tokens.select("token", "id", F.col("n").bitwiseOR(F.col("p").cast("long")).alias("np"))
    live = _shared(tokens).join(nodes.select("id", "at", "parity"), "id")
    live = written(live.select("token", "id", "at", "parity", F.shiftright("np", 32).alias("n"), F.col("np").bitwiseAND(0xFFFFFFFF).alias("p")))
    columns = ("id", "at", "parity", "n", "p")
    x = live.select("token", *[F.col(c).alias(f"x_{c}") for c in columns])
    y = live.select("token", *[F.col(c).alias(f"y_{c}") for c in columns])
    x_n, x_p, y_n, y_p = (F.col(c) for c in ("x_n", "x_p", "y_n", "y_p"))
    overlap = F.ceil(threshold / (1 + threshold) * (x_n + y_n) - 1e-9)
    fits = (x_n >= threshold * y_n - 1e-9) & (y_n >= threshold * x_n - 1e-9) & (F.least(x_n - x_p, y_n - y_p) >= overlap) & (F.col("x_at") < F.col("y_at"))
    # parities differ in no more bits than there are tokens that only one of the two has
    fits &= F.bit_count(F.col("x_parity").bitwiseXOR(F.col("y_parity"))) <= (1 - threshold) / (1 + threshold) * (x_n + y_n) + 1e-9
    first = live.groupBy("token").agg(F.min_by(F.struct(*columns), "at").alias("one"))
    first = first.select("token", *[F.col(f"one.{c}").alias(f"x_{c}") for c in columns])
    star = first.join(y, "token").where(fits).groupBy("y_id", "x_id").agg(F.count(F.lit(1)).alias("m"))
    star = star.groupBy("y_id").agg(F.max_by("x_id", F.struct("m", "x_id")).alias("x_id"))
    verify = lambda pairs: written(_verified(pairs, nodes, texts, width, threshold))
    beaten = verify(star)
    rest = x.join(y.join(beaten, "y_id", "left_anti"), "token").where(fits)
    beaten = beaten.unionByName(verify(rest))
    known = nodes.select("id", "k1", "k2", "at", "copied").join(beaten.select(F.col("y_id").alias("id"), F.lit(True).alias("beaten")), "id", "left")
    some = written(known.where("beaten or copied").select("k1", "k2", "beaten", F.col("at").alias("first")))
    flagged = lines.select("doc_id", "line", "k1", "k2").join(_sent(some), ["k1", "k2"], "left")
    return flagged.select("doc_id", "line", F.coalesce("beaten", at > F.col("first"), F.lit(False)).alias("gone"))


def _shared(tokens: DataFrame) -> DataFrame:
    """The rows of tokens that more than one line has, counted where they are shuffled to, once."""
    return tokens.withColumn("_c", F.count(F.lit(1)).over(W.partitionBy("token"))).where("_c > 1").drop("_c")


def _prefix(tokens: str, threshold: float) -> Column:
    """The first of ``tokens``, one of which two lines of this similarity share."""
    size = F.size(tokens)
    return F.slice(tokens, F.lit(1), size - F.ceil(size * threshold - 1e-9).cast("int") + 1)


def _frequent(tokens: DataFrame) -> DataFrame:
    """The tokens that many prefixes have. All are counted by bucket; those of full buckets, one by one."""
    counts = written(tokens.groupBy(_bucket(F.col("token")).alias("b")).count())
    mean = (counts.agg(F.sum("count")).first()[0] or 0) / (1 << BUCKETS_LOG2)
    least = max(OFTEN, 4 * mean**0.5)
    full = F.broadcast(counts.where(F.col("count") > mean + least).select("b"))
    some = tokens.select("token", _bucket(F.col("token")).alias("b")).join(full, "b", "left_semi")
    return written(some.groupBy("token").count().where(F.col("count") > least).select("token"))


def _often_last(tokens: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """``tokens`` (id, n, p, token) of prefixes in an order in which frequent tokens come last. A prefix
    without any is the same in both orders; the others are made again from all tokens of their lines."""
    frequent = _frequent(tokens)
    ids = written(tokens.join(_sent(frequent), "token", "left_semi").select("id").distinct())
    each = _sets(ids, nodes, docs, width).select("id", F.explode("tokens").alias("token"))
    # what else these lines have in common would come in its place
    frequent = written(frequent.union(_frequent(each)).distinct())
    more = written(tokens.join(_sent(frequent), "token", "left_semi").select("id").distinct().join(_sent(ids), "id", "left_anti"))
    if more.head(1):
        each = each.union(_sets(more, nodes, docs, width).select("id", F.explode("tokens").alias("token")))
        ids = ids.union(more)
    told = each.join(_sent(frequent.withColumn("last", F.lit(True))), "token", "left")
    ordered = told.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("last", F.lit(False)).alias("last"), "token"))).alias("all"))
    again = ordered.select("id", F.shiftleft(F.size("all").cast("long"), 32).alias("n"), F.posexplode(_prefix("all", threshold)).alias("p", "one"))
    return tokens.join(_sent(ids), "id", "left_anti").unionByName(again.select("id", "n", "p", F.col("one.token").alias("token")))


def _sets(ids: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """id and all tokens, which are made again, of the nodes in ``ids``."""
    places = written(rows_with(nodes.select("id", "k1", "k2", "at.doc_id", "at.line"), ids, ["id"]))
    there = _lines(rows_with(docs, places.select("doc_id"), ["doc_id"], null_safe=True), "text", "doc_id")
    there = rows_with(there, places.select("doc_id", "line"), ["doc_id", "line"], null_safe=True)
    made = line_tokens(there, width).select("tokens", *_same("tokens"))
    return written(made.join(_sent(places.select("id", "k1", "k2")), ["k1", "k2"]).select("id", "tokens").dropDuplicates(["id"]))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """The ids (y_id) of those second nodes whose pair has the similarity on all tokens."""
    pairs = written(pairs.select("x_id", "y_id").distinct())
    sets = _sets(pairs.select(F.col("x_id").alias("id")).union(pairs.select("y_id")), nodes, docs, width)
    x, y = sets.select(F.col("id").alias("x_id"), F.col("tokens").alias("x")), sets.select(F.col("id").alias("y_id"), F.col("tokens").alias("y"))
    both = pairs.join(x, "x_id").join(y, "y_id")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= threshold * (F.size("x") + F.size("y") - common) - 1e-9).select("y_id").distinct()


def repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, line) of every line that a line before it repeats.

    Lines are cut at line feeds and numbered from 0; words are what lies between blanks and tabs, in
    lower case. Lines of fewer than ``width`` words repeat lines of the same words; blank lines repeat
    nothing. Null texts have no lines. Rows with a null key come after all others. Rows with the same
    key are one document: equal lines of the same number in it stand or fall together. An empty table
    gives an empty result, very long texts and lines are taken whole, other columns are ignored.
    """
    return _marked(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", "doc_id", width, threshold).where("gone").select("doc_id", "line").distinct()


def line_dedup(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, line and kept of every line of ``docs`` (doc_id, text); see `repeated_lines`."""
    marked = _marked(docs.select("doc_id", "text"), "text", "doc_id", width, threshold)
    return marked.where("line is not null").select("doc_id", "line", (~F.col("gone")).alias("kept"))


def without_repeats(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with the repeated lines taken out of their texts (and n_chars, if it is there, as the
    text then has). Documents of which nothing but white space is left go; those that had nothing
    else before stay. Columns of any name are left as they are; see `repeated_lines` for odd rows."""
    told = F.struct(F.col("doc_id"), F.xxhash64("text").alias("text"))  # rows of one key and other texts are told apart
    marked = _marked(docs.select(told.alias("doc"), "text"), "text", "doc", width, threshold).where("gone")
    gone = marked.groupBy(F.col("doc_id.doc_id").alias("gone_id"), F.col("doc_id.text").alias("gone_text")).agg(F.collect_set("line").alias("gone"))  # a document's line numbers
    rows = packed(docs)
    on = F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("row.text") == F.col("gone_text"))
    rows = rows.join(gone, on, "left").select("row", "gone", F.split("row.text", "\n").alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = rows.select("row", "gone", F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n").alias("left"))
    left = left.where(F.col("gone").isNull() | F.col("left").rlike(r"\S"))
    changed = lambda c, value: F.when(F.col("gone").isNull(), F.col(f"row.{c}")).otherwise(value)
    return unpacked(left, docs.columns, {"text": changed("text", F.col("left")), "n_chars": changed("n_chars", F.length("left").cast("long"))})
