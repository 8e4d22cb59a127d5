"""Column functions on text, names and payloads. Lengths and positions are in code points."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Media types by extension; the table is ours, so that results don't depend on a host's.
MIME_TYPES = {
    ".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv", ".html": "text/html", ".json": "application/json",
    ".yaml": "application/yaml", ".yml": "application/yaml", ".log": "text/plain", ".pdf": "application/pdf", ".png": "image/png",
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".mp4": "video/mp4", ".zip": "application/zip", ".gz": "application/gzip",
}
DEFAULT_MIME = "application/octet-stream"
TEXT_EXTENSIONS = (".txt", ".md", ".csv", ".json", ".yaml", ".yml", ".log")
#: White space as Unicode defines it, which trimming takes off.
_SPACE = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def file_digest(payload: Column) -> Column:
    """sha256 of the stored bytes, in hex."""
    return F.sha2(payload, 256)


def content_id(content: Column) -> Column:
    """First 16 hex digits of sha256: equal contents have equal ids."""
    return F.substring(F.sha2(content, 256), 1, 16)


def extension(name: Column) -> Column:
    """Lower-cased, with its dot; empty without one."""
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def mime_table(spark: SparkSession, types: Mapping[str, str] = MIME_TYPES) -> DataFrame:
    return spark.createDataFrame(sorted(types.items()), "ext string, mime_type string")


def with_mime(df: DataFrame, name: str, types: Mapping[str, str] = MIME_TYPES) -> DataFrame:
    """Adds mime_type by the name's extension, and is_text."""
    table = F.broadcast(mime_table(df.sparkSession, types))  # one row an extension
    out = df.withColumn("_ext", extension(F.col(name))).join(table, F.col("_ext") == F.col("ext"), "left").drop("_ext", "ext")
    out = out.withColumn("mime_type", F.coalesce("mime_type", F.lit(DEFAULT_MIME)))
    return out.withColumn("is_text", F.startswith("mime_type", F.lit("text/")))


def encode_payload(data: Column, is_text: Column) -> Column:
    """Text stays text, other bytes become base64."""
    return F.when(is_text, data.cast("string")).otherwise(F.base64(data.cast("binary")))


def decode_payload(payload: Column, is_text: Column) -> Column:
    """Bytes of a payload; null if its base64 is bad."""
    return F.when(is_text, payload.cast("binary")).otherwise(F.try_to_binary(payload, F.lit("base64")))


def human_size(n: Column) -> Column:
    """``n B``, else one decimal (half to even) of K, M, G, T, P or E of 1024."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate("KMGTPE", 1):
        value = F.bround(n / F.lit(float(1024**power)), 1).cast("decimal(20,1)").cast("string")
        out = F.when(n >= 1024**power, F.concat(value, F.lit(f" {unit}B"))).otherwise(out)
    return out


def chunk_estimate(size: Column, chunk: int = 2800) -> Column:
    return F.greatest(F.floor(size / chunk), F.lit(1)).cast("long")


def type_supported(name: Column) -> Column:
    return extension(name).isin(*TEXT_EXTENSIONS)


def clean_text(text: Column) -> Column:
    """Lines trimmed, empty ones left out."""
    trimmed = F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(line, f"^{_SPACE}+|{_SPACE}+$", ""))
    return F.array_join(F.filter(trimmed, lambda line: line != ""), "\n")


def nonempty(text: Column) -> Column:
    return F.coalesce(F.length(clean_text(text)) > 0, F.lit(False))


def preview(text: Column, width: int = 200) -> Column:
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit("..."))).otherwise(text)


def embed_truncate(text: Column, width: int = 8000) -> Column:
    return F.left(text, F.lit(width))


def enrich_metadata(metadata: Column, **values: Column) -> Column:
    """``metadata`` with more entries, of which the new ones win."""
    more = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    old = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(more), k))
    return F.map_concat(old, more)


def metadata_matches(metadata: Column, wanted: Mapping[str, object]) -> Column:
    """Whether every key has the value, as printed; a missing key doesn't match."""
    out = F.lit(True)
    for key, value in wanted.items():
        out = out & F.coalesce(F.try_element_at(metadata, F.lit(key)) == F.lit(str(value)), F.lit(False))
    return out


def contains_ci(text: Column, query: str) -> Column:
    return F.contains(F.lower(text), F.lower(F.lit(query)))


def occurrences(text: Column, query: str) -> Column:
    """How often the query occurs without overlaps, case folded."""
    low, q = F.lower(text), F.lower(F.lit(query))
    return ((F.length(low) - F.length(F.replace(low, q, F.lit("")))) / F.length(q)).cast("long")


def word_count(text: Column) -> Column:
    """Words are parted by blanks, tabs, line and form feeds and carriage returns, not by vertical tabs."""
    return F.size(F.filter(F.split(text, r"[ \t\n\f\r]+"), lambda w: w != "")).cast("long")


def relevance(text: Column, query: str) -> Column:
    """Occurrences per word, 1 at most; null without words."""
    words = word_count(text)
    return F.when(words > 0, F.least(occurrences(text, query) / words, F.lit(1.0)))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as DuckDB does it: its product with the power of ten, half away from zero. `F.round`
    goes by the digits that are printed, so that 41 / 5120 would be rounded up, not down."""
    return F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def match_start(text: Column, query: str) -> Column:
    """Where the query first occurs, from 0; -1 if it doesn't."""
    return (F.locate(query.lower(), F.lower(text)) - 1).cast("long")


def snippet(text: Column, query: str, width: int = 200) -> Column:
    """``width`` characters, starting half of that before the first match."""
    start = F.greatest(match_start(text, query) - width // 2, F.lit(0))
    return F.substring(text, (start + 1).cast("int"), F.lit(width))
