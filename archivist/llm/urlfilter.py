"""URL filter with a path-template tree, in DataFrame operations only.

Per host, paths form a tree of segments. Segments that vary by their form (numbers, long hexadecimal
or random strings) become the wildcard ``*``; a branch whose blocked share does not differ from that of
the branches beside it is merged with them into ``*``. The paths that are left are templates. A template
is rejected if its blocked share among labelled pages, smoothed towards that of its branch and host, is
above the limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivist.llm.common import packed, written

#: (rule, verdict); a rule is host/path-prefix.
RULES: tuple[tuple[str, str], ...] = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lowered; empty without it."""
    rest = _after_scheme(url)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, else null. The list is meant to be short: it becomes one CASE."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _literal(segment: Column) -> Column:
    """The segment, or ``*`` if its form alone shows that it varies (an extension stays)."""
    name = F.regexp_replace(segment, r"\.[A-Za-z0-9]{1,5}$", "")
    varies = name.rlike(r"^[0-9]+$") | name.rlike(r"^[0-9a-fA-F-]{16,}$") | name.rlike(r"[0-9].*[0-9].*[0-9]")
    return F.when(varies, F.concat(F.lit("*"), F.substring(segment, F.length(name) + 1, F.length(segment)))).otherwise(segment)


def shape_of(path: Column) -> Column:
    """The segments of the path with the varying ones as ``*``."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _literal)


def _branches(rows: DataFrame, path: str, least: int) -> DataFrame:
    """Every row once for each of the branches on its path, from ``least`` segments on."""
    levels = F.slice(F.sequence(F.lit(0), F.size(path)), F.lit(least + 1), F.size(path) + 1)  # none for an empty path and 1
    return rows.withColumn("level", F.explode(levels))


def templates(pages: DataFrame, z: float = 2.0, prior: float = 0.25, weight: float = 4.0) -> DataFrame:
    """(host, shape, template, rate) of every host and shape in ``pages`` (host, shape, bad).

    ``bad`` is true or false for labelled pages and null for others. A branch of the tree is a host
    and the first segments of its paths. It keeps its last segment's name if it is the only one
    there, or if its blocked share is more than ``z`` standard errors from that of all other
    branches beside it; else it is merged with them into ``*``. The names along a path are its
    template. ``rate`` is the smoothed purity: at each step from the host to the whole template it
    becomes (blocked + weight * rate) / (labelled + weight) of the pages below, starting from
    ``prior``; so a template without labels has its branch's rate. A step that still has all the
    labels of the one before tells nothing new and changes nothing.
    Pages are counted by host and shape before anything else, so no task sees a host's pages.
    """
    bad = F.col("bad").cast("long")
    shapes = written(pages.groupBy("host", "shape").agg(F.count("bad").alias("seen"), F.coalesce(F.sum(bad), F.lit(0)).alias("blocked")))
    sums = (F.sum("seen").alias("seen"), F.sum("blocked").alias("blocked"))
    at = lambda path: F.slice(path, F.lit(1), F.col("level"))
    branches = _branches(shapes, "shape", 1).select("host", at("shape").alias("branch"), "seen", "blocked").groupBy("host", "branch").agg(*sums)
    branches = written(branches.withColumn("parent", F.slice("branch", F.lit(1), F.size("branch") - 1)))
    every = branches.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("values"), F.sum("seen").alias("all_seen"), F.sum("blocked").alias("all_blocked"))
    seen, others = F.col("seen"), F.col("all_seen") - F.col("seen")
    share = (F.col("all_blocked") + 0.5) / (F.col("all_seen") + 1)
    apart = F.abs(F.col("blocked") / F.greatest(seen, F.lit(1)) - (F.col("all_blocked") - F.col("blocked")) / F.greatest(others, F.lit(1)))
    differs = (seen > 0) & (others > 0) & (apart > z * F.sqrt(share * (1 - share) * (1 / F.greatest(seen, F.lit(1)) + 1 / F.greatest(others, F.lit(1)))))
    name = F.when((F.col("values") == 1) | differs, F.element_at("branch", F.lit(-1))).otherwise(F.lit("*"))
    named = branches.join(every, ["host", "parent"]).select("host", "branch", name.alias("name"))
    along = _branches(shapes.select("host", "shape"), "shape", 1).withColumn("branch", at("shape")).join(named, ["host", "branch"])
    names = along.groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct("level", "name"))).alias("names"))  # as many as a path has segments
    made = shapes.join(names, ["host", "shape"], "left")
    made = written(made.select("host", "shape", "seen", "blocked", F.coalesce(F.col("names.name"), F.array().cast("array<string>")).alias("template")))
    below = _branches(made, "template", 0).select("host", at("template").alias("branch"), "seen", "blocked").groupBy("host", "branch").agg(*sums)
    steps = _branches(made.select("host", "template").distinct(), "template", 0).withColumn("branch", at("template")).join(below, ["host", "branch"])
    steps = steps.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("level", "seen", "blocked"))).alias("steps"))
    start = F.struct(F.lit(float(prior)).alias("rate"), F.lit(-1).cast("long").alias("seen"))
    next_rate = lambda r, x: F.when(x["seen"] == r["seen"], r["rate"]).otherwise((x["blocked"] + weight * r["rate"]) / (x["seen"] + weight))
    rate = F.aggregate("steps", start, lambda r, x: F.struct(next_rate(r, x).alias("rate"), x["seen"].alias("seen")), lambda r: r["rate"])
    return made.join(steps.select("host", "template", rate.alias("rate")), ["host", "template"]).select("host", "shape", F.array_join("template", "/").alias("template"), "rate")


def filter_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, labels: str | None = None, limit: float = 0.5) -> DataFrame:
    """Adds host, path, rule, template, rate and verdict to ``pages``, in place of columns so named.

    Labelled pages are those with a value in the boolean column ``labels`` (true: to be blocked)
    and those that a rule decides. What no rule decides is blocked if the rate of its template is
    above ``limit``. A null url or one without host has the empty host and template. Repeated rows
    are judged alike, an empty table gives an empty result, a path may have any length and number of
    segments; no row is lost or doubled.
    """
    rows = packed(pages).withColumns({"host": host_of(F.col(f"row.`{url}`")), "path": path_of(F.col(f"row.`{url}`"))})
    rows = rows.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "shape": shape_of(F.col("path"))})
    ruled = F.lit(None).cast("boolean")
    for rule, verdict in rules:
        ruled = F.when(F.col("rule") == rule, F.lit(verdict == "block")).otherwise(ruled)
    known = F.coalesce(ruled, F.col(f"row.`{labels}`")) if labels else ruled
    found = templates(rows.select("host", "shape", known.alias("bad")))
    full = rows.join(found, ["host", "shape"])
    block = F.coalesce(ruled, F.col("rate") > limit)
    full = full.withColumn("verdict", F.when(block, F.lit("block")).otherwise(F.lit("allow")))
    own = ("host", "path", "rule", "template", "rate", "verdict")
    return full.select(*[F.col(f"row.`{c}`").alias(c) for c in pages.columns if c not in own], *own)


def url_filter(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every page."""
    return filter_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template")
