"""Expressions over metric paths and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def family(tag: Column, keys: dict[str, str]) -> Column:
    """The path with parts that only name one of many folded.

    keys: pattern -> replacement, applied in order; then every part of digits alone becomes <k>.
    """
    for pattern, folded in keys.items():
        tag = F.regexp_replace(tag, pattern, folded)
    return F.array_join(F.transform(F.split(tag, "/"), lambda part: F.when(part.rlike("^[0-9]+$"), "<k>").otherwise(part)), "/")


#: Codes of datasets and harnesses in metric paths.
CODE_FAMILIES = {"dataset-[a-z0-9]+": "dataset-*", "harness-[A-Za-z0-9-]+": "harness-*"}


def prefixes(tag: Column) -> Column:
    """Every prefix of the path, itself included."""
    parts = F.split(tag, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def first_match(value: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The result of the first rule (pattern, result) whose pattern is found in the value."""
    out = F.lit(default)
    for pattern, result in reversed(rules):
        out = F.when(value.rlike(pattern), result).otherwise(out)
    return out


def histogram_bin(value: Column, edges: list[float]) -> Column:
    """Number of the bin [edge, next edge) that holds the value: 0 below the first edge."""
    out = F.lit(len(edges))
    for k, edge in reversed(list(enumerate(edges))):
        out = F.when(value < edge, k).otherwise(out)
    return F.when(value.isNotNull(), out)


def is_round(value: Column) -> Column:
    """A power of two, or a small whole number times a power of ten, of 2 or more."""
    power = F.when(value > 0, F.log2(value))
    two = F.abs(power - F.round(power)) < 1e-9
    scale = F.when(value > 0, F.pow(F.lit(10.0), F.floor(F.log10(value))))
    head = value / scale
    ten = F.abs(head - F.round(head)) < 1e-9
    return F.coalesce((value >= 2) & (two | ten), F.lit(False))


def tag_matches(tag: Column, search: str) -> Column:
    """/pattern/ or /pattern/i is a regular expression; anything else a substring in any case."""
    if search.startswith("/") and search.rfind("/") > 0:
        pattern, flags = search[1:].rsplit("/", 1)
        return tag.rlike(("(?i)" if "i" in flags else "") + pattern)
    return F.contains(F.lower(tag), F.lit(search.lower()))


def ranked_lookup(names: DataFrame, name: str, rules: DataFrame) -> DataFrame:
    """name, grp: the result of the first rule by priority that fits. rules (a small config): priority, kind (exact or prefix), pattern, grp."""
    fits = ((F.col("kind") == "exact") & (F.col(name) == F.col("pattern"))) | ((F.col("kind") == "prefix") & F.startswith(F.col(name), F.col("pattern")))
    return names.join(F.broadcast(rules), fits).groupBy(name).agg(F.min_by("grp", "priority").alias("grp"))


def template_matches(templates: DataFrame, tags: DataFrame) -> DataFrame:
    """template, tag: * stands for one part of a path, ? for one character. templates is a small config."""
    pattern = F.concat(F.lit("^"), F.replace(F.replace("template", F.lit("*"), F.lit("[^/]+")), F.lit("?"), F.lit(".")), F.lit("$"))
    return tags.join(F.broadcast(templates.withColumn("_pattern", pattern)), F.expr("tag rlike _pattern")).select("template", "tag")


def covered(names: DataFrame, name: str, patterns: DataFrame) -> DataFrame:
    """name, covered: whether any pattern (a small config) is found in it."""
    hit = F.expr(f"{name} rlike pattern")
    found = names.join(F.broadcast(patterns), hit, "left").groupBy(name).agg(F.max(F.col("pattern").isNotNull()).alias("covered"))
    return found


def mentions(text: Column, reasons: list[tuple[str, str]]) -> list[Column]:
    """run, step and reason that a note names; the reason is unknown if no pattern is found."""
    step = F.nullif(F.regexp_extract(text, r"(?i)step\s*([0-9]+)", 1), F.lit("")).cast("int")
    return [F.regexp_extract(text, "(r[0-9]+)", 1).alias("run"), step.alias("step"), first_match(text, reasons, "unknown").alias("reason")]
