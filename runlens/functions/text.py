"""Text: normal forms, word sets, HTML, batching by length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Named entities that page texts are cleaned of.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


#: Characters that upper() writes as several, each with its single capital; itself where it has none.
CAPITALS = {c: t if len(t := c.title()) == 1 else c for c in map(chr, range(0x110000)) if len(c.upper()) > 1} | {"ß": "ẞ"}


def upper_by_character(text: Column) -> Column:
    """Upper case with one character for each, as DuckDB's upper: ß becomes ẞ and not SS; ligatures stay."""
    capital = F.create_map(*(F.lit(x) for pair in CAPITALS.items() for x in pair))
    each = F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(capital, c), F.upper(c)))
    return F.when(text.rlike(f"[{''.join(CAPITALS)}]"), F.array_join(each, "")).otherwise(F.upper(text))


def lower_by_character(text: Column) -> Column:
    """Lower case with one character for each, wherever it stands, as DuckDB's lower: İ becomes i, a last Σ σ."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def normal(text: Column) -> Column:
    """Lower case, everything but ASCII letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(lower_by_character(text), "[^a-z0-9]+", " "))


def word_set(text: Column, longer_than: int = 2) -> Column:
    return F.array_distinct(F.filter(F.split(normal(text), " "), lambda w: F.length(w) > longer_than))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two word sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set that the other has."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def html_text(html: Column) -> Column:
    """Scripts, styles and tags out, entities resolved, white space folded."""
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    for entity, character in ENTITIES.items():
        html = F.replace(html, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(html, r"[ \t\r\n\f]+", " "))


def has_cjk(text: Column) -> Column:
    return text.rlike("[\\x{4e00}-\\x{9fff}]")


def length_batches(rows: DataFrame, key: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """Adds batch: rows in order fill a batch until the next would exceed the budget; a larger row is a batch alone.

    Greedy filling is sequential, so a key's sizes are folded as one array; deal large tables out by a finer key.
    """
    cells = rows.withColumn("_size", size).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, "_size"))).alias("_cells"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("seen"))

    def step(acc, cell):
        fits = (acc["used"] + cell["_size"] <= budget) | (acc["used"] == 0)
        batch = F.when(fits, acc["batch"]).otherwise(acc["batch"] + 1)
        used = F.when(fits, acc["used"] + cell["_size"]).otherwise(cell["_size"].cast("long"))
        return F.struct(batch.alias("batch"), used.alias("used"), F.concat(acc["seen"], F.array(batch)).alias("seen"))

    folded = cells.withColumn("_batches", F.aggregate("_cells", start, step)["seen"])
    return folded.select(*key, F.explode(F.arrays_zip(F.col("_cells").alias("c"), F.col("_batches").alias("b"))).alias("z")).select(*key, F.col(f"z.c.{order}").alias(order), F.col("z.c._size").alias("size"), F.col("z.b").alias("batch"))


def more_complete(entries: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Of the entries with one key, the one with the most filled fields and, among those, the longest text."""
    filled = sum((F.when(F.length(F.trim(F.coalesce(f, F.lit("")))) > 0, 1).otherwise(0) for f in fields), F.lit(0))
    length = sum((F.length(F.coalesce(f, F.lit(""))) for f in fields), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(filled.desc(), length.desc(), *fields))
    return entries.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
