"""Fidelity of a rebuilt version to its original, by positions, counts and sets; scores are 0 to 100, null where not applicable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_similarity(a: Column, b: Column) -> Column:
    return (1 - F.abs(a - b) / F.greatest(a, b, F.lit(1))) * 100


def positional(old: DataFrame, new: DataFrame, values: list[str], key: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Old and new values side by side at each place of the longer side; ``same`` compares them all, nulls equal."""
    names = lambda n: [F.col(v).alias(f"{n}_{v}") for v in values]
    both = old.select(key, pos, *names("old")).join(new.select(key, pos, *names("new")), [key, pos], "full")
    same = F.lit(True)
    for v in values:
        same &= F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    return both.withColumn("same", same)


def position_share(old: DataFrame, new: DataFrame, values: list[str], key: str = "doc_id") -> DataFrame:
    """key, share (0 to 100) of places with equal values, n places."""
    return positional(old, new, values, key).groupBy(key).agg((F.count_if("same") * 100 / F.count("*")).alias("share"), F.count("*").alias("n"))


def ranked(rows: DataFrame, order: str = "pos", key: str = "doc_id") -> DataFrame:
    """Rows numbered from 0 within their document."""
    return rows.withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy(order)) - 1)


def structure_counts(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    of = lambda t: F.count_if(F.col("type") == t)
    return blocks.groupBy(key).agg(of("heading").alias("headings"), of("paragraph").alias("paragraphs"), of("list").alias("list_items"), of("table").alias("tables"))


def score_structure(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """0.3 headings by place, 0.3 paragraphs, 0.2 list items and 0.2 tables by count."""
    headings = position_share(*(ranked(b.where("type = 'heading'"), key=key) for b in (old, new)), ["level"], key)
    a, b = (structure_counts(x, key).select(key, *(F.col(c).alias(f"{n}_{c}") for c in ("paragraphs", "list_items", "tables"))) for n, x in (("old", old), ("new", new)))
    both = a.join(b, key, "full").join(headings.select(key, "share"), key, "left").fillna(0, [f"{n}_{c}" for n in ("old", "new") for c in ("paragraphs", "list_items", "tables")])
    like = lambda c: count_similarity(F.col(f"old_{c}"), F.col(f"new_{c}"))
    total = 0.3 * F.coalesce("share", F.lit(100.0)) + 0.3 * like("paragraphs") + 0.2 * like("list_items") + 0.2 * like("tables")
    return both.select(key, F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)).alias("structure"))


def score_formatting(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Share of runs with equal bold, italic, underline, font and size; runs have ``pos``. Documents without runs aren't listed (100)."""
    return position_share(old, new, ["bold", "italic", "underline", "font", "size"], key).select(key, F.col("share").alias("formatting"))


def score_tables(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """One check of the count, five for each table pair, four unmet for a table without partner; null without original tables.

    Tables have ``pos, rows, cols, merged_cells, cell_backgrounds, table_style``.
    """
    values = ["rows", "cols", "merged_cells", "cell_backgrounds", "table_style"]
    both = positional(old.withColumn("is", F.lit(1)), new.withColumn("is", F.lit(1)), [*values, "is"], key)
    alone = F.col("old_is").isNull() | F.col("new_is").isNull()
    hits = sum((F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}")).cast("int") for v in values), F.lit(0))
    sums = both.groupBy(key).agg(F.sum(F.when(alone, 4).otherwise(5)).alias("checks"), F.sum(F.when(alone, 0).otherwise(hits)).alias("hits"), F.count("old_is").alias("a"), F.count("new_is").alias("b"))
    return sums.select(key, F.when(F.col("a") > 0, (F.col("hits") + (F.col("a") == F.col("b")).cast("int")) * 100 / (F.col("checks") + 1)).alias("tables"))


def score_links(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Share of places with equal (text, url); null without original links."""
    both = positional(old, new, ["text", "url"], key)
    sums = both.groupBy(key).agg(F.count("old_text").alias("a"), (F.count_if("same") * 100 / F.count("*")).alias("share"))
    return sums.select(key, F.when(F.col("a") > 0, F.col("share")).alias("hyperlinks"))


def change_counts(changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """insertions, deletions and the set of authors of ``changes(kind, author)``."""
    return changes.groupBy(key).agg(F.count_if(F.col("kind") == "insertion").alias("insertions"), F.count_if(F.col("kind") == "deletion").alias("deletions"), F.array_sort(F.collect_set("author")).alias("authors"))


def score_changes(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean of the similarity of insertions, of deletions, and the Jaccard similarity of authors; null without original changes."""
    columns = ("insertions", "deletions", "authors")
    a, b = (change_counts(x, key).select(key, *(F.col(c).alias(f"{n}_{c}") for c in columns)) for n, x in (("old", old), ("new", new)))
    none = F.array().cast("array<string>")
    both = a.join(b, key, "left").fillna(0, ["new_insertions", "new_deletions"])
    x, y = F.col("old_authors"), F.coalesce("new_authors", none)
    jaccard = F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(0.0)
    like = lambda c: count_similarity(F.col(f"old_{c}"), F.col(f"new_{c}")) / 100
    return both.select(key, F.when(F.col("old_insertions") + F.col("old_deletions") > 0, (like("insertions") + like("deletions") + jaccard) / 3 * 100).alias("track_changes"))


def total(scores: Column) -> Column:
    """Mean of the dimensions that apply."""
    known = F.filter(scores, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(0.0)
