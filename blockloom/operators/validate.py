"""Checks on containers and blocks; each gives a row for each warning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions import constants as K
from blockloom.functions import text as T


def missing_files(containers: DataFrame) -> DataFrame:
    """``containers(doc_id, format, files)`` with the required files they lack; directories need the core files only."""
    required = F.when(F.col("format") == "zip", F.array(*map(F.lit, K.ALL_FILES))).otherwise(F.array(*map(F.lit, K.CORE_FILES)))
    return containers.withColumn("missing", F.array_sort(F.array_except(required, "files"))).where(F.size("missing") > 0)


def malformed_json(members: DataFrame) -> DataFrame:
    """``members(doc_id, name, text)`` whose JSON can't be parsed."""
    return members.where(F.col("name").endswith(".json") & F.col("text").isNotNull() & F.try_parse_json("text").isNull()).select("doc_id", "name")


def criticmarkup(content: DataFrame) -> DataFrame:
    """doc_id, line, error for each faulty CriticMarkup mark of ``content_md``; lines count from 1."""
    rows = content.select("doc_id", F.posexplode(F.split("content_md", "\n", -1)).alias("i", "raw"))
    return rows.select("doc_id", (F.col("i") + 1).alias("line"), F.explode(T.critic_errors(F.col("raw"))).alias("error"))


def track_changes(blocks: DataFrame) -> DataFrame:
    """doc_id, block_id, nth (from 1), warning; offsets are held against the block's length."""
    each = blocks.select("doc_id", "block_id", (F.col("content_end") - F.col("content_start")).alias("n"), F.posexplode("track_changes").alias("i", "t"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    found = F.array(
        F.when(F.col("t.end") > F.col("n"), "end exceeds block"), F.when(F.col("t.start") > F.col("t.end"), "start after end"),
        F.when(blank("t.author"), "missing author"), F.when(blank("t.date"), "missing date"),
    )
    return each.select("doc_id", "block_id", (F.col("i") + 1).alias("nth"), F.explode(F.array_compact(found)).alias("warning"))


def tables(blocks: DataFrame, structure: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """doc_id, block_id, warning of table blocks against ``structure(doc_id, block_id, rows, cols, merged_cells)``.

    ``styles(doc_id, block_id, table_formatting)`` adds those without an entry or without formatting.
    """
    body = F.filter(F.split("content", "\n", -1), lambda s: ~T.is_table_separator(s) & (T.strip(s) != ""))
    found = blocks.where("type = 'table'").withColumn("body", body).select("doc_id", "block_id", F.size("body").alias("n"), F.when(F.size("body") > 0, F.size(T.row_cells(F.get("body", F.lit(0))))).otherwise(0).alias("m"))
    held = found.join(structure.select("doc_id", "block_id", "rows", "cols", "merged_cells"), ["doc_id", "block_id"])
    checks = F.array_compact(F.array(F.when(F.col("n") != F.col("rows"), "row count mismatch"), F.when(F.col("m") != F.col("cols"), "column count mismatch")))
    merges = F.flatten(F.transform(F.coalesce("merged_cells", F.array().cast("array<struct<start_row:int,start_col:int,row_span:int,col_span:int>>")), lambda x: F.array_compact(F.array(
        F.when(x["start_row"] + x["row_span"] - 1 >= F.col("rows"), "merged cell exceeds row bounds"),
        F.when(x["start_col"] + x["col_span"] - 1 >= F.col("cols"), "merged cell exceeds column bounds"),
    ))))
    out = held.select("doc_id", "block_id", F.explode(F.concat(checks, merges)).alias("warning"))
    if styles is None:
        return out
    entry = blocks.where("type = 'table'").join(styles.select("doc_id", "block_id", F.lit(True).alias("has"), "table_formatting"), ["doc_id", "block_id"], "left")
    lacking = F.when(F.col("has").isNull(), "no style entry").when(F.col("table_formatting").isNull(), "missing table_formatting")
    return out.unionByName(entry.select("doc_id", "block_id", lacking.alias("warning")).where("warning is not null"))


def kept_cell_styles(styles: DataFrame, rows: int = K.MAX_TABLE_ROWS, cols: int = K.MAX_TABLE_COLS) -> DataFrame:
    """``styles(key "r,c", background_color, pattern_fill, border_style, border_width, border_color)`` with only valid values."""
    part = lambda i: F.get(F.split("key", ",", -1), F.lit(i)).try_cast("int")
    placed = styles.withColumn("row", part(0)).withColumn("col", part(1)).where((F.size(F.split("key", ",", -1)) == 2) & F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    keep = lambda c, ok: F.when(ok, F.col(c)).alias(c)
    return placed.select(
        "row", "col", keep("background_color", F.col("background_color").rlike(K.HEX_COLOR)), keep("pattern_fill", F.col("pattern_fill").isin(K.PATTERN_FILLS)),
        keep("border_style", F.col("border_style").isin(K.BORDER_STYLES)), keep("border_width", F.col("border_width").between(0, K.MAX_BORDER_WIDTH)), keep("border_color", F.col("border_color").rlike(K.HEX_COLOR)),
    )


def all_warnings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
