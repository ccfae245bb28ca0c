"""Markdown content to blocks, as windows over its lines; every document is ordered on its own.

Input tables have ``doc_id, version, content_md``. Lines are hashed to partitions by document once; the windows, the grouping
into blocks and the offsets all keep that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockloom.functions import constants as K
from blockloom.functions import text as T

KEYS = ["doc_id", "version"]


def lines(content: DataFrame) -> DataFrame:
    """doc_id, version, line_no, raw, s (stripped)."""
    split = content.select(*KEYS, F.posexplode(F.split("content_md", "\n", -1)).alias("line_no", "raw"))
    return split.withColumn("s", T.strip(F.col("raw")))


def _classified(rows: DataFrame) -> DataFrame:
    """Lines with the block each belongs to (``pos``) and, at its first line, the block's type."""
    w = W.partitionBy(*KEYS).orderBy("line_no")
    before, until_next = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 1)
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    s = F.col("s")
    rows = rows.withColumn("marker", F.when(s.startswith("<!-- textbox"), "o").when(s == "<!-- /textbox -->", "c"))
    rows = rows.withColumn("inside", F.coalesce(F.last("marker", ignorenulls=True).over(before) == "o", F.lit(False)))
    rows = rows.withColumn("opens", (F.coalesce(F.col("marker"), F.lit("")) == "o") & ~F.col("inside")).withColumn("boxed", F.col("inside") | F.col("opens"))
    rows = rows.withColumn("row", ~F.col("boxed") & T.is_table_row(s))
    rows = rows.withColumn("island", F.col("row") & ~F.coalesce(F.lag("row").over(w), F.lit(False)))
    rows = rows.withColumn("island_at", F.last(F.when(F.col("island"), F.col("line_no")), ignorenulls=True).over(so_far))
    rows = rows.withColumn("separator_at", F.last(F.when(F.col("row") & ~F.col("island") & T.is_table_separator(s), F.col("line_no")), ignorenulls=True).over(until_next))
    rows = rows.withColumn("tabled", F.col("row") & F.coalesce(F.col("separator_at") > F.col("island_at"), F.lit(False)))
    rows = rows.withColumn("table_opens", F.col("tabled") & (F.col("island") | ~F.coalesce(F.lag("tabled").over(w), F.lit(False))))
    single = ~F.col("boxed") & ~F.col("tabled") & (s != "") & ~s.rlike(T.FOOTNOTE_DEF)
    rows = rows.withColumn("begins", F.col("opens") | F.col("table_opens") | single)
    rows = rows.where(F.col("begins") | F.col("boxed") | F.col("tabled")).withColumn("pos", F.sum(F.col("begins").cast("int")).over(so_far) - 1)
    image = s.startswith("![") & F.contains(s, F.lit("](")) & s.endswith(")")
    chart = F.substring(s, 3, len(K.CHART_PREFIX)) == K.CHART_PREFIX
    kind = (
        F.when(F.col("opens"), "textbox").when(F.col("table_opens"), "table")
        .when(image & chart & (F.locate("](", s) >= 3 + len(K.CHART_PREFIX)), "chart").when(image, "image").when(s.startswith("#"), "heading").otherwise("paragraph")
    )
    return rows.select(*KEYS, "pos", "line_no", "s", F.when(F.col("begins"), kind).alias("kind"))


def with_offsets(blocks: DataFrame) -> DataFrame:
    """Offsets in the text of all blocks joined by newlines, and ids by position."""
    w = W.partitionBy(*KEYS).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("content") + 1).over(w), F.lit(0)).cast("int")
    return blocks.withColumn("content_start", start).withColumn("content_end", (F.col("content_start") + F.length("content")).cast("int")).withColumn("block_id", F.concat(F.lit("block-"), F.col("pos").cast("string")))


def parse_blocks(content: DataFrame) -> DataFrame:
    """The blocks of each document: headings, paragraphs, images, charts, tables and text boxes."""
    rows = _classified(lines(content))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "s")))
    blocks = rows.groupBy(*KEYS, "pos").agg(F.max("kind").alias("type"), ordered.alias("lines"))
    blocks = blocks.select(*KEYS, F.col("pos").cast("int").alias("pos"), "type", F.array_join(F.transform("lines", lambda x: x["s"]), "\n").alias("content"), "lines")
    blocks = with_offsets(blocks)
    table = F.col("type") == "table"
    c = F.col("content")
    path = F.substring(c, F.locate("](", c) + 2, F.length(c) - F.locate("](", c) - 2)
    w = W.partitionBy(*KEYS).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    index = F.coalesce(F.sum(table.cast("int")).over(w), F.lit(0)).cast("int")
    found = lambda i: F.get("lines", F.lit(i))["s"]
    metadata = F.struct((F.size("lines") - 1).alias("rows"), F.size(T.row_cells(found(0))).alias("cols"), T.alignments(found(1)).alias("column_alignments"), index.alias("docx_table_index"))
    return blocks.select(
        *KEYS, "pos", "block_id", "type", "content",
        F.when(table, -1).otherwise(F.col("pos")).alias("docx_paragraph_index"), "content_start", "content_end",
        F.sha2("content", 256).alias("content_hash"),
        F.when(F.col("type") == "heading", F.length(F.regexp_extract(c, "^#+", 0))).alias("level"),
        F.when(F.col("type").isin("image", "chart"), path).alias("image_path"),
        F.when(table, metadata).alias("table_metadata"),
    )


def oversize_tables(blocks: DataFrame) -> DataFrame:
    """Tables beyond the limits, which strict parsing rejects."""
    over = F.when(F.col("table_metadata.rows") > K.MAX_TABLE_ROWS, "rows").when(F.col("table_metadata.cols") > K.MAX_TABLE_COLS, "columns")
    over = F.when(F.size(F.split("content", "\n", -1)) > K.MAX_TABLE_LINES, "lines").otherwise(over)
    return blocks.where("type = 'table'").withColumn("exceeds", over).where("exceeds is not null")


def rebuild_markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, version, content_md: the blocks' contents in order, joined by newlines."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "content")))
    return blocks.groupBy(*KEYS).agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("content_md"))


def line_blocks(content: DataFrame) -> DataFrame:
    """The simpler reading: a block for each line, blank ones too; lists by their first characters."""
    raw = F.col("raw")
    rows = content.select(*KEYS, F.posexplode(F.split("content_md", "\n", -1)).alias("pos", "raw"))
    numbered = raw.rlike(r"^\d") & F.contains(F.substring(raw, 1, 4), F.lit(". "))
    kind = F.when(raw.startswith("#"), "heading").when(raw.startswith("- ") | raw.startswith("* ") | numbered, "list").when(raw.startswith("!["), "image").otherwise("paragraph")
    level = F.when(kind == "heading", F.length(F.regexp_extract(raw, "^#+", 0)))
    return rows.select(*KEYS, "pos", kind.alias("type"), raw.alias("content"), level.alias("level"))


def table_cells(blocks: DataFrame) -> DataFrame:
    """doc_id, version, pos, row, col, text, align, kind of every table cell; rows are cut or filled to the header's width."""
    tables = blocks.where("type = 'table'").select(*KEYS, "pos", F.col("table_metadata.column_alignments").alias("aligns"), F.filter(F.split("content", "\n", -1), lambda s: ~T.is_table_separator(s) & (T.strip(s) != "")).alias("body"))
    rows = tables.select(*KEYS, "pos", "aligns", F.size(T.row_cells(F.get("body", F.lit(0)))).alias("width"), F.posexplode("body").alias("row", "line"))
    filled = F.slice(F.concat(T.row_cells(F.col("line")), F.array_repeat(F.lit(""), F.col("width"))), F.lit(1), F.col("width"))
    cells = rows.select(*KEYS, "pos", "row", "aligns", F.posexplode(filled).alias("col", "text"))
    return cells.select(*KEYS, "pos", "row", "col", "text", F.coalesce(F.get("aligns", F.col("col")), F.lit("left")).alias("align"), T.cell_kind(F.col("text")).alias("kind"))


def footnote_definitions(content: DataFrame) -> DataFrame:
    """doc_id, version, note_id, content: the last definition of each number."""
    found = lines(content).where(F.col("s").rlike(T.FOOTNOTE_DEF))
    note, body = (F.regexp_extract("s", T.FOOTNOTE_DEF, i) for i in (1, 2))
    return found.groupBy(*KEYS, note.cast("bigint").alias("note_id")).agg(F.max_by(body, F.col("line_no")).alias("content"))


def footnote_references(blocks: DataFrame) -> DataFrame:
    """doc_id, version, pos, ord, note_id of each reference in order."""
    refs = F.regexp_extract_all("content", F.lit(T.FOOTNOTE_REF), F.lit(1))
    return blocks.select(*KEYS, "pos", F.posexplode(refs).alias("ord", "n")).select(*KEYS, "pos", "ord", F.col("n").cast("bigint").alias("note_id"))


def footnotes(blocks: DataFrame, content: DataFrame) -> DataFrame:
    """References with the text of their notes, empty where none is defined."""
    return footnote_references(blocks).join(footnote_definitions(content), [*KEYS, "note_id"], "left").withColumn("content", F.coalesce("content", F.lit("")))


def list_numbers(rows: DataFrame, kind: str = "type", number_value: str = "List Number") -> DataFrame:
    """``number`` of ordered list items: counted within each unbroken run of them."""
    w = W.partitionBy(*KEYS).orderBy("pos")
    is_item = (F.col(kind) == number_value).cast("int")
    runs = rows.withColumn("__run", F.sum(1 - is_item).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    inner = W.partitionBy(*KEYS, "__run").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return runs.withColumn("number", F.when(F.col(kind) == number_value, F.sum(is_item).over(inner))).drop("__run")


def footnote_numbers(refs: DataFrame) -> DataFrame:
    """``number`` of each reference in reading order; foot- and endnotes share the sequence."""
    return refs.withColumn("number", F.row_number().over(W.partitionBy(*KEYS).orderBy("pos", "ord")))
