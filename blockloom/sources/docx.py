"""Word files as tables, and tables as Word files.

``elements`` scans files once, in Arrow batches; blocks, sections, styles, notes and headers are expressions and windows over it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from blockloom.functions import constants as K
from blockloom.functions import text as T
from blockloom.sources.ooxml import ELEMENTS_SCHEMA, elements as scan


def files(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """path, content of matching files; large files are one row each."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def elements(binary: DataFrame) -> DataFrame:
    """Rows of the scan for ``binary(path, content)``."""

    schema = to_arrow_schema(StructType.fromDDL(ELEMENTS_SCHEMA))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = list(scan(path.as_py(), content.as_py() or b""))
                if rows:
                    for r in rows:
                        r["page"] = list((r.get("page") or {}).items())
                        for line in r.get("cells") or ():
                            for c in line:
                                c["borders"] = list(c["borders"].items())
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return binary.select("path", "content").mapInArrow(run, ELEMENTS_SCHEMA)


def _paragraph_text(pieces: Column, mode: Column) -> Column:
    """Markdown of a paragraph's pieces; notes keep a place holder ``[^#]`` until they are numbered."""
    def one(p: Column) -> Column:
        kind, text = p["kind"], p["text"]
        marked = T.wrap_formatting(text, F.coalesce(p["bold"], F.lit(False)), F.coalesce(p["italic"], F.lit(False)))
        link = F.when(p["url"].isNull(), text).otherwise(T.link(text, p["url"], F.coalesce(p["bold"], F.lit(False)), F.coalesce(p["italic"], F.lit(False))))
        ins = F.when(mode == "track_changes", F.concat(F.lit("{++"), text, F.lit("++}"))).when(mode == "accept_all", text).otherwise("")
        gone = F.when(mode == "track_changes", F.concat(F.lit("{--"), text, F.lit("--}"))).otherwise("")
        note = F.concat(F.lit("[^"), p["number"].cast("string"), F.lit("]"))
        return F.when(kind == "ins", ins).when(kind == "del", gone).when(kind == "link", link).when(kind.isin("footnote", "endnote"), note).otherwise(marked)

    return F.array_join(F.transform(pieces, one), "")


def _numbered(found: DataFrame) -> DataFrame:
    """Note references numbered in reading order over the file."""
    is_note = lambda p: p["kind"].isin("footnote", "endnote")
    w = W.partitionBy("path").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumn("__n", F.size(F.filter(F.coalesce("pieces", F.array().cast(found.schema["pieces"].dataType)), is_note)))
    found = found.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    within = lambda i: F.size(F.filter(F.slice("pieces", F.lit(1), i + 1), is_note))
    return found.withColumn("pieces", F.transform("pieces", lambda p, i: p.withField("number", (F.col("__before") + within(i)).cast("int")))).drop("__n", "__before")


def _shape(pieces: Column, mode: Column) -> tuple[Column, Column]:
    """Track changes and inline spans, with offsets in the text without markers."""
    size = lambda p: F.when(p["kind"].isin("footnote", "endnote"), F.length(p["number"].cast("string")) + 3).when((p["kind"] == "ins") & (mode == "normal"), 0).when((p["kind"] == "del") & (mode != "track_changes"), 0).otherwise(F.length(p["text"]))
    placed = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda a, q: a + size(q)).alias("at")))
    end = lambda x: x["at"] + F.length(x["p"]["text"])
    changed = F.transform(
        F.filter(placed, lambda x: x["p"]["kind"].isin("ins", "del") & (mode == "track_changes")),
        lambda x: F.struct(
            F.when(x["p"]["kind"] == "ins", "insertion").otherwise("deletion").alias("type"), x["at"].alias("start"), end(x).alias("end"), x["p"]["author"].alias("author"),
            x["p"]["date"].alias("date"), x["p"]["rev"].alias("revision_id"), F.when(x["p"]["kind"] == "del", x["p"]["text"]).alias("deleted_text"),
        ),
    )
    spans = F.transform(
        F.filter(placed, lambda x: ((x["p"]["kind"] == "link") & x["p"]["url"].isNotNull()) | F.coalesce(x["p"]["underline"], F.lit(False))),
        lambda x: F.struct(F.when(x["p"]["kind"] == "link", "hyperlink").otherwise("underline").alias("type"), x["at"].alias("start"), end(x).alias("end"), x["p"]["url"].alias("url"), x["p"]["underline"].alias("underline")),
    )
    return changed, spans


def _gfm(cells: Column) -> Column:
    """A table's markdown: merged cells repeat over their columns and rows."""
    line = lambda texts: F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |"))
    spread = lambda row: F.flatten(F.transform(row, lambda c: F.array_repeat(c, c["span"])))
    rows = F.transform(cells, lambda row: line(F.transform(spread(row), lambda c: c["text"])))
    rule = line(F.transform(spread(F.get(cells, F.lit(0))), lambda c: T.alignment_separator(c["align"])))
    return F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")


def blocks(found: DataFrame, track_changes: bool | None = None) -> DataFrame:
    """Blocks of every file in order, from :func:`elements`.

    ``track_changes``: True keeps changes as CriticMarkup, False accepts them, None keeps them where a file has any.
    """
    file = W.partitionBy("path")
    order = file.orderBy("ord")
    has = F.max(F.coalesce(F.exists("pieces", lambda p: p["kind"].isin("ins", "del")), F.lit(False))).over(file)
    mode = F.lit("track_changes") if track_changes else F.lit("accept_all") if track_changes is False else F.when(has, "track_changes").otherwise("normal")
    rows = _numbered(found.where("tag in ('p', 'tbl')").withColumn("mode", mode))
    boxed = F.coalesce(F.size("boxes") > 0, F.lit(False))
    pictured = F.col("image").isNotNull()
    problem = F.when(F.col("image.bytes").isNotNull(), T.image_problem(F.col("image.bytes"), F.col("image.ext")))
    rows = rows.withColumn("problem", problem).withColumn("nth", F.sum(pictured.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.withColumn("para", F.sum((F.col("tag") == "p").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("number_item", (F.col("style") == "List Number") & ~pictured & ~boxed)
    rows = rows.withColumn("run_id", F.sum((~F.coalesce(F.col("number_item"), F.lit(False))).cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.withColumn("item", F.sum(F.coalesce(F.col("number_item"), F.lit(False)).cast("int")).over(W.partitionBy("path", "run_id").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)))
    text = _paragraph_text(F.col("pieces"), F.col("mode"))
    level = F.when(F.col("style").startswith("Heading"), F.coalesce(F.regexp_extract("style", r"(\S+)$", 1).try_cast("int"), F.lit(1)))
    level = F.when(~pictured & ~boxed, level)
    nth = F.col("nth").cast("string")
    picture = F.concat(F.lit("assets/image"), nth, F.lit("."), F.col("image.ext"))
    shown = (
        F.when(F.col("image.chart") & F.col("image.bytes").isNull(), "[Chart: no preview available]")
        .when(F.col("problem").isNotNull(), F.concat(F.when(F.col("image.chart"), "[Chart ").otherwise("[Image "), nth, F.lit(" skipped: "), F.col("problem"), F.lit("]")))
        .when(F.col("image.chart"), F.concat(F.lit("![Chart]("), picture, F.lit(")"))).otherwise(F.concat(F.lit("![Image "), nth, F.lit("]("), picture, F.lit(")")))
    )
    good = pictured & F.col("problem").isNull() & F.col("image.bytes").isNotNull()
    kind = F.when(boxed, "textbox").when(F.col("tag") == "tbl", "table").when(good & F.col("image.chart"), "chart").when(good, "image").when(pictured, "paragraph").when(level.isNotNull(), "heading").when(F.col("style").isin("List Bullet", "List Number"), "list").otherwise("paragraph")
    content = (
        F.when(F.col("tag") == "tbl", _gfm(F.col("cells"))).when(pictured, shown).when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when(F.col("style") == "List Bullet", F.concat(F.lit("- "), text)).when(F.col("style") == "List Number", F.concat(F.col("item").cast("string"), F.lit(". "), text)).otherwise(text)
    )
    changed, spans = _shape(F.col("pieces"), F.col("mode"))
    plain = ~pictured & ~boxed & (F.col("tag") == "p")
    refs = F.transform(F.filter("pieces", lambda p: p["kind"].isin("footnote", "endnote")), lambda p: F.struct(p["number"].alias("note_id"), p["kind"].alias("note_type"), F.concat(F.lit("[^"), p["number"].cast("string"), F.lit("]")).alias("marker"), p["note"].alias("original_id")))
    some = lambda a, ok=plain: F.when(ok & (F.size(a) > 0), a)
    rows = rows.select(
        "path", "ord", kind.alias("type"), content.alias("content"), "boxes", F.when(F.col("tag") == "p", F.coalesce("para", F.lit(0))).otherwise(-1).cast("int").alias("docx_paragraph_index"), level.cast("int").alias("level"),
        F.when(good, picture).alias("image_path"), F.when(good, F.col("image.bytes")).alias("asset"), some(spans).alias("inline_formatting"), some(changed).alias("track_changes"), some(refs).alias("footnote_references"),
        F.when(F.col("tag") == "tbl", F.struct(F.size("cells").alias("rows"), F.aggregate(F.get("cells", F.lit(0)), F.lit(0), lambda a, c: a + c["span"]).alias("cols"), F.transform(F.get("cells", F.lit(0)), lambda c: c["align"]).alias("column_alignments"), "header_rows", F.col("merged").alias("merged_cells"))).alias("table_metadata"),
        F.when(F.col("image.chart"), F.struct(F.col("image.rel").alias("chart_rel_id"))).alias("chart_metadata"), "style", "align", "pieces", "cells", "widths", "table_style",
    )
    rows = rows.select("*", F.posexplode_outer("boxes").alias("box", "text_box_metadata"))
    inner = F.concat(F.lit("<!-- textbox -->\n"), F.array_join("text_box_metadata.texts", "\n"), F.lit("\n<!-- /textbox -->"))
    rows = rows.withColumn("content", F.when(F.col("type") == "textbox", inner).otherwise(F.coalesce("content", F.lit("")))).drop("boxes")
    notes = _definitions(found, rows)
    rows = rows.unionByName(notes, allowMissingColumns=True)
    place = W.partitionBy("path").orderBy("ord", F.coalesce("box", F.lit(0)))
    rows = rows.withColumn("pos", F.row_number().over(place) - 1).drop("ord", "box")
    before = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("content_start", F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0)).cast("int"))
    return rows.withColumn("content_end", (F.col("content_start") + F.length("content")).cast("int")).withColumn("content_hash", F.sha2("content", 256)).withColumn("block_id", F.concat(F.lit("block-"), F.col("pos").cast("string")))


def _definitions(found: DataFrame, rows: DataFrame) -> DataFrame:
    """One last paragraph for each file with notes: their definitions by number; notes that nothing refers to are dropped."""
    refs = rows.select("path", F.inline("footnote_references")).select("path", "note_id", F.col("note_type").alias("type"), F.col("original_id").alias("id"))
    notes = found.where("tag = 'note'").select("path", "note.type", "note.id", "note.text")
    line = F.concat(F.lit("[^"), F.col("note_id").cast("string"), F.lit("]: "), F.col("text"))
    each = refs.join(notes, ["path", "type", "id"]).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("note_id", line.alias("line")))).alias("lines"))
    return each.select("path", F.lit(2147483647).alias("ord"), F.lit("paragraph").alias("type"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("content"), F.lit(-1).alias("docx_paragraph_index"))


def sections(found: DataFrame) -> DataFrame:
    """Column layout by ranges of body elements; a file without any has one of a single column."""
    w = W.partitionBy("path").orderBy("ord")
    body = found.where("tag in ('p', 'tbl', 'sectPr')").withColumn("i", F.sum((F.col("tag") != "sectPr").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - 1)
    ends = body.where("section is not null").select("path", "ord", "section.*", F.greatest("i", F.lit(0)).alias("end_block_index"))
    none = body.groupBy("path").agg(F.max(F.col("section").isNotNull()).alias("has"), F.greatest(F.max("i"), F.lit(0)).alias("end_block_index")).where("not has")
    default = none.select("path", F.lit(0).alias("ord"), F.lit(1).alias("column_count"), F.lit(None).cast("int").alias("column_spacing"), F.lit(True).alias("equal_width"), F.lit(None).cast("array<struct<width:int,space:int>>").alias("columns"), "end_block_index")
    both = ends.unionByName(default)
    return both.withColumn("start_block_index", F.coalesce(F.lag("end_block_index").over(w) + 1, F.lit(0))).withColumn("ord", F.row_number().over(w) - 1)


def header_footers(found: DataFrame) -> DataFrame:
    """path, variants (variant to its paragraphs), page_setup."""
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    rows = found.where("tag = 'hf'").groupBy("path", "variant").agg(F.array_sort(F.collect_list(F.struct("ord", F.when(F.col("image").isNotNull(), "image").otherwise("paragraph").alias("type"), F.when(F.col("image").isNull(), text).alias("content")))).alias("p"))
    variants = rows.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("variant", F.transform("p", lambda x: F.struct(x["type"].alias("type"), x["content"].alias("content")))))).alias("variants"))
    page = found.where("tag = 'sectPr'").groupBy("path").agg(F.max_by("page", "ord").alias("page_setup"))
    return page.join(variants, "path", "left")


def styles(found_blocks: DataFrame) -> DataFrame:
    """One row for each block: style name, font, size, alignment with their defaults, and a table's formatting."""
    first = F.get(F.filter("pieces", lambda p: p["kind"] == "run"), F.lit(0))
    kept = F.map_from_entries(F.flatten(F.transform("cells", lambda row, r: F.transform(row, lambda c, i: F.struct(F.concat_ws(",", r.cast("string"), i.cast("string")).alias("key"), F.struct(c["fill"].alias("background_color"), c["pattern"].alias("pattern_fill"), c["borders"].alias("borders")).alias("value"))))))
    formatting = F.when(F.col("type") == "table", F.struct(F.col("widths").alias("column_widths"), "table_style", kept.alias("cell_styles")))
    return found_blocks.select(
        "path", "block_id", F.coalesce("style", F.lit("Normal")).alias("docx_style"), F.coalesce(first["font"], F.lit(K.DEFAULT_STYLE["font_name"])).alias("font_name"),
        F.coalesce(first["size"], F.lit(float(K.DEFAULT_STYLE["font_size"]))).alias("font_size"), F.coalesce("align", F.lit(K.DEFAULT_STYLE["alignment"])).alias("alignment"),
        first["bold"].alias("bold"), first["italic"].alias("italic"), first["underline"].alias("underline"), formatting.alias("table_formatting"),
    )


def raw_text(found: DataFrame) -> DataFrame:
    """path, text: the texts of all non-blank paragraphs, joined by newlines."""
    text = F.array_join(F.transform(F.filter("pieces", lambda p: p["kind"].isin("run", "link")), lambda p: p["text"]), "")
    rows = found.where("tag = 'p'").withColumn("t", text).where(F.length(T.strip(F.col("t"))) > 0)
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), "\n").alias("text"))
