"""Matching, comparing and re-keying two versions of documents, as joins on the document.

Block tables have ``doc_id, pos, block_id, type, content, content_hash``; ``old`` and ``new`` are two versions of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockloom.functions import constants as K
from blockloom.functions.inline import similarity

_COLUMNS = ["doc_id", "pos", "block_id", "type", "content", "content_hash"]


def _side(blocks: DataFrame, name: str) -> DataFrame:
    return blocks.select("doc_id", *(F.col(c).alias(f"{name}_{c}") for c in _COLUMNS if c != "doc_id"))


def match_unchanged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs of equal content: the n-th old block of a content meets the n-th new one."""
    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("hash", F.col("content_hash")).withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "hash").orderBy("pos")))

    left, right = ranked(old), ranked(new)
    pairs = left.select("doc_id", "hash", "nth", *(F.col(c).alias(f"old_{c}") for c in _COLUMNS[1:])).join(
        right.select("doc_id", "hash", "nth", *(F.col(c).alias(f"new_{c}") for c in _COLUMNS[1:])), ["doc_id", "hash", "nth"]
    )
    return pairs.drop("hash", "nth")


def match_edited(old: DataFrame, new: DataFrame, unchanged: DataFrame, threshold: float = K.SIMILARITY_THRESHOLD, cli_compat: bool = False) -> DataFrame:
    """Pairs of the blocks left over: same place, same type, similar content.

    An upper bound from the lengths alone goes first. ``cli_compat`` compares against empty old contents, as the command line does,
    so that only two empty contents are similar.
    """
    left = _side(old, "old").join(unchanged.select("doc_id", "old_pos"), ["doc_id", "old_pos"], "left_anti")
    right = _side(new, "new").join(unchanged.select("doc_id", "new_pos"), ["doc_id", "new_pos"], "left_anti")
    if cli_compat:
        left = left.withColumn("old_content", F.lit(""))
    keyed = [df.withColumn("__pos", F.col(f"{n}_pos")).withColumn("__type", F.col(f"{n}_type")) for n, df in (("old", left), ("new", right))]
    met = keyed[0].join(keyed[1], ["doc_id", "__pos", "__type"]).drop("__pos", "__type")
    a, b = F.length("old_content"), F.length("new_content")
    bound = F.when(a + b == 0, 1.0).otherwise(2 * F.least(a, b) / F.greatest(a + b, F.lit(1)))
    columns = unchanged.columns
    return met.where(bound >= threshold).withColumn("similarity", similarity("old_content", "new_content")).where(F.col("similarity") >= threshold).select(*columns)


def match_blocks(old: DataFrame, new: DataFrame, **options) -> DataFrame:
    """All pairs, unchanged and edited."""
    unchanged = match_unchanged(old, new)
    return unchanged.unionByName(match_edited(old, new, unchanged, **options))


def diff(old: DataFrame, new: DataFrame, matches: DataFrame) -> DataFrame:
    """doc_id, change (removed, added, modified, unchanged), block_id, pos, type, content: of the new block where there is one."""
    of = lambda n: [F.col(f"{n}_{c}").alias(c) for c in ("block_id", "pos", "type", "content")]
    paired = matches.select("doc_id", F.when(F.col("old_content_hash") == F.col("new_content_hash"), "unchanged").otherwise("modified").alias("change"), *of("new"))
    sides = []
    for name, change, blocks in (("old", "removed", old), ("new", "added", new)):
        rest = _side(blocks, name).join(matches.select("doc_id", f"{name}_pos"), ["doc_id", f"{name}_pos"], "left_anti")
        sides.append(rest.select("doc_id", F.lit(change).alias("change"), *of(name)))
    return paired.unionByName(sides[0]).unionByName(sides[1])


def remap_styles(styles: DataFrame, matches: DataFrame) -> DataFrame:
    """Styles of matched blocks under their new ids; ``styles(doc_id, block_id, ...)``. Others are dropped."""
    keys = matches.select("doc_id", F.col("old_block_id").alias("block_id"), F.col("new_block_id").alias("new_id"))
    return styles.join(keys, ["doc_id", "block_id"]).drop("block_id").withColumnRenamed("new_id", "block_id")


def reverse_mapping(matches: DataFrame) -> DataFrame:
    return matches.select("doc_id", F.col("new_block_id").alias("block_id"), F.col("old_block_id").alias("style_id"))


def styles_of(blocks: DataFrame, styles: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Blocks with their style, looked up by a mapped id where there is one; blocks without a style keep nulls."""
    if mapping is not None:
        blocks = blocks.join(mapping, ["doc_id", "block_id"], "left")
    else:
        blocks = blocks.withColumn("style_id", F.col("block_id"))
    wanted = blocks.withColumn("style_id", F.coalesce("style_id", "block_id"))
    return wanted.join(styles.withColumnRenamed("block_id", "style_id"), ["doc_id", "style_id"], "left")


def transfer(blocks: DataFrame, structure: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of structure rows carried over to the blocks at the same place; the longer side is cut."""
    return blocks.drop(*columns).join(structure.select("doc_id", "pos", *columns), ["doc_id", "pos"])


def in_sections(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Blocks with the section whose range of places holds them; ranges are joined within the document."""
    return blocks.join(sections, "doc_id").where(F.col("pos").between(F.col("start_block_index"), F.col("end_block_index")))


def section_ranges(ends: DataFrame) -> DataFrame:
    """Sections from their ends: each begins after the one before; ``ends(doc_id, ord, end_block_index)``."""
    w = W.partitionBy("doc_id").orderBy("ord")
    return ends.withColumn("start_block_index", F.coalesce(F.lag("end_block_index").over(w) + 1, F.lit(0)))
