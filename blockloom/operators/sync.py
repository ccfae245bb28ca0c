"""Versions of documents kept as rows: an edited content becomes a new version, and styles and metadata follow their blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators import match, parse


def sync(old_blocks: DataFrame, styles: DataFrame, content: DataFrame, cli_compat: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of the new content, their styles, and the changes.

    ``cli_compat`` leaves the styles as they are for documents without any match, as the command line does.
    """
    new = parse.parse_blocks(content)
    matches = match.match_blocks(old_blocks, new, cli_compat=cli_compat)
    kept = match.remap_styles(styles, matches)
    if cli_compat:
        unmatched = styles.join(matches.select("doc_id").distinct(), "doc_id", "left_anti")
        kept = kept.unionByName(unmatched.select(*kept.columns))
    return new, kept, match.diff(old_blocks, new, matches)


def updated_manifest(manifest: DataFrame, content: DataFrame, timestamp: str) -> DataFrame:
    """The manifest with the hash of the new content and the given time."""
    hashes = content.select("doc_id", F.sha2("content_md", 256).alias("__hash"))
    joined = manifest.join(hashes, "doc_id", "left")
    new = {"content_hash": F.coalesce("__hash", "content_hash"), "modified_at": F.when(F.col("__hash").isNotNull(), timestamp).otherwise(F.col("modified_at"))}
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in manifest.columns))
