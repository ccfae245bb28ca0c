"""Command line: ``python -m blockloom.cli VERB ...``. Each verb runs one engine plan; exit codes say what went wrong."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys
import zipfile
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import constants as K
from blockloom.functions import text as T
from blockloom.operators import match, parse, validate
from blockloom.sources import container, docx, docx_writer

AUTHOR = "editor"
OK, ERROR, NOT_FOUND, INVALID, CONFLICT = 0, 1, 2, 3, 4


class Invalid(Exception):
    """A container that can't be used as asked."""


def _spark() -> SparkSession:
    return SparkSession.builder.appName("blockloom").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _need(path: str) -> str:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


def _members(spark: SparkSession, path: str) -> DataFrame:
    """Members of one container, folder or ZIP."""
    path = os.path.abspath(_need(path)).rstrip("/")
    try:
        if container.detect_format(path) == "zip":
            return container.read_zips(spark, path, glob="*")
    except ValueError as e:
        raise Invalid(str(e)) from e
    return _folder(spark, path)


def _folder(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index(F.col("path"), path + "/", -1)
    return files.select(F.lit(path).alias("path"), F.lit("directory").alias("format"), name.alias("name"), T.safe_path(name).alias("safe"), F.col("content").alias("bytes"), F.lit(None).cast("string").alias("error"))


def _directory(path: str) -> str:
    if container.detect_format(_need(path)) == "zip":
        raise Invalid("this works on folders; unpack the container first")
    return path


def _versions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stored blocks and the blocks of the content as it is now."""
    members = _members(spark, _directory(path))
    names = {r["name"] for r in members.select("name").collect()}
    if "content.md" not in names:
        raise FileNotFoundError("content.md")
    content = container.texts(members).where("name = 'content.md'").select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(1).cast("bigint").alias("version"), F.col("text").alias("content_md"))
    stored = container.structure_blocks(members).withColumn("doc_id", F.lit(1).cast("bigint"))
    return stored, parse.parse_blocks(content)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def extract(a: argparse.Namespace) -> int:
    spark = _spark()
    found = docx.elements(docx.files(spark, os.path.abspath(_need(a.input)), glob="*"))
    if bad := found.where("tag = 'error'").first():
        raise Invalid(bad["error"])
    out = a.output or os.path.splitext(a.input)[0] + (container.ZIP_SUFFIX if a.pack else container.DIRECTORY_SUFFIX)
    if os.path.exists(out) and not a.force:
        raise FileExistsError(out)
    blocks = docx.blocks(found, a.track_changes)
    stem = os.path.basename(out).rpartition(".")[0]
    keyed = lambda df: df.drop("path").withColumn("doc_id", F.lit(stem))
    source_hash = docx.files(spark, os.path.abspath(a.input), glob="*").select(F.sha2("content", 256)).first()[0]
    made = container.documents(keyed(blocks), keyed(docx.styles(blocks)), _now(), os.path.basename(a.input), source_hash)
    assets = keyed(blocks).where("asset is not null").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.replace("image_path", F.lit("assets/"), F.lit("")), "asset"))).alias("assets"))
    written = container.write(made.join(assets, "doc_id", "left"), os.path.dirname(os.path.abspath(out)), packed=a.pack).collect()
    if written[0]["path"] != os.path.abspath(out):
        os.replace(written[0]["path"], out)
    print(out)
    return OK


def build(a: argparse.Namespace) -> int:
    spark = _spark()
    members = _members(spark, a.input)
    content = container.texts(members).where("name = 'content.md'").select(F.lit(1).alias("doc_id"), F.lit(1).alias("version"), F.col("text").alias("content_md"))
    assets = members.where("safe and name like 'assets/%'").select(F.col("name").alias("image_path"), F.col("bytes").alias("asset"))
    blocks = parse.parse_blocks(content).join(assets, "image_path", "left")
    old = container.structure_blocks(members).select("content_hash", "track_changes").where("track_changes is not null").dropDuplicates(["content_hash"])
    blocks = blocks.join(old, "content_hash", "left")
    row = docx_writer.build(blocks, author=getattr(a, "author", None) or AUTHOR, date=_now(), notes=parse.footnote_definitions(content)).first()
    if row is None:
        raise FileNotFoundError("content.md")
    out = a.output or os.path.splitext(a.input.rstrip("/"))[0] + ".docx"
    with open(out, "wb") as f:
        f.write(row["docx"])
    print(out)
    return OK


def _changes(a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    old, new = _versions(_spark(), a.input)
    return old, new, match.diff(old, new, match.match_blocks(old, new, cli_compat=a.compat))


def diff(a: argparse.Namespace) -> int:
    _, _, changes = _changes(a)
    rows = changes.where("change <> 'unchanged'").orderBy("change", "pos").select("change", "type", T.preview(F.col("content")).alias("preview")).toLocalIterator()
    none = True
    for r in rows:
        none = False
        print({"removed": "-", "added": "+", "modified": "~"}[r["change"]], f"[{r['type']}]", r["preview"])
    if none:
        print("No changes")
    return OK


def _json(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def sync(a: argparse.Namespace) -> int:
    spark = _spark()
    old, new = _versions(spark, a.input)
    matches = match.match_blocks(old, new, cli_compat=a.compat)
    pairs = {r["old_block_id"]: r["new_block_id"] for r in matches.select("old_block_id", "new_block_id").toLocalIterator()}
    kept = [c for c in ("docx_paragraph_index", "content_start", "content_end", "content_hash", "level", "image_path", "table_metadata") if c in new.columns]
    blocks = [json.loads(r[0]) for r in new.orderBy("pos").select(F.to_json(F.struct(F.col("block_id").alias("id"), "type", *kept))).toLocalIterator()]
    structure, styles, manifest = (_json(os.path.join(a.input, n)) for n in ("structure.json", "styles.json", "manifest.json"))
    structure["blocks"] = blocks
    if pairs:
        styles["block_styles"] = {pairs[k]: v for k, v in styles.get("block_styles", {}).items() if k in pairs}
    with open(os.path.join(a.input, "content.md"), "rb") as f:
        manifest |= {"content_hash": hashlib.sha256(f.read()).hexdigest(), "modified_at": _now()}
    for name, value in (("structure.json", structure), ("styles.json", styles), ("manifest.json", manifest)):
        draft = os.path.join(a.input, name + ".tmp")
        with open(draft, "w", encoding="utf-8") as f:
            json.dump(value, f, indent=2, ensure_ascii=False)
        os.replace(draft, os.path.join(a.input, name))
    return build(argparse.Namespace(input=a.input, output=a.output, author=a.author)) if a.output else OK


def check(a: argparse.Namespace) -> int:
    spark = _spark()
    members = _members(spark, a.input)
    boxes = container.containers(members).withColumn("doc_id", F.lit(1))
    problems = [f"missing {n}" for r in validate.missing_files(boxes).toLocalIterator() for n in r["missing"]]
    problems += [r["error"] for r in members.where("error is not null").select("error").toLocalIterator()]
    t = container.texts(members).withColumn("doc_id", F.lit(1))
    problems += [f"invalid JSON in {r['name']}" for r in validate.malformed_json(t).toLocalIterator()]
    if problems:
        raise Invalid("; ".join(problems))
    content = t.where("name = 'content.md'").withColumn("content_md", F.col("text"))
    for r in validate.criticmarkup(content).toLocalIterator():
        print(f"line {r['line']}: {r['error']}")
    for r in validate.track_changes(container.structure_blocks(members).withColumn("doc_id", F.lit(1))).toLocalIterator():
        print(f"{r['block_id']}: change {r['nth']}: {r['warning']}")
    stored = container.structure_blocks(members).withColumn("doc_id", F.lit(1))
    formats = container.table_formats(members).withColumn("doc_id", F.lit(1))
    tables = stored.where("table_metadata is not null").select("doc_id", "block_id", "table_metadata.*")
    known = parse.parse_blocks(content.select("doc_id", F.lit(1).alias("version"), "content_md"))
    over = parse.oversize_tables(known).select("doc_id", "block_id", F.concat(F.lit("too many "), "exceeds").alias("warning"))
    for r in validate.all_warnings(validate.tables(stored, tables, formats), over).toLocalIterator():
        print(f"{r['block_id']}: {r['warning']}")
    print("valid")
    return OK


def info(a: argparse.Namespace) -> int:
    row = container.texts(_members(_spark(), a.input)).where("name = 'manifest.json'").select("text").first()
    if row is None:
        raise Invalid("no manifest.json")
    for k, v in json.loads(row["text"]).items():
        print(f"{k}: {v[: K.HASH_PREFIX_LENGTH] + '...' if k.endswith('hash') and len(v) > K.HASH_PREFIX_LENGTH else v}")
    return OK


def pack(a: argparse.Namespace) -> int:
    container.pack(_need(a.input), a.output or os.path.splitext(a.input.rstrip("/"))[0] + container.ZIP_SUFFIX)
    return OK


def unpack(a: argparse.Namespace) -> int:
    try:
        container.unpack(_need(a.input), a.output or os.path.splitext(a.input)[0] + container.DIRECTORY_SUFFIX)
    except (ValueError, zipfile.BadZipFile) as e:
        raise Invalid(str(e)) from e
    return OK


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="blockloom")
    verbs = p.add_subparsers(required=True)
    for name, f in {"extract": extract, "build": build, "sync": sync, "validate": check, "info": info, "unpack": unpack, "pack": pack, "diff": diff}.items():
        v = verbs.add_parser(name)
        v.add_argument("input")
        v.set_defaults(run=f)
        if name in ("extract", "build", "sync", "unpack", "pack"):
            v.add_argument("-o", "--output")
        if name == "extract":
            v.add_argument("--force", action="store_true")
            v.add_argument("--pack", action="store_true")
            v.add_argument("--track-changes", action=argparse.BooleanOptionalAction)
        if name in ("build", "sync"):
            v.add_argument("--author", default=AUTHOR, help="author of changes that have none yet")
        if name in ("sync", "diff"):
            v.add_argument("--compat", action="store_true", help="compare with empty old contents")
    a = p.parse_args(argv)
    try:
        return a.run(a)
    except FileNotFoundError as e:
        print(f"not found: {e}", file=sys.stderr)
        return NOT_FOUND
    except (Invalid, json.JSONDecodeError) as e:
        print(f"invalid: {e}", file=sys.stderr)
        return INVALID
    except Exception as e:  # noqa: BLE001  the last resort of a command
        print(f"error: {e}", file=sys.stderr)
        return ERROR


if __name__ == "__main__":
    sys.exit(main())
