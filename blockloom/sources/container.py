"""Containers: a folder or a ZIP of content.md, structure.json, styles.json, manifest.json and assets.

Reading gives a row for each member; names that leave the container are refused before anything is read from them. Writing goes
container by container, each under a draft name that is renamed when whole.
"""

from __future__ import annotations

import io
import os
import posixpath
import shutil
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import constants as K
from blockloom.functions import text as T

DIRECTORY_SUFFIX, ZIP_SUFFIX = ".docdir", ".sdoc"
MEMBERS_SCHEMA = "path string, format string, name string, safe boolean, bytes binary, error string"


def detect_format(path: str) -> str:
    """``directory`` or ``zip``; anything else is an error."""
    if os.path.isdir(path):
        return "directory"
    with open(path, "rb") as f:
        if f.read(4) == b"PK\x03\x04":
            return "zip"
    raise ValueError(f"{path} is neither a folder nor a ZIP file")


def is_safe(name: str) -> bool:
    depth = 0
    for part in name.split("/"):
        depth += -1 if part == ".." else part not in ("", ".")
        if depth < 0:
            return False
    return not name.startswith("/")


def _zip_members(path: str, data: bytes) -> Iterator[dict]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in sorted(z.infolist(), key=lambda i: i.filename):
                if info.is_dir():
                    continue
                safe, small = is_safe(info.filename), info.file_size <= K.MAX_ASSET_BYTES
                yield {"path": path, "format": "zip", "name": info.filename, "safe": safe, "bytes": z.read(info) if safe and small else None, "error": None if safe and small else "too large" if safe else "unsafe name"}
    except (zipfile.BadZipFile, OSError) as e:
        yield {"path": path, "format": "zip", "name": None, "safe": False, "bytes": None, "error": f"{type(e).__name__}: {e}"[: K.ERROR_LENGTH]}


def read_zips(spark: SparkSession, path: str, glob: str = f"*{ZIP_SUFFIX}") -> DataFrame:
    """path, format, name, safe, bytes, error of every member of the ZIP containers under a path."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in MEMBERS_SCHEMA.split(", "))])
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                if rows := list(_zip_members(path.as_py(), content.as_py())):
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, MEMBERS_SCHEMA)


def read_directories(spark: SparkSession, path: str, suffix: str = DIRECTORY_SUFFIX) -> DataFrame:
    """The same rows for folder containers under a path: folders whose name ends in ``suffix``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    pattern = rf"^(.*{suffix.replace('.', '[.]')})/(.+)$"
    inside = files.where(F.col("path").rlike(pattern))
    name = F.regexp_extract("path", pattern, 2)
    return inside.select(F.regexp_extract("path", pattern, 1).alias("path"), F.lit("directory").alias("format"), name.alias("name"), T.safe_path(name).alias("safe"), F.col("content").alias("bytes"), F.lit(None).cast("string").alias("error"))


def texts(members: DataFrame) -> DataFrame:
    """path, name, text of the text members."""
    return members.where("safe and (name like '%.md' or name like '%.json')").select("path", "name", F.col("bytes").cast("string").alias("text"))


def containers(members: DataFrame) -> DataFrame:
    """path, format, files (sorted), error of each container."""
    return members.groupBy("path", "format").agg(F.array_sort(F.collect_set("name")).alias("files"), F.max("error").alias("error"))


STRUCTURE = "struct<blocks:array<struct<id:string,type:string,docx_paragraph_index:int,content_start:int,content_end:int,content_hash:string,level:int,image_path:string,table_metadata:struct<rows:int,cols:int,merged_cells:array<struct<start_row:int,start_col:int,row_span:int,col_span:int>>>,track_changes:array<struct<type:string,start:int,end:int,author:string,date:string,revision_id:string,deleted_text:string>>>>>"


def structure_blocks(members: DataFrame) -> DataFrame:
    """The blocks of structure.json by place, with the content their offsets cut from content.md; no structure, no blocks."""
    t = texts(members)
    content = t.where("name = 'content.md'").select("path", F.col("text").alias("content_md"))
    parsed = t.where("name = 'structure.json'").select("path", F.from_json("text", STRUCTURE).alias("s"))
    rows = parsed.select("path", F.posexplode("s.blocks").alias("pos", "b")).select("path", "pos", F.col("b.id").alias("block_id"), "b.*").drop("id")
    cut = F.substring("content_md", F.col("content_start") + 1, F.col("content_end") - F.col("content_start"))
    return rows.join(content, "path").withColumn("content", cut).drop("content_md")


def table_formats(members: DataFrame) -> DataFrame:
    """block_id, table_formatting (JSON) of the entries of styles.json."""
    entries = texts(members).where("name = 'styles.json'").select(F.explode(F.from_json("text", "struct<block_styles:map<string,struct<table_formatting:string>>>")["block_styles"]).alias("block_id", "s"))
    return entries.select("block_id", "s.table_formatting")


def documents(blocks: DataFrame, styles: DataFrame, timestamp: str, source_file: str = "", source_hash: str = "", key: str = "doc_id", version_key: str = "format_version") -> DataFrame:
    """key, content_md, structure, styles, manifest (JSON texts) from block and style rows.

    ``version_key`` is the manifest's name for the format version; tools that share containers set the name they agree on.
    """
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct("pos", *c)))
    kept = [c for c in ("docx_paragraph_index", "content_start", "content_end", "content_hash", "level", "image_path", "inline_formatting", "table_metadata", "track_changes", "footnote_references", "text_box_metadata", "chart_metadata") if c in blocks.columns]
    block = F.struct(F.col("block_id").alias("id"), "type", *kept)
    content = blocks.groupBy(key).agg(ordered("content", block.alias("block")).alias("b"))
    md = F.array_join(F.transform("b", lambda x: x["content"]), "\n")
    content = content.select(key, md.alias("content_md"), F.to_json(F.struct(F.transform("b", lambda x: x["block"]).alias("blocks"))).alias("structure"))
    fields = [c for c in styles.columns if c not in (key, "block_id")]
    by_block = styles.groupBy(key).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("block_id", F.struct(*fields)))).alias("block_styles"))).alias("styles"))
    manifest = F.to_json(F.struct(
        F.lit(K.FORMAT_VERSION).alias(version_key), F.lit(timestamp).alias("created_at"), F.lit(timestamp).alias("modified_at"), F.lit(source_file).alias("source_file"),
        F.lit(source_hash).alias("source_hash"), F.sha2("content_md", 256).alias("content_hash"), F.lit("blockloom").alias("generator"),
    ))
    return content.join(by_block, key, "left").select(key, "content_md", "structure", F.coalesce("styles", F.lit('{"block_styles":{}}')).alias("styles"), manifest.alias("manifest"))


def write(docs: DataFrame, folder: str, packed: bool = True, key: str = "doc_id") -> DataFrame:
    """Write one container for each row of :func:`documents`, to a folder that executors share; returns key and path.

    A column ``assets`` (map of name to bytes) is written where there is one. The rows have to be acted on for files to appear.
    """
    has_assets = "assets" in docs.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            paths = []
            for row in batch.to_pylist():
                members = {"content.md": row["content_md"], "structure.json": row["structure"], "styles.json": row["styles"], "manifest.json": row["manifest"]}
                members = {k: (v or "").encode() for k, v in members.items()}
                members |= {f"assets/{n}": b for n, b in dict(row["assets"] or ()).items() if is_safe(n)} if has_assets else {}
                target = posixpath.join(folder, f"{row[key]}{ZIP_SUFFIX if packed else DIRECTORY_SUFFIX}")
                draft = f"{target}.{uuid.uuid4().hex}.tmp"
                os.makedirs(folder, exist_ok=True)
                if packed:
                    with zipfile.ZipFile(draft, "w", zipfile.ZIP_DEFLATED) as z:
                        for name, data in sorted(members.items()):
                            z.writestr(name, data)
                    os.replace(draft, target)
                else:
                    for name, data in members.items():
                        os.makedirs(os.path.dirname(os.path.join(draft, name)), exist_ok=True)
                        with open(os.path.join(draft, name), "wb") as f:
                            f.write(data)
                    shutil.rmtree(target, ignore_errors=True)
                    os.replace(draft, target)
                paths.append(target)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(paths, pa.string())], names=[key, "path"])

    return docs.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, path string")


def pack(folder: str, target: str) -> None:
    """A folder container as a ZIP; all four files are needed."""
    import json

    for name in K.ALL_FILES:
        if not os.path.isfile(os.path.join(folder, name)):
            raise FileNotFoundError(f"{name} is missing")
        if name.endswith(".json"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                json.load(f)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(folder):
            for n in sorted(names):
                z.write(os.path.join(top, n), os.path.relpath(os.path.join(top, n), folder))


def unpack(path: str, folder: str) -> None:
    """A ZIP container as a folder; every name is tested before the first is written."""
    with zipfile.ZipFile(path) as z:
        infos = z.infolist()
        if any(not is_safe(i.filename) for i in infos):
            raise ValueError("a member's name leaves the container")
        if any(i.file_size > K.MAX_ASSET_BYTES for i in infos):
            raise ValueError("a member is too large")
        z.extractall(folder)
