"""WARC archives: a writer with revisit records, and a reader that salvages what follows damage.

Shards are ``.warc.gz`` files with one gzip member for each record (plain ``.warc`` files are read too). The reader plans byte
ranges; a range yields the records that begin in it. A record that fails a check (gzip trailer, header lines, length, block
digest) is left; the reader looks for the next member or version line that passes, goes on there, and reports the bytes between
as a gap with its reason. A range that begins inside a record looks for its first record in the same way, without a gap.

Null payloads are empty, null URLs are left out, repeated rows are written as often as they come. Of equal payloads the record
with the largest id is the response; rows that repeat this id are responses as well. Null ids are written as ``none`` and read
as null. An empty table gives no shards, and reading gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.skew import lookup_join
from blockloom.llm.storage import checkpointed, filesystem

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RANGE = 16 << 20
CHUNK = 1 << 20
RECORDS_SCHEMA = (
    "path string, offset bigint, length bigint, gap string, record_type string, record_id string, target_uri string, "
    "payload_digest string, refers_to string, payload_bytes bigint, payload binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, response_id=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record; with ``response_id`` a revisit of that page, which holds no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if response_id is not None else head + payload
    name = "none" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response_id is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if response_id is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{response_id}>"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload, response_id: which page each repeated payload of ``least_bytes`` or more refers to.

    Copies of a frequent payload stay where they are: its response is looked up by broadcast."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    digests = pages.select(F.col(key).alias("page_id"), F.sha1(F.coalesce(F.col(payload).cast("binary"), F.lit(b""))).alias("sha1"), F.coalesce(F.octet_length(payload), F.lit(0)).alias("bytes"))
    repeated = digests.where(F.col("bytes") >= least_bytes).groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("response_id")).where("n > 1")
    joined = lookup_join(rows.withColumn("sha1", F.sha1("payload")), checkpointed(repeated), "sha1", "n", keep_all=True)
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id")).alias("response_id"))


def write(rows: DataFrame, folder: str, level: int = 6) -> list[tuple[str, int]]:
    """Write the output of :func:`with_revisits`, a shard for each partition; returns the shards' names and sizes.

    A shard is written under its attempt's name and renamed when it is whole, so repeated tasks leave one whole shard.
    """
    fs, path = filesystem(folder)
    fs.create_dir(path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        there, base = filesystem(folder)
        there.create_dir(base)
        name, sink, size = f"part-{task.partitionId():06d}.warc.gz", None, 0
        draft = f"{base}/.{name}-{task.taskAttemptId()}"
        for batch in batches:
            for page_id, url, payload, response_id in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "response_id")), strict=True):
                sink = sink or there.open_output_stream(draft)
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = member.compress(record(page_id.as_py(), url.as_py(), payload.as_py(), response_id.as_py())) + member.flush()
                sink.write(data)
                size += len(data)
        if sink:
            sink.close()
            there.move(draft, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name], "size": [size]})

    return [(r["name"], r["size"]) for r in rows.mapInArrow(run, "name string, size bigint").collect()]


class Damaged(Exception):
    """A record that fails a check."""


class SalvageReader:
    """Records and gaps of one archive file that begin in a byte range."""

    def __init__(self, source, size: int, gz: bool):
        self.source, self.size, self.gz = source, size, gz
        self.at, self.held = 0, b""

    def bytes_at(self, at: int, n: int) -> bytes:
        if not self.at <= at or at + n > self.at + len(self.held):
            self.source.seek(at)
            self.at, self.held = at, self.source.read(min(max(n, CHUNK), self.size - at))
        return self.held[at - self.at : at - self.at + n]

    def _member(self, at: int) -> tuple[bytes, int]:
        """Content and length of the gzip member at an offset."""
        if self.bytes_at(at, 3) != b"\x1f\x8b\x08":
            raise Damaged("no gzip member")
        unpacker, out, here = zlib.decompressobj(31), [], at
        while not unpacker.eof:
            chunk = self.bytes_at(here, min(1 << 16, self.size - here))
            if not chunk:
                raise Damaged("the file ends in a member")
            try:
                out.append(unpacker.decompress(chunk))
            except zlib.error as e:
                raise Damaged("gzip check failed") from e
            if not out[0].startswith(b"WARC/"[: len(out[0])]):
                raise Damaged("the member holds no record")
            here += len(chunk) - len(unpacker.unused_data)
        return b"".join(out), here - at

    def _plain(self, at: int) -> tuple[bytes, int]:
        head, end, seen = self.bytes_at(at, min(1 << 16, self.size - at)), -1, 0
        while (end := head.find(b"\r\n\r\n", seen)) < 0 and head.startswith(b"WARC/") and at + len(head) < self.size:
            seen = max(0, len(head) - 3)
            head = self.bytes_at(at, min(4 * len(head), self.size - at))
        length = re.search(rb"(?i)\r\nContent-Length: *(\d{1,12})\r\n", head[: end + 2]) if end > 0 else None
        if not head.startswith(b"WARC/") or not length:
            raise Damaged("no record header")
        n = end + 4 + int(length[1]) + 4
        if at + n > self.size:
            raise Damaged("the file ends in a record")
        return self.bytes_at(at, n), n

    def record(self, at: int) -> tuple[dict, int]:
        """Checked fields and length of the record at an offset."""
        data, n = self._member(at) if self.gz else self._plain(at)
        head, separator, rest = data.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = fields.get("content-length", "")
        if not re.fullmatch(r"WARC/\d\.\d", first) or not separator or not length.isdigit():
            raise Damaged("no record header")
        block = rest[: int(length)]
        if len(block) != int(length) or rest[int(length) :] != b"\r\n\r\n":
            raise Damaged("wrong length")
        if fields.get("warc-block-digest", "sha1:").removeprefix("sha1:") not in ("", base32_sha1(block)):
            raise Damaged("wrong block digest")
        return fields | {"block": block}, n

    def next_valid(self, at: int) -> int:
        """Offset of the first record at or after an offset that passes all checks; the size if there is none."""
        mark = b"\x1f\x8b\x08" if self.gz else b"WARC/"
        while at < self.size:
            window = self.bytes_at(at, min(CHUNK, self.size - at))
            found = window.find(mark)
            if found < 0:
                at += max(1, len(window) - len(mark) + 1)
                continue
            at += found
            try:
                self.record(at)
                return at
            except Damaged:
                at += 1
        return self.size

    def read(self, begin: int, end: int) -> Iterator[tuple[int, int, dict | None, str | None]]:
        """(offset, length, fields, None) of records, (offset, length, None, reason) of gaps."""
        at = self.next_valid(begin) if begin else 0
        while at < min(end, self.size):
            try:
                fields, n = self.record(at)
                yield at, n, fields, None
            except Damaged as e:
                n = self.next_valid(at + 1) - at
                yield at, n, None, str(e)
            at += n


def _row(path: str, at: int, n: int, fields: dict | None, gap: str | None, with_payload: bool) -> dict:
    if fields is None:
        return {"path": path, "offset": at, "length": n, "gap": gap}
    head, _, payload = fields["block"].partition(b"\r\n\r\n")
    kind, full = fields.get("warc-type"), re.search(rb"(?i)\r\nContent-Length: *(\d+)", head)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response":
        digest, size = base32_sha1(payload), len(payload)
    else:
        size = int(full[1]) if full else len(payload)
    ids = {k: fields[f].strip("<>") for k, f in (("record_id", "warc-record-id"), ("refers_to", "warc-refers-to")) if f in fields}
    return {"path": path, "offset": at, "length": n, "record_type": kind, "target_uri": fields.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": size, "payload": payload if with_payload else None, **ids}


def read(spark: SparkSession, files: list[tuple[str, int]], with_payload: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """Rows of RECORDS_SCHEMA from files of given sizes: records, and gaps with their reason in ``gap``."""
    ranges = [(path, size, a, min(a + range_bytes, size)) for path, size in files for a in range(0, size, range_bytes)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in RECORDS_SCHEMA.split(", "))])
        for batch in batches:
            for x in batch.to_pylist():
                fs, path = filesystem(x["path"])
                with fs.open_input_file(path) as source:
                    rows, size = [], 0
                    for found in SalvageReader(source, x["size"], x["path"].endswith(".gz")).read(x["begin"], x["end"]):
                        rows.append(_row(x["path"], *found, with_payload))
                        size += 200 + len(rows[-1].get("payload") or b"")
                        if size > CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    plan = spark.createDataFrame(ranges, "path string, size bigint, begin bigint, end bigint")
    return plan.repartition(max(1, len(ranges))).mapInArrow(run, RECORDS_SCHEMA)


def page_ids(records: DataFrame, whole: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records.

    A gap fails the job, as pages would be missing; unless ``whole``, gaps are left out. Ranges cover every byte of the files, each
    of which is in a record or a gap, so without gaps all records are there."""
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
    if whole:
        lost = F.raise_error(F.concat(F.lit("gap in "), "path", F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), "gap"))
        records = records.withColumn("payload_bytes", F.when(F.col("gap").isNull(), F.col("payload_bytes")).otherwise(lost.cast("bigint")))
    else:
        records = records.where("gap is null")
    return records.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))
