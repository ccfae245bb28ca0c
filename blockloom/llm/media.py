"""Payloads as 8-bit grey PNG images in tar archives, and a Spark data source that reads such archives by byte ranges.

``store`` writes a tar archive for each partition, and beside it where the first member of each STEP bytes begins. The source
``payload_archives`` plans ranges of about ``range_bytes`` over all archives of a folder that begin at members; in archives without
such a list ranges begin anywhere, and look for their first header. A range yields the members whose header begins in it, in Arrow
batches of bounded size. Each member is read on its own from its offset, with ``attempts`` tries; one that stays unreadable, or
whose header is damaged, gives a row with ``error`` and no payload, and reading goes on at the next header that passes its check.

Null texts are empty; every payload has zero bytes added up to a positive multiple of 64. Equal texts give equal images. Null
ids are stored as ``none`` and read as null; repeated rows are stored as often as they come. No rows, no archives, no rows back.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from blockloom.llm.storage import filesystem

UNIT = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEMBERS_SCHEMA = "archive string, offset bigint, name string, media binary, error string"
BATCH = 4 << 20
STEP = 4 << 20


def padded(data: bytes) -> bytes:
    return data + bytes(max(-len(data) % UNIT, UNIT if not data else 0))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(payload: bytes, n_bytes: int, level: int = 1) -> bytes:
    """A grey image, 64 samples wide, whose samples are the payload; the unpadded size is kept as text."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    filtered = np.zeros((len(rows), UNIT + 1), np.uint8)
    filtered[:, 1:] = rows
    header = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"tEXt", b"bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(filtered, level)) + _chunk(b"IEND", b"")


def from_image(image: bytes) -> tuple[bytes, int]:
    """Samples and unpadded size of an image of :func:`to_image`; every chunk's checksum is tested."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, chunks = 8, {}
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("wrong checksum")
        chunks[kind] = chunks.get(kind, b"") + data
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(-1, UNIT + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes(), int(chunks[b"tEXt"].partition(b"\0")[2])


def feature(payload: bytes) -> str:
    """Mean, standard deviation, entropy in bits and rate of change of the samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    change = np.abs(np.diff(x.astype(np.int16))).mean() if len(x) > 1 else 0.0
    return f"{x.mean():.4f},{x.std():.4f},{-(share * np.log2(share)).sum() + 0.0:.4f},{change:.4f}"


def store(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> int:
    """Write an archive for each partition; returns the number of members. Whole archives only are given their final name."""
    fs, path = filesystem(folder)
    fs.create_dir(path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        there, base = filesystem(folder)
        there.create_dir(base)
        name, sink, n = f"part-{task.partitionId():06d}.tar", None, 0
        draft, starts = f"{base}/.{name}-{task.taskAttemptId()}", []
        for batch in batches:
            for doc_id, value in zip(batch.column(0), batch.column(1), strict=True):
                if sink is None:
                    sink = there.open_output_stream(draft)
                    archive = tarfile.open(fileobj=sink, mode="w|", format=tarfile.USTAR_FORMAT)
                data = (value.as_py() or "").encode()
                image = to_image(padded(data), len(data))
                member = tarfile.TarInfo(f"{doc_id.as_py() if doc_id.is_valid else 'none'}.png")
                member.size = len(image)
                if archive.offset >= len(starts) * STEP:
                    starts += [archive.offset] * (archive.offset // STEP + 1 - len(starts))
                archive.addfile(member, io.BytesIO(image))
                n += 1
        if sink:
            archive.close()
            sink.close()
            with there.open_output_stream(f"{draft}.starts") as index:
                index.write(np.array(starts, "<i8").tobytes())
            there.move(f"{draft}.starts", f"{base}/{name}.starts")
            there.move(draft, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return sum(r["n"] for r in docs.select(key, text).mapInArrow(run, "n bigint").collect())


class ArchiveRange(InputPartition):
    def __init__(self, path: str, size: int, begin: int, end: int, known: bool):
        self.path, self.size, self.begin, self.end, self.known = path, size, begin, end, known


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        blocks = -(-int(options.get("range_bytes", 16 << 20)) // tarfile.BLOCKSIZE)
        self.range_bytes = max(1, blocks) * tarfile.BLOCKSIZE  # members begin at whole blocks
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[ArchiveRange]:
        from pyarrow import fs as pafs

        fs, base = filesystem(self.folder)
        prefix = self.folder.rstrip("/")
        found = {f.base_name: f.size for f in fs.get_file_info(pafs.FileSelector(base)) if f.is_file and not f.base_name.startswith(".")}
        planned = []
        for name in sorted(n for n in found if n.endswith(".tar")):
            size = found[name]
            known = f"{name}.starts" in found
            if known:
                with fs.open_input_file(f"{base}/{name}.starts") as index:
                    starts = np.frombuffer(index.read(), "<i8")
                wanted = np.searchsorted(starts, np.arange(0, size, self.range_bytes), "left")
                begins = sorted({0, *starts[wanted[wanted < len(starts)]].tolist()})
            else:
                begins = list(range(0, size, self.range_bytes))
            planned += [ArchiveRange(f"{prefix}/{name}", size, a, z, known) for a, z in zip(begins, [*begins[1:], size], strict=True)]
        return planned or [ArchiveRange("", 0, 0, 0, False)]

    def _bytes(self, path: str, at: int, n: int) -> bytes:
        for attempt in range(self.attempts):
            try:
                fs, local = filesystem(path)
                with fs.open_input_file(local) as source:
                    source.seek(at)
                    data = source.read(n)
                if len(data) == n:
                    return data
                raise OSError(f"{path}: {len(data)} bytes of {n} at {at}")
            except OSError:
                if attempt + 1 == self.attempts:
                    raise
        raise AssertionError

    def read(self, partition: ArchiveRange) -> Iterator:
        import pyarrow as pa

        rows, size = [], 0
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("name", pa.string()), ("media", pa.binary()), ("error", pa.string())])
        for at, name, data, error in self._members(partition):
            rows.append({"archive": partition.path, "offset": at, "name": name, "media": data, "error": error})
            size += len(data or b"")
            if size > BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _members(self, p: ArchiveRange) -> Iterator[tuple[int, str | None, bytes | None, str | None]]:
        """The range is read ahead once; only members that this can't serve are read again on their own."""
        if not p.size:
            return
        ahead_at, ahead = p.begin, b""
        at = p.begin

        def bytes_at(a: int, n: int) -> bytes:
            nonlocal ahead_at, ahead
            if a < ahead_at or a + n > ahead_at + len(ahead):
                ahead_at, ahead = a, self._bytes(p.path, a, min(max(n, BATCH), p.size - a))
            return ahead[a - ahead_at : a - ahead_at + n]

        lost = None if p.known or not p.begin else -1  # -1: looking for the first header, which isn't damage
        while at < p.end and at + tarfile.BLOCKSIZE <= p.size:
            member, why = None, "damaged header"
            try:
                header = bytes_at(at, tarfile.BLOCKSIZE)
                if header[257:262] == b"ustar":
                    member = tarfile.TarInfo.frombuf(header, "utf-8", "surrogateescape")
            except tarfile.HeaderError:
                pass
            except OSError as e:
                why = str(e)[:200]
            if member is None:
                if lost is None and any(header if why == "damaged header" else b"1"):  # zeros end an archive
                    lost = at
                    yield at, None, None, why
                at += tarfile.BLOCKSIZE
                continue
            lost, begin = None, at + tarfile.BLOCKSIZE
            try:
                yield at, member.name, bytes_at(begin, member.size), None
            except OSError as e:
                yield at, member.name, None, str(e)[:200]
            at = begin + -(-member.size // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE


class PayloadArchives(DataSource):
    """``spark.read.format("payload_archives").option("range_bytes", ...).load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "payload_archives"

    def schema(self) -> str:
        return MEMBERS_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


def read(spark: SparkSession, folder: str, range_bytes: int = 16 << 20) -> DataFrame:
    spark.dataSource.register(PayloadArchives)
    return spark.read.format("payload_archives").option("range_bytes", range_bytes).load(folder)


FEATURES_SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def features(members: DataFrame) -> DataFrame:
    """Sizes, digests and features of stored payloads, from the bytes read back; an unreadable member fails the job."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for name, media, error in zip(*(batch.column(c).to_pylist() for c in ("name", "media", "error")), strict=True):
                if media is None:
                    raise OSError(f"{name}: {error}")
                payload, n = from_image(media)
                stem = name.removesuffix(".png")
                rows.append((None if stem == "none" else int(stem), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            kinds = {"string": pa.string(), "bigint": pa.int64()}
            fields = [f.split() for f in FEATURES_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])

    return members.select("name", "media", "error").mapInArrow(run, FEATURES_SCHEMA)
