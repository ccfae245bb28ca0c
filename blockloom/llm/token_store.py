"""Token ids as Arrow IPC files of equal-length sequences, one folder for a table.

Each shard ``part-*.arrow`` has record batches of ``ids fixed_size_list<uint16 or uint32>[L]`` and
``mask fixed_size_list<bool>[L]`` (false: padding after the last token), so sequence j of a memory-mapped shard is found by
arithmetic. ``part-*.docs.arrow`` says where in its shard each document begins. Shards follow ascending document ids.
Files are named by the task's attempt, and the table of shards names those of the attempt that counted, so both files of a shard
come from one attempt; what a lost or repeated attempt leaves is in no table. There is about one shard for each SHARD_BYTES of text.
Null texts are empty; every document ends with the end id. Ties in the id keep all rows, in no fixed order among them. Rows with
a null id come first and keep the null.
Tables without rows give no shards, and reading gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockloom.llm.bpe import parts
from blockloom.llm.pieces import PieceEncoder
from blockloom.llm.spans import SpanEncoder
from blockloom.llm.storage import filesystem, process_cache

ROWS = 512
SEQUENCES = 256
SHARD_BYTES = 16 << 20
#: So many pieces are encoded at a time; what the library makes of them on the way takes many times their size.
PIECES = 16384
KINDS = {2: np.uint16, 4: np.uint32}


class JsonTokenizer:
    """The tokenizers library's encoder of one JSON file, by pieces.

    Where the file splits texts by GPT-2's pattern and nothing else, texts are cut between its matches, many at once
    (:mod:`blockloom.llm.spans`). Texts with strings of added tokens, and those of other files, are cut before spaces only.
    As the library does by itself, strings of special tokens in a text become these tokens, unless ``special_as_text``. Special
    tokens with white space in them need ``special_as_text``, as pieces end there.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.encoder = PieceEncoder(lambda pieces: [ids for at in range(0, len(pieces), PIECES) for ids in self._encode(pieces[at : at + PIECES])])
        self.size = self.tokenizer.get_vocab_size()
        byte_of = _byte_alphabet()
        self.lengths = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.lengths[i] = len(token) if all(c in byte_of for c in token) else 0
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            if not special_as_text and re.search(r"\s", token.content):
                raise ValueError(f"special token {token.content!r} holds white space")
            self.lengths[i] = len(token.content.encode())
        spec = json.loads(self.tokenizer.to_str())
        rule = spec["pre_tokenizer"] or {}
        self.by_pattern = spec["normalizer"] is None and rule.get("type") == "ByteLevel" and rule["use_regex"] and not rule["add_prefix_space"]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.spans = SpanEncoder(self._encode_spans)

    @classmethod
    def get(cls, path: str, special_as_text: bool = False) -> JsonTokenizer:
        known, key = process_cache(), ("tokenizers", path, special_as_text)
        if key not in known:
            known[key] = cls(path, special_as_text)
        return known[key]

    def _one_by_one(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Pieces that start with a space or line end, and end in neither, are encoded joined, then cut by their bytes."""
        joined = [p for p in pieces if p[0] in " \n" and not p[-1].isspace()] if all(pieces) else []
        if len(joined) != len(pieces):
            return self._apart(pieces, joined)
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in joined])
        at = np.cumsum(self.lengths[ids])
        cut = np.searchsorted(at, ends) + 1
        if not len(at) or at[-1] != ends[-1] or not np.array_equal(at[cut - 1], ends):
            return self._one_by_one(pieces)
        raw, last = ids.tobytes(), (4 * cut).tolist()
        return [raw[a:z] for a, z in zip([0, *last], last, strict=False)]

    def _apart(self, pieces: list[str], joined: list[str]) -> list[bytes]:
        known = dict(zip(joined, self._encode(joined), strict=True)) if joined else {}
        rest = [p for p in pieces if p not in known]
        known.update(zip(rest, self._one_by_one(rest), strict=True))
        return [known[p] for p in pieces]

    def _encode_spans(self, spans: list[bytes]) -> list[bytes]:
        """Spans that begin with a space or line end are encoded joined, others with a line end between them, if they end in no
        white space; then they are cut by their bytes. What is left is encoded one by one."""
        ids, joined, apart = [b""] * len(spans), {b"": [], b"\n": []}, []
        for i, p in enumerate(spans):
            if _is_space(p, -1):
                apart.append(i)
            elif p[0] in b" \n":
                joined[b""].append(i)
            else:
                (apart if _is_space(p, 0) else joined[b"\n"]).append(i)
        for between, those in joined.items():
            for at in range(0, len(those), PIECES):
                some = those[at : at + PIECES]
                made = self._joined([spans[i] for i in some], between)
                if made is None:
                    apart += some
                else:
                    for i, x in zip(some, made, strict=True):
                        ids[i] = x
        for at in range(0, len(apart), PIECES):
            some = apart[at : at + PIECES]
            for i, x in zip(some, self._one_by_one([spans[i].decode() for i in some]), strict=True):
                ids[i] = x
        return ids

    def _joined(self, spans: list[bytes], between: bytes) -> list[bytes] | None:
        """None if a token crosses a border."""
        ids = np.array(self.tokenizer.encode_batch_fast([between.join(spans).decode()], add_special_tokens=False)[0].ids, np.uint32)
        sizes = np.fromiter(map(len, spans), np.int64, len(spans))
        ends = np.cumsum(sizes + len(between)) - len(between)
        at = np.append(0, np.cumsum(self.lengths[ids]))
        first, last = np.searchsorted(at, ends - sizes), np.searchsorted(at, ends)
        if at[-1] != ends[-1] or not (np.array_equal(at[first], ends - sizes) and np.array_equal(at[last], ends)):
            return None
        raw = ids.tobytes()
        return [raw[a:z] for a, z in zip((4 * first).tolist(), (4 * last).tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        import pyarrow as pa

        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, texts) -> list[bytes]:
        """Little-endian uint32 ids of each text of an Arrow array of strings; null texts are empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_pattern:
            return self.encoder.encode([t or "" for t in texts.to_pylist()])
        holds = np.zeros(len(texts), bool)
        for token in self.added:
            holds |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        plain = iter(self.spans.encode(texts.filter(pa.array(~holds))).to_numpy(zero_copy_only=False).tolist())
        held = iter(self.encoder.encode(texts.filter(pa.array(holds)).to_pylist()))
        return [next(held if h else plain) for h in holds.tolist()]


def _is_space(span: bytes, at: int) -> bool:
    """Is the first or last character (0 or -1) white space, or a control character that some count as such?"""
    return span[at] < 33 or span[at] > 127 and span.decode()[at].isspace()


def _byte_alphabet() -> set[str]:
    """The 256 characters that stand for bytes in byte-level vocabularies: printable Latin-1, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b) for b in plain} | {chr(256 + i) for i in range(256 - len(plain))}


def _mapped(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``df.mapInArrow``. Straight over another result of this, both run in one Python process: Spark would take two for each task,
    and as they change parts from task to task, both would come to hold the tokenizer and its caches."""
    source, before = vars(df).get("_mapped_from", (df, None))
    whole = run if before is None else lambda batches: run(before(batches))
    out = source.mapInArrow(whole, schema)
    out._mapped_from = source, whole
    return out


def in_order(df: DataFrame, shards: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` in ranges of the key, sorted within; the ranges come from a sample of the keys. Rows with one key stay together."""
    n = shards or 1 + (df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // SHARD_BYTES
    return df.repartitionByRange(n, key).sortWithinPartitions(key)


def encode(df: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", width: int = 2, special_as_text: bool = False) -> DataFrame:
    """key and ``ids binary``: little-endian ids of ``width`` bytes each, the end id last. Keeps the order of rows.

    With ``special_as_text`` the strings of special tokens are ordinary text; without, the library's own way is kept."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokenizer = JsonTokenizer.get(tokenizer_path, special_as_text)
        kind, end = KINDS[width], np.array([end_id], np.uint32).tobytes()
        if max(tokenizer.size, end_id + 1) > 1 << 8 * width:
            raise ValueError(f"ids of this vocabulary need more than {width} bytes")
        for batch in batches:
            for part in parts(batch, text):
                ids = tokenizer.encode_column(part.column(text))
                packed = pa.array([np.frombuffer(b + end, np.uint32).astype(kind).tobytes() for b in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(key), packed], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return _mapped(df.select(key, text), run, f"`{key}` {kind}, ids binary")


class _Shard:
    """Writes one shard: equal-length sequences as they fill, and where each document begins."""

    def __init__(self, fs, stem: str, length: int, kind: type):
        import pyarrow as pa

        self.pa, self.length, self.kind = pa, length, kind
        self.item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(self.item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("n_tokens", pa.int64())])
        self.sink = fs.open_output_stream(f"{stem}.arrow")
        self.docs_sink = fs.open_output_stream(f"{stem}.docs.arrow")
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.docs_writer = pa.ipc.new_file(self.docs_sink, self.docs_schema)
        self.parts: list[np.ndarray] = []
        self.waiting = self.total = 0

    def add(self, doc_ids, rows: list[np.ndarray]) -> None:
        counts = np.array([len(r) for r in rows], np.int64)
        begins = self.total + np.cumsum(counts) - counts
        self.docs_writer.write_batch(self.pa.RecordBatch.from_arrays([doc_ids.cast(self.pa.int64()), self.pa.array(begins), self.pa.array(counts)], schema=self.docs_schema))
        self.total += int(counts.sum())
        self.parts += rows
        self.waiting += int(counts.sum())
        step = SEQUENCES * self.length
        if self.waiting >= step:
            self._write(self.waiting // step * step)

    def _write(self, n: int, pad: int = 0) -> None:
        flat = np.concatenate(self.parts)
        self.parts, self.waiting = [flat[n:]], len(flat) - n
        full, mask = np.concatenate([flat[:n], np.zeros(pad, self.kind)]), np.ones(n + pad, bool)
        mask[n:] = False
        step = SEQUENCES * self.length
        for at in range(0, len(full), step):
            lists = [self.pa.FixedSizeListArray.from_arrays(self.pa.array(x[at : at + step]), self.length) for x in (full, mask)]
            self.writer.write_batch(self.pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            self._write(self.waiting, -self.waiting % self.length)
        for x in (self.writer, self.docs_writer, self.sink, self.docs_sink):
            x.close()


def write(encoded: DataFrame, folder: str, length: int = 1024, key: str = "doc_id", width: int = 2) -> DataFrame:
    """Write a shard for each partition of :func:`encode`'s output over :func:`in_order`, at once.

    Returns a row for each shard: its name, least key and number of ids. These few rows pass the driver; ids never do.
    """
    spark, kind = encoded.sparkSession, KINDS[width]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        part = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        there, base = filesystem(folder)
        there.create_dir(base)
        shard = least = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.frombuffer(b, kind) for b in batch.column("ids").to_pylist()]
            if shard is None:
                shard, least = _Shard(there, f"{base}/{part}", length, kind), batch.column(key)[0].as_py()
            shard.add(batch.column(key), rows)
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pydict({"shard": [part], "least": [least], "n_tokens": [shard.total]}, schema=pa.schema([("shard", pa.string()), ("least", pa.int64()), ("n_tokens", pa.int64())]))

    rows = _mapped(encoded, run, "shard string, least bigint, n_tokens bigint").collect()
    return spark.createDataFrame(rows, "shard string, least bigint, n_tokens bigint")


def read(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary) of every document, from the files."""
    starts = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(W.orderBy("least", "shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, base = filesystem(folder)
        for batch in batches:
            for shard, begin in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with _open(fs, f"{base}/{shard}.arrow") as data, _open(fs, f"{base}/{shard}.docs.arrow") as index:
                    tokens, docs = ShardReader(data), pa.ipc.open_file(index)
                    for i in range(docs.num_record_batches):
                        d = docs.get_batch(i)
                        at, n = d.column("begin").to_numpy(), d.column("n_tokens").to_numpy()
                        for lo in range(0, len(at), ROWS):
                            hi = min(lo + ROWS, len(at))
                            ids = pa.array([tokens.slice(int(a), int(a + k)).tobytes() for a, k in zip(at[lo:hi], n[lo:hi], strict=True)], pa.binary())
                            yield pa.RecordBatch.from_arrays([d.column("doc_id")[lo:hi], pa.array(at[lo:hi] + begin), d.column("n_tokens")[lo:hi], ids], names=["doc_id", "start", "n_tokens", "ids"])

    n = max(1, shards.count())
    return _mapped(starts.repartition(n, "shard"), run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _open(fs, path: str):
    """Memory-mapped where the file is local, so that slices are views of it."""
    import pyarrow as pa
    from pyarrow import fs as pafs

    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


class ShardReader:
    """Random access to the ids of one shard; sequences are views of the mapped file."""

    def __init__(self, source):
        import pyarrow as pa

        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.known: dict[int, np.ndarray] = {}

    def _batch(self, i: int) -> np.ndarray:
        if i not in self.known:
            self.known = {i: self.file.get_batch(i).column("ids").values.to_numpy()}
        return self.known[i]

    def sequence(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask of sequence j of a shard whose batches before the last hold SEQUENCES each."""
        batch = self.file.get_batch(j // SEQUENCES)
        at = j % SEQUENCES * self.length
        return batch.column("ids").values.to_numpy()[at : at + self.length], batch.column("mask").values.to_numpy(zero_copy_only=False)[at : at + self.length]

    def slice(self, a: int, b: int) -> np.ndarray:
        """ids a to b of the shard, over sequence and batch borders."""
        step, parts = SEQUENCES * self.length, []
        while a < b:
            i, at = divmod(a, step)
            parts.append(self._batch(i)[at : at + b - a])
            a += len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def checksums(read_back: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 over the ids as little-endian uint32."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = KINDS[width]
        for batch in batches:
            crcs = [zlib.crc32(np.frombuffer(b, kind).astype("<u4").tobytes()) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _mapped(read_back, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
