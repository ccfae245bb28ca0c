"""Byte-level BPE by the tiktoken library with a rank file whose path is a parameter.

Nulls count as empty texts and give no ids. Encoding is lossless: decoding the ids gives the UTF-8 bytes of the text.
Repeated rows give repeated results; columns called like the results are replaced by them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from blockloom.llm.pieces import PieceEncoder, list_array
from blockloom.llm.storage import frugal, give_back, process_cache

#: Texts of one Arrow batch are handled so many bytes at a time, or one by one.
PART_BYTES = 4 << 20


def parts(batch, column: str) -> Iterator:
    """Slices of a batch whose values of a string or list column take about PART_BYTES, or of one row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    values = batch.column(column)
    size = pc.binary_length(values) if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else pc.list_value_length(values)
    ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encoder = PieceEncoder(self._encode)

    @classmethod
    def get(cls, ranks_path: str, pattern: str) -> Codec:
        known = process_cache()
        key = ("tiktoken", ranks_path, pattern)
        if key not in known:
            known[key] = cls(ranks_path, pattern)
        return known[key]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        encode = self.encoding.encode_ordinary
        return [np.array(encode(p), np.uint32).tobytes() for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encoder.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The raw bytes; they need not be whole UTF-8 characters."""
        return self.encoding.decode_bytes(ids.tolist())


def _replaced(df: DataFrame, added: dict[str, str]) -> tuple[list[str], str]:
    kept = [c for c in df.columns if c not in added]
    types = dict((f.name, f.dataType.simpleString()) for f in df.schema)
    return kept, ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"`{c}` {t}" for c, t in added.items()])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``token_ids array<int>`` and ``n_tokens long``: ordinary text throughout, no special tokens."""
    kept, schema = _replaced(df, {"token_ids": "array<int>", "n_tokens": "bigint"})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = Codec.get(ranks_path, pattern)
        for batch in batches:
            for part in parts(batch, text):
                ids = codec.encode([t or "" for t in part.column(text).to_pylist()])
                counts = pa.array([len(b) // 4 for b in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), list_array(ids), counts], names=[*kept, "token_ids", "n_tokens"])
                del ids
                give_back()

    return df.mapInArrow(frugal(run, keep_cache=True), schema)


def _ids(column, i: int) -> np.ndarray:
    value = column[i].values
    return np.empty(0, np.int32) if value is None else value.to_numpy(zero_copy_only=False)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded binary``, the bytes of the ids. Null ids give empty bytes."""
    kept, schema = _replaced(df, {"decoded": "binary"})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = Codec.get(ranks_path, pattern)
        for batch in batches:
            for part in parts(batch, ids):
                column = part.column(ids)
                decoded = [codec.decode(_ids(column, i)) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(decoded, pa.binary())], names=[*kept, "decoded"])

    return df.mapInArrow(run, schema)


class _Decimals:
    """Decimal forms of ids with a space before each, by table look-up."""

    def __init__(self):
        self.chars, self.used = np.empty((0, 0), np.uint8), np.empty((0, 0), bool)

    def __call__(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        if (top := int(ids.max())) >= len(self.chars):
            width = len(str(top)) + 1
            table = np.array([f" {i}".ljust(width, "\0").encode() for i in range(top + 1)], f"S{width}")
            self.chars = table.view(np.uint8).reshape(len(table), width)
            self.used = self.chars != 0
        return self.chars[ids][self.used[ids]].tobytes()[1:]


def digests(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """key, n_tokens, ids_sha256 (ids in decimal, joined by a space) and decoded_sha256 (decoded bytes) of an encoded table."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec, decimals = Codec.get(ranks_path, pattern), _Decimals()
        for batch in batches:
            column, counts, left, right = batch.column(ids), [], [], []
            for i in range(batch.num_rows):
                x = _ids(column, i)
                counts.append(len(x))
                left.append(hashlib.sha256(decimals(x)).hexdigest())
                right.append(hashlib.sha256(codec.decode(x)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts, pa.int64()), pa.array(left), pa.array(right)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(df.dtypes)[key]
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
