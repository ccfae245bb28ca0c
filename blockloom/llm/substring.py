"""Repeated word windows by a sparse de Bruijn graph over minimizer-sampled k-mers.

Of the k-mers (k words) of a document those are sampled that are the leftmost least-hashed of some run of WINDOW - k + 1 k-mers.
Hence each window of WINDOW words holds a sampled k-mer, and equal windows hold the same ones between the first and last that
lie in them alone. Sampled k-mers are nodes; from one to the next in a document runs an edge, hashed over all its words.

1. nodes that occur once go;
2. where every occurrence of a node goes on by one edge and every occurrence of that edge's end comes by it, a Spark join of the
   nodes links the two: repeated nonbranching paths. All occurrences of such a path are whole, so it repeats as a whole;
3. in source coordinates, linked occurrences form long spans: every window inside a span is repeated. Windows with a repeated
   node that reach over a span's end are counted by 64-bit hashes with partial aggregates; those whose hash repeats are few, and
   these are compared by 128 bits and joined back, hot windows by broadcast (see :mod:`skew`).

Windows without a repeated node can't be repeated. Nothing is capped.

Null and empty texts have no words; texts shorter than the window lose none. Repeated rows are separate documents, so all their
windows repeat. Null ids are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import bloom
from blockloom.llm.hashing import _STEP, Hasher, mix, powers, sequences
from blockloom.llm.skew import lookup_join
from blockloom.llm.storage import checkpointed, written

KMER = 8
SECOND = np.uint64(0x5851F42D4C957F2D)


def sampled(h: np.ndarray, window: int, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the sampled k-mers of one document."""
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    x = sequences(h, kmer)
    run = window - kmer + 1
    step, found = 1 << 16, []
    for at in range(0, len(x) - run + 1, step):
        views = np.lib.stride_tricks.sliding_window_view(x[at : at + step + run - 1], run)
        least = views.argmin(axis=1)
        least += np.arange(at, at + len(least))
        found.append(least[np.flatnonzero(np.diff(least, prepend=-1))])
    at = np.unique(np.concatenate(found))
    return at, x[at]


def edges(h: np.ndarray, at: np.ndarray, kmer: int = KMER) -> np.ndarray:
    """Hashes of the words from each sampled k-mer to the end of the next."""
    if len(at) < 2:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_STEP, len(h)), out=sums[1:])
    inverse = powers(pow(_STEP, -1, 1 << 64), len(h))[at[:-1]]
    return mix((sums[at[1:] + kmer] - sums[at[:-1]]) * inverse + (at[1:] - at[:-1]).astype(np.uint64)) | np.uint64(1)


def _nodes(rows: DataFrame, window: int) -> DataFrame:
    """node, following (edge out, 0 at a document's end) and preceding (edge in, 0 at its start) of each occurrence."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher = Hasher(lower=False)
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            size = 0
            for _, _, h, at in hasher.documents(batch.column(0)):
                for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    where, nodes = sampled(h[s:e], window)
                    if len(where):
                        between = edges(h[s:e], where)
                        for x, part in zip(out, (nodes, np.append(between, np.uint64(0)), np.insert(between, 0, 0)), strict=True):
                            x.append(part)
                        size += len(nodes)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in out], names=["node", "following", "preceding"])
                    out, size = [[], [], []], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in out], names=["node", "following", "preceding"])

    return rows.select("text").mapInArrow(run, "node bigint, following bigint, preceding bigint")


def _occurrences(rows: DataFrame, nodes: DataFrame, window: int) -> DataFrame:
    """doc_id, row, pos and node of the occurrences of ``nodes`` (and of few others)."""
    bits = rows.sparkSession.sparkContext.broadcast(bloom.build(nodes))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher = Hasher(lower=False)
        for batch in batches:
            at_rows, at_words, at_nodes = [], [], []
            for lo, _, h, at in hasher.documents(batch.column("text")):
                for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True), lo):
                    where, found = sampled(h[s:e], window)
                    found = found.view(np.int64)
                    if len(where) and (known := bloom.member(bits.value, found)).any():
                        at_words.append(where[known])
                        at_nodes.append(found[known])
                        at_rows.append(np.full(len(at_nodes[-1]), i))
            if at_rows:
                of = pa.array(np.concatenate(at_rows))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("row").take(of), pa.array(np.concatenate(at_words).astype(np.int32)), pa.array(np.concatenate(at_nodes))], names=["doc_id", "row", "pos", "node"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "row", "text").mapInArrow(run, f"doc_id {kind}, row bigint, pos int, node bigint")


def _spans(marks: np.ndarray, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last word of each compacted path occurrence; a mark is 2 * position + (1 if linked to the next)."""
    pos, linked = marks >> 1, marks & 1
    ends = np.flatnonzero(linked == 0)
    if not len(ends) or ends[-1] != len(marks) - 1:
        ends = np.append(ends, len(marks) - 1)
    begins = np.insert(ends[:-1] + 1, 0, 0)
    return pos[begins], pos[ends] + kmer


def _covered(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each of n places lies in any of the ranges."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change)[:n] > 0


def _array(column, i: int) -> np.ndarray:
    value = column[i].values if column[i].is_valid else None
    return np.empty(0, np.int64) if value is None else value.to_numpy(zero_copy_only=False).astype(np.int64)


def _open_windows(marked: DataFrame, window: int, repeated=None) -> DataFrame:
    """hash of the windows with a repeated node that no span holds. With a filter of ``repeated`` hashes only the windows that pass,
    with doc_id, row, start and a second hash."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher = Hasher(lower=False)
        known = None if repeated is None else repeated.value

        def made(batch, of: list, starts: list, first: list, second: list):
            hashes = pa.array(np.concatenate(first))
            if known is None:
                return pa.RecordBatch.from_arrays([hashes], names=["hash"])
            at = pa.array(np.concatenate(of))
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(np.concatenate(starts)), hashes, pa.array(np.concatenate(second))], names=["doc_id", "row", "start", "hash", "second"])

        for batch in batches:
            column = batch.column("marks")
            out: tuple[list, ...] = ([], [], [], [])
            size = 0
            for lo, _, h, at in hasher.documents(batch.column("text")):
                for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True), lo):
                    marks, n = _array(column, i), e - s - window + 1
                    if n <= 0 or not len(marks):
                        continue
                    pos = marks >> 1
                    near = _covered(n, np.maximum(pos - window + KMER, 0), np.minimum(pos + 1, n))
                    begins, ends = _spans(marks)
                    long = ends - begins >= window
                    near &= ~_covered(n, begins[long], ends[long] - window + 1)
                    starts = np.flatnonzero(near)
                    first = sequences(h[s:e], window)[starts].view(np.int64) if len(starts) else starts
                    second = first
                    if known is not None and len(starts):
                        hit = bloom.member(known, first)
                        starts, first = starts[hit], first[hit]
                        second = sequences(mix(h[s:e] ^ SECOND), window)[starts].view(np.int64) if len(starts) else starts
                    if len(starts):
                        for x, part in zip(out, (np.full(len(starts), i), starts, first, second), strict=True):
                            x.append(part)
                        size += len(starts)
                if size > 200_000:
                    yield made(batch, *out)
                    out, size = ([], [], [], []), 0
            if size:
                yield made(batch, *out)

    kind = dict(marked.dtypes)["doc_id"]
    schema = "hash bigint" if repeated is None else f"doc_id {kind}, row bigint, start bigint, hash bigint, second bigint"
    return marked.select("doc_id", "row", "text", "marks").mapInArrow(run, schema)


def _removed(batch_rows: DataFrame, window: int, with_text: bool, outside=None) -> DataFrame:
    """Results of rows with ``marks`` and ``hits``; with a filter ``outside`` of those whose row it doesn't hold."""
    for column, kind in (("marks", "array<int>"), ("hits", "array<bigint>")):
        if column not in batch_rows.columns:
            batch_rows = batch_rows.withColumn(column, F.lit(None).cast(kind))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if outside is not None:
                batch = batch.filter(pa.array(~bloom.member(outside.value, batch.column("row").to_numpy())))
            marks, hits = batch.column("marks"), batch.column("hits")
            total, gone, digests, kept_texts = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                m, s = _array(marks, i), _array(hits, i)
                begins, ends = _spans(m) if len(m) else (m, m)
                long = ends - begins >= window
                if long.any() or len(s):
                    cut = _covered(n, np.concatenate([begins[long], s]), np.concatenate([ends[long], s + window]))
                    kept = b" ".join(compress(words, (~cut).tolist()))
                    gone.append(int(cut.sum()))
                else:
                    kept = b" ".join(words)
                    gone.append(0)
                total.append(n)
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept)
            out = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            if with_text:
                out.append(pa.array([t.decode() for t in kept_texts], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(out)])

    kind = dict(batch_rows.dtypes)["doc_id"]
    return batch_rows.select("doc_id", "row", "text", "marks", "hits").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text)


def remove_repeats(docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and ``kept_text``): without the words of windows that also start elsewhere."""
    if window < 2 * KMER:
        raise ValueError(f"a window needs {2 * KMER} words")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumn("row", F.xxhash64("text"))
    nodes = _nodes(rows, window).groupBy("node").agg(
        F.count("*").alias("n"), F.min("following").alias("f"), F.max("following").alias("f2"), F.min("preceding").alias("p"), F.max("preceding").alias("p2")
    )
    nodes = checkpointed(nodes.where("n > 1").select("node", "n", F.when(F.col("f") == F.col("f2"), F.col("f")).alias("out"), F.when(F.col("p") == F.col("p2"), F.col("p")).alias("into")))
    ways_in = nodes.where("into <> 0").select(F.col("into").alias("out"), F.lit(1).alias("linked"))
    linked = nodes.where("out <> 0").select("node", "out").join(ways_in, "out").select("node", "linked")
    paths = checkpointed(nodes.select("node", "n").join(linked, "node", "left").select("node", "n", F.coalesce("linked", F.lit(0)).alias("linked")))
    marks = lookup_join(_occurrences(rows, nodes.select("node"), window), paths, "node", "n").select("doc_id", "row", (F.col("pos") * 2 + F.col("linked")).alias("mark"))
    marks = checkpointed(marks.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("mark")).alias("marks")))

    held = lambda t: docs.sparkSession.sparkContext.broadcast(bloom.build(t.select("row")))
    near = held(marks)
    keyed = written(_with(rows, marks, "marks", near), "marked")
    repeated = _open_windows(keyed, window).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    passed = docs.sparkSession.sparkContext.broadcast(bloom.build(checkpointed(repeated)))
    windows = written(_open_windows(keyed, window, passed).select("doc_id", "row", "start", F.struct("hash", "second").alias("window")), "windows")
    again = checkpointed(windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1"))
    hits = checkpointed(lookup_join(windows, again, "window", "n").groupBy("doc_id", "row").agg(F.collect_set("start").alias("hits")))
    hit = held(hits)
    whole = _removed(_with(keyed, hits, "hits", hit), window, with_text)
    return whole.unionByName(_removed(keyed, window, with_text, hit)).unionByName(_removed(rows, window, with_text, near))


def _with(rows: DataFrame, table: DataFrame, column: str, near) -> DataFrame:
    """The rows that the filter ``near`` of the table's rows lets through, with a column of ``table``. Other texts stay where they are.

    Both are keyed by id and hash of the text, so a hash need only differ within one id."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(bloom.member(near.value, batch.column("row").to_numpy())))

    r, t = rows.mapInArrow(run, rows.schema).alias("r"), table.alias("t")
    same = (F.col("r.row") == F.col("t.row")) & F.col("r.doc_id").eqNullSafe(F.col("t.doc_id"))
    return r.join(t.hint("merge"), same, "left").select("r.*", f"t.{column}")
