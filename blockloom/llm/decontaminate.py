"""Benchmark decontamination by greedy string tiling over word tokens (running Karp-Rabin matching).

Runs of ``least`` words that a document shares with a benchmark item are its seeds; documents and items are joined by them. Where
the seeds can cover enough of an item, tiles are laid: the longest match of words not yet in a tile goes first (of equal ones the
first in the item, then in the text). Runs of one length are compared by rolling hashes, and the length is found by bisection, as
every part of a match is a match. The share of the item's words that lie in tiles is its coverage; since tiles may come in any
order, reordered passages count as well. An item of fewer words is searched as one run.

Words are compared with A-Z in lower case. Null and empty texts match nothing and are never removed. Repeated rows and items
are treated each on its own; ids of either side may be null and of any type. The benchmark is taken in blocks of about
BLOCK_BYTES, each of which is broadcast and compared in a scan of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from blockloom.llm.hashing import _STEP, Hasher, powers, sequences
from blockloom.llm.storage import frugal

BLOCK_BYTES = 16 << 20


class Rolling:
    """Hashes of all runs of any length of one sequence, and which of its words are free."""

    def __init__(self, words: np.ndarray, free: np.ndarray):
        self.words, self.free = words, free
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(_STEP, len(words)), out=self.sums[1:])
        self.inverse = powers(pow(_STEP, -1, 1 << 64), len(words) + 1)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the runs of n free words."""
        if n > len(self.words):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[n:] == taken[:-n])
        return at, (self.sums[at + n] - self.sums[at]) * self.inverse[at]


def _shared(item: Rolling, text: Rolling, n: int) -> bool:
    return bool(np.isin(item.runs(n)[1], text.runs(n)[1]).any())


def _longest(item: Rolling, text: Rolling, least: int, most: int) -> int:
    """Length of the longest free run of both, from ``least`` to ``most``; 0 if there is none."""
    if most < least or not _shared(item, text, least):
        return 0
    while least < most:
        middle = (least + most + 1) // 2
        least, most = (middle, most) if _shared(item, text, middle) else (least, middle - 1)
    return least


def tiles(item: np.ndarray, text: np.ndarray, least: int, free: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(place in item, place in text, length) of the tiles, longest first. Only ``free`` words of the text can match."""
    a = Rolling(np.asarray(item, np.uint64), np.ones(len(item), bool))
    b = Rolling(np.asarray(text, np.uint64), np.ones(len(text), bool) if free is None else free.copy())
    laid: list[tuple[int, int, int]] = []
    n = min(len(item), len(text))
    while n := _longest(a, b, least, n):
        places, hashes = a.runs(n)
        there, theirs = b.runs(n)
        order = np.argsort(theirs, kind="stable")
        there, theirs = there[order], theirs[order]
        begins, ends = np.searchsorted(theirs, hashes, "left"), np.searchsorted(theirs, hashes, "right")
        reached: dict[int, int] = {}
        for i, lo, hi in zip(places.tolist(), begins.tolist(), ends.tolist(), strict=True):
            if lo == hi or not a.free[i : i + n].all():
                continue
            at = reached.get(lo, lo)  # words never become free again, so places passed over stay out
            while at < hi and not b.free[there[at] : there[at] + n].all():
                at += 1
            reached[lo] = at
            if at < hi and np.array_equal(a.words[i : i + n], b.words[there[at] : there[at] + n]):
                j = int(there[at])
                a.free[i : i + n] = b.free[j : j + n] = False
                laid.append((i, j, n))
        n -= 1
    return laid


def _reach(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Which of n words lie in a run of k words that begins at one of the places."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + k, n), -1)
    return np.cumsum(change)[:n] > 0


class Index:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple], least: int):
        hasher = Hasher(lower=True)
        self.ids, self.words, self.lengths = [i for i, _ in items], [], []
        by_length: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for n, (_, text) in enumerate(items):
            h = hasher.long_document(np.frombuffer((text or "").encode(), np.uint8))
            self.words.append(h)
            k = min(least, len(h))
            self.lengths.append(k)
            if k:
                by_length[k].append((sequences(h, k), n))
        self.seeds = {}
        for k, rows in by_length.items():
            seeds = np.concatenate([x for x, _ in rows])
            order = np.argsort(seeds, kind="stable")
            of = np.concatenate([np.full(len(x), n) for x, n in rows])
            at = np.concatenate([np.arange(len(x)) for x, _ in rows])
            self.seeds[k] = seeds[order], of[order], at[order]

    def matches(self, h: np.ndarray, threshold: float, k: int, places: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, matched words, tiles) of a document for the items with seeds of k words; ``places`` are its known runs.

        Work grows with the places and with the seeds they meet, not with their pairs."""
        seeds, items, at = self.seeds[k]
        runs, which = np.unique(sequences(h, k)[places], return_inverse=True)
        lo, hi = np.searchsorted(seeds, runs, "left"), np.searchsorted(seeds, runs, "right")
        met = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
        of, where, run = items[met], at[met], np.repeat(np.arange(len(runs)), hi - lo)
        order = np.argsort(of, kind="stable")
        of, where, run = of[order], where[order], run[order]
        numbers, begins = np.unique(of, return_index=True)
        for n, a, z in zip(numbers.tolist(), begins.tolist(), [*begins.tolist(), len(of)][1:], strict=True):
            item = self.words[n]
            if _reach(len(item), where[a:z], k).sum() < threshold * len(item):
                continue
            own = np.zeros(len(runs), bool)
            own[run[a:z]] = True
            near = np.flatnonzero(_reach(len(h), places[own[which]], k))
            # Words that aren't next to each other in the document get a word between them that matches nothing.
            text = np.insert(h[near], gaps := np.flatnonzero(np.diff(near) > 1) + 1, 0)
            free = np.insert(np.ones(len(near), bool), gaps, False)
            laid = tiles(item, text, k, free)
            matched = sum(x[2] for x in laid)
            if matched and matched >= threshold * len(item):
                yield n, matched, len(laid)

    def documents(self, column, threshold: float) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(row, matches) of the rows of an Arrow column that have any."""
        hasher = self.__dict__.setdefault("_hasher", Hasher(lower=True))
        for lo, _, h, at in hasher.documents(column):
            places = {}
            for k, (seeds, _, _) in self.seeds.items():
                runs = sequences(h, k)
                i = np.minimum(np.searchsorted(seeds, runs), len(seeds) - 1)
                places[k] = np.flatnonzero(seeds[i] == runs)
            rows = {int(r) for k, p in places.items() for r in np.unique(np.searchsorted(at, p, "right") - 1)}
            for row in sorted(rows):
                s, e = int(at[row]), int(at[row + 1])
                own = [(k, p[(p >= s) & (p + k <= e)] - s) for k, p in places.items()]
                if found := [x for k, p in own if len(p) for x in self.matches(h[s:e], threshold, k, p)]:
                    yield lo + row, sorted(found)


def _blocks(benchmark: DataFrame, least: int, item_id: str, text: str) -> Iterator:
    """Broadcast indexes of the benchmark, block by block."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for block in range(n):
        part = benchmark.where(F.pmod(F.xxhash64(item_id, text), F.lit(n)) == block).select(item_id, text).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in part], least))


def contaminations(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, key: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, matched_words, n_tiles, coverage: the pairs whose coverage reaches the threshold."""
    kinds = dict(docs.dtypes)[key], dict(benchmark.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, matched_words bigint, n_tiles bigint, coverage double"
    item_type = to_arrow_type(benchmark.schema[item_id].dataType)

    def of(index) -> DataFrame:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            known = index.value
            for batch in batches:
                rows = [(i, known.ids[n], m, t, m / len(known.words[n])) for i, found in known.documents(batch.column(text), threshold) for n, m, t in found]
                ids = batch.column(key).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[c] for r in rows], t) for c, t in ((1, item_type), (2, pa.int64()), (3, pa.int64()), (4, pa.float64())))], names=["doc_id", "item_id", "matched_words", "n_tiles", "coverage"])

        return docs.select(key, text).mapInArrow(frugal(run), schema)

    out = None
    for index in _blocks(benchmark, least, item_id, text):
        out = of(index) if out is None else out.unionByName(of(index))
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without the rows that reach the threshold with any item; no shuffle."""
    for index in _blocks(benchmark, least, "item_id", "text"):

        def run(batches: Iterator, index=index) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[i for i, _ in index.value.documents(batch.column(text), threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(frugal(run), docs.schema)
    return docs
