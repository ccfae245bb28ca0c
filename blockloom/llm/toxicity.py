"""Toxicity by two interpolated Kneser-Ney models over runs of ORDER bytes, one of toxic and one of ordinary texts.

Runs of more than SHARED bytes have counts of their own class (continuation counts below ORDER), with absolute discounts. What
these leave goes on to shorter runs and at last to those of SHARED bytes, whose continuation counts both classes share, so an
expression that is rare in one class falls back on the same estimate in both. The difference of the two log-likelihoods is
divided by the length: of the whole text, and of its WINDOWS-byte windows at their highest. A logistic function of these makes
the score.

Every run of the counted rows is in the model, however rare, so the model grows with the input. Runs are counted by a shuffle and
then dealt into blocks by the two bytes before their last one: a run's contexts and the shorter runs that end like it hold the
same two bytes, so one task makes all levels of a block and writes them as a file of the shared folder. Scoring looks up the
distinct runs of a batch of texts block by block. Of one pair of bytes all runs lie in one block; these are distinct runs, which
copies don't multiply. The logistic weights are fitted on at most about CALIBRATION rows, few enough to be broadcast, by a model
that leaves these out; the model that scores counts all labelled training rows.

Null and empty texts get the score of a text without evidence. Repeated rows get equal scores; rows without a label aren't
learned from. Letters are compared in lower case, ASCII punctuation and white space as one space each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import bloom
from blockloom.llm.hashing import text_buffer
from blockloom.llm.storage import filesystem, new_folder, process_cache, written

ORDER = 6
SHARED = 2
WINDOWS = (16, 48)
CALIBRATION = 20_000
DISCOUNT = 0.75
BLOCK = 1 << 17
BATCH = 1 << 20
BLOCK_ROWS = 1 << 18
CACHED = 128 << 20
SPACE = 32


def _folds() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[:128] = SPACE
    for lo, hi in ((48, 58), (97, 123)):
        table[lo:hi] = np.arange(lo, hi)
    table[65:91] = np.arange(97, 123)
    return table


def runs(b: np.ndarray, n: int = ORDER) -> np.ndarray:
    """The n bytes that end at each byte from the n-th on, as one integer."""
    out = np.zeros(max(len(b) - n + 1, 0), np.int64)
    for j in range(n):
        out <<= 8
        out |= b[j : j + len(out)]
    return out


def texts(column) -> Iterator[np.ndarray]:
    """Folded bytes of each text, between two spaces."""
    data, offsets = text_buffer(column)
    folds = _folds()
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        b = np.full(z - a + 2, SPACE, np.uint8)
        b[1:-1] = folds[data[a:z]]
        yield b


def counts(labelled: DataFrame, text: str = "text") -> DataFrame:
    """run, toxic, ordinary: how often each run of ORDER bytes occurs in either class."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        waiting: tuple[list, list] = ([], [])
        size = 0

        def flush():
            for toxic, parts in enumerate(waiting):
                if parts:
                    unique, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(n * toxic), pa.array(n * (1 - toxic))], names=["run", "toxic", "ordinary"])

        for batch in batches:
            for toxic, b in zip(batch.column("toxic").to_pylist(), texts(batch.column(text)), strict=True):
                for at in range(0, len(b), BLOCK):
                    waiting[toxic].append(runs(b[at : at + BLOCK + ORDER - 1]))
                    size += len(waiting[toxic][-1])
                    if size > 4 << 20:
                        yield from flush()
                        waiting, size = ([], []), 0
        yield from flush()

    rows = labelled.select(text, "toxic").mapInArrow(run, "run bigint, toxic bigint, ordinary bigint")
    return rows.groupBy("run").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _level(keys: np.ndarray, count: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of each key's last byte after the others; the contexts, and the share that each leaves to shorter runs."""
    contexts, at = np.unique(keys >> 8, return_inverse=True)
    total, kinds = np.bincount(at, count, len(contexts)), np.bincount(at, count > 0, len(contexts))
    left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    own = np.where(total[at] > 0, np.maximum(count - DISCOUNT, 0) / np.maximum(total[at], 1), 0)
    return own + left[at] * below, contexts, left


def _mask(n: int) -> int:
    return (1 << 8 * n) - 1


def _named(n: int, contexts: bool) -> int:
    """The top bits that tell the keys of each table apart."""
    return (2 * n + contexts) << 48


def _mid(x: np.ndarray) -> np.ndarray:
    """The two bytes before the last one of each run."""
    return (x >> 8) & 0xFFFF


class Model:
    """Log-likelihood ratios of the known runs of SHARED + 1 to ORDER bytes, and of what their contexts leave to shorter runs.

    They lie in files of a shared folder, one for each block of :func:`_mid` values: the sorted keys and then their values. Files
    are mapped where the folder is local; a process holds at most CACHED bytes of them.
    """

    def __init__(self, folder: str, blocks: np.ndarray, files: dict[int, tuple[str, int]]):
        self.folder, self.blocks, self.files = folder, blocks, files

    def _block(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        held = process_cache().setdefault("toxicity blocks", {})
        name, n = self.files[number]
        name = f"{self.folder}/{name}"
        found = held.pop(name, None)
        if found is None:
            fs, path = filesystem(name)
            data = _contents(fs, path)
            if len(data) != 12 * n:
                raise OSError(f"{name}: {len(data)} bytes of {12 * n}")
            found = np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float32, n, 8 * n)
            room = CACHED - 12 * n
            while held and sum(12 * len(h) for h, _ in held.values()) > room:
                del held[next(iter(held))]
        held[name] = found
        return found

    def values(self, x: np.ndarray) -> np.ndarray:
        """log P(toxic) - log P(ordinary) of the last byte of each run."""
        known, back = np.unique(x, return_inverse=True)
        block = self.blocks[_mid(known)]
        order = np.argsort(block, kind="stable")
        numbers, begins = np.unique(block[order], return_index=True)
        value = np.zeros(len(known), np.float32)
        for number, a, z in zip(numbers.tolist(), begins.tolist(), [*begins.tolist(), len(known)][1:], strict=True):
            if number in self.files:
                value[order[a:z]] = _ratios(*self._block(number), known[order[a:z]])
        return value[back]

    def ratios(self, b: np.ndarray) -> np.ndarray:
        """log P(toxic) - log P(ordinary) of each byte from the ORDER-th on."""
        return np.concatenate([np.empty(0, np.float32), *(self.values(runs(b[at : at + BATCH + ORDER - 1])) for at in range(0, len(b) - ORDER + 1, BATCH))])


def _ratios(keys: np.ndarray, ratio: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Ratios of runs by the sorted keys of their block: of the longest known run, and what the contexts of longer ones leave."""

    def find(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        return np.where(hit, ratio[at], 0), hit

    value, open_ = np.zeros(len(x), np.float32), np.arange(len(x))
    for n in range(ORDER, SHARED, -1):
        here = x[open_] & _mask(n)
        found, hit = find(here | _named(n, False))
        value[open_] += found
        open_, here = open_[~hit], here[~hit]
        if not len(open_):
            break
        value[open_] += find((here >> 8) | _named(n, True))[0]
    return value


def _contents(fs, path: str):
    import pyarrow as pa
    from pyarrow import fs as pafs

    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(path) as source:
            return source.read_buffer()
    with fs.open_input_file(path) as source:
        return source.read_buffer()


def _shared(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of all runs: the estimate of each run of SHARED bytes (at most 2^16), and the number of runs with each :func:`_mid`."""
    key = F.col("run").bitwiseAND(F.lit(_mask(SHARED + 1)))
    longer = table.where("toxic + ordinary > 0").groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    rows = longer.groupBy(F.col("key").bitwiseAND(F.lit(_mask(SHARED))).alias("key")).agg(F.count("*").alias("both")).toArrow()
    mids = longer.groupBy(F.shiftright("key", 8).alias("mid")).agg(F.sum("n").alias("n")).toArrow()
    share = np.full(1, 1 / 256)
    count = np.zeros(1 << 16)
    count[rows.column("key").to_numpy()] = rows.column("both").to_numpy()
    for n in range(1, SHARED + 1):
        keys = np.arange(1 << 8 * n)
        kinds = (count > 0).reshape(-1, 1 << 8 * n).sum(axis=0) if n < SHARED else count
        share = _level(keys, kinds.astype(np.float64), share[keys & _mask(n - 1)])[0]
    sizes = np.zeros(1 << 16, np.int64)
    sizes[mids.column("mid").to_numpy()] = mids.column("n").to_numpy()
    return share, sizes


def _dealt(sizes: np.ndarray) -> np.ndarray:
    """A block for each :func:`_mid` value, of about BLOCK_ROWS runs or of one value."""
    return (np.cumsum(sizes) - sizes) // BLOCK_ROWS


def _levels(runs_: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and values of all levels of one block."""
    levels = [(runs_, toxic.astype(np.float64), ordinary.astype(np.float64))]
    for n in range(ORDER - 1, SHARED, -1):
        longer, t, o = levels[-1]
        keys, at = np.unique(longer & _mask(n), return_inverse=True)
        levels.append((keys, np.bincount(at, t > 0, len(keys)), np.bincount(at, o > 0, len(keys))))
    keys_, values = [], []
    shorter, below = np.arange(1 << 8 * SHARED), (shared, shared)
    for n, (keys, *counted) in enumerate(reversed(levels), SHARED + 1):
        at = np.searchsorted(shorter, keys & _mask(n - 1))
        (pt, contexts, lt), (po, _, lo) = (_level(keys, c, b[at]) for c, b in zip(counted, below, strict=True))
        keys_ += [keys | _named(n, False), contexts | _named(n, True)]
        values += [np.log(pt / po), np.log(lt / lo)]
        shorter, below = keys, (pt, po)
    keys, found = np.concatenate(keys_), np.concatenate(values).astype(np.float32)
    order = np.argsort(keys)
    return keys[order], found[order]


def fit(table: DataFrame) -> Model:
    """The model of all rows of :func:`counts`. The driver holds a number for each pair of bytes, and a row for each block."""
    spark = table.sparkSession
    shared, sizes = _shared(table)
    blocks, folder = _dealt(sizes), new_folder(spark, "toxicity")
    share = spark.sparkContext.broadcast((shared, blocks))

    def number(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            of = share.value[1][_mid(batch.column("run").to_numpy())]
            yield pa.RecordBatch.from_arrays([pa.array(of), *(batch.column(c) for c in ("run", "toxic", "ordinary"))], names=["block", "run", "toxic", "ordinary"])

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        fs, path = filesystem(folder)
        fs.create_dir(path)
        here, parts = None, []

        def flush():
            keys, values = _levels(*(np.concatenate(c) for c in zip(*parts, strict=True)), share.value[0])
            name = f"{here:06d}-{attempt}"
            with fs.open_output_stream(f"{path}/{name}") as sink:
                sink.write(keys.tobytes())
                sink.write(values.tobytes())
            return pa.RecordBatch.from_pydict({"block": [here], "name": [name], "n": [len(keys)], "runs": [sum(len(p[0]) for p in parts)]})

        for batch in batches:
            of, *columns = (batch.column(c).to_numpy() for c in ("block", "run", "toxic", "ordinary"))
            begins = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
            for a, z in zip(begins, [*begins, len(of)][1:], strict=True):
                if here is not None and of[a] != here:
                    yield flush()
                    parts = []
                here = int(of[a])
                parts.append([c[a:z] for c in columns])
        if parts:
            yield flush()

    rows = table.where("toxic + ordinary > 0").select("run", "toxic", "ordinary").mapInArrow(number, "block bigint, run bigint, toxic bigint, ordinary bigint")
    dealt = rows.repartition(int(blocks[-1]) + 1, "block").sortWithinPartitions("block")
    files = dealt.mapInArrow(write, "block bigint, name string, n bigint, runs bigint").collect()
    if sum(r["runs"] for r in files) != sizes.sum():
        raise OSError(f"{folder}: {sum(r['runs'] for r in files)} runs of {sizes.sum()}")
    return Model(folder, blocks, {r["block"]: (r["name"], r["n"]) for r in files})


def _evidence(r: np.ndarray) -> list[float]:
    if not len(r):
        return [0.0] * (len(WINDOWS) + 1)
    sums = np.zeros(len(r) + 1)
    np.cumsum(r, out=sums[1:])
    return [sums[-1] / len(r), *((sums[w:] - sums[:-w]).max() / w if len(r) >= w else sums[-1] / w for w in WINDOWS)]


def evidence(model: Model, bodies: Iterator[np.ndarray]) -> Iterator[list[float]]:
    """Ratios of each text divided by length: of the whole text, and of its best window of each size. Short texts are looked up
    together."""

    def flush(waiting: list) -> Iterator[list[float]]:
        values, ends = model.values(np.concatenate(waiting)), np.cumsum([len(x) for x in waiting])
        return map(_evidence, np.split(values, ends[:-1]))

    waiting, size = [], 0
    for b in bodies:
        if waiting and size + len(b) > BATCH:
            yield from flush(waiting)
            waiting, size = [], 0
        if len(b) > BATCH:
            yield _evidence(model.ratios(b))
        else:
            waiting.append(runs(b))
            size += len(b)
    if waiting:
        yield from flush(waiting)


def _fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method on standardised columns; returns weights of the plain columns, the intercept last."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(z) + ridge * np.eye(len(w)), z.T @ (p - y) / len(z) + ridge * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    plain = w[:-1] / sd
    return np.append(plain, w[-1] - plain @ mean)


def _evidence_rows(labelled: DataFrame, model: Model, text: str) -> tuple[np.ndarray, np.ndarray]:
    share = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = list(evidence(share.value, texts(batch.column(text))))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = labelled.select(text, "toxic").mapInArrow(run, "toxic int, x array<double>").toArrow()
    return np.array(rows.column("x").to_pylist()).reshape(-1, len(WINDOWS) + 1), rows.column("toxic").to_numpy().astype(float)


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """The labelled documents. A Bloom filter of the labelled keys leaves the other texts where they are; the join is by sorting
    at every size, so that it needs no table in memory."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build(labels.select(F.xxhash64(key).alias("id"))))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(bloom.member(bits.value, batch.column("__id").to_numpy())))

    rows = docs.select(key, text, F.xxhash64(key).alias("__id"))
    return rows.mapInArrow(run, rows.schema).drop("__id").join(labels.select(key, "toxic").hint("merge"), key)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[Model, np.ndarray]:
    """Model and logistic weights from ``labels(key, toxic)`` with toxic 0 or 1.

    A quarter of them by a hash of the key, about CALIBRATION at most, calibrates: the weights are fitted on these rows' evidence
    from a model of the other rows. The model that is returned counts all of them."""
    labels = labels.where("toxic in (0, 1)")
    drawn = F.pmod(F.xxhash64(key), F.lit(1 << 20))
    n = labels.where(drawn < (1 << 18)).count()
    share = (1 << 18) if n <= CALIBRATION else (CALIBRATION << 18) // n
    held = labels.where(drawn < share)
    others = written(counts(_labelled(docs, labels.where(drawn >= share), key, text), text), "runs")
    x, y = _evidence_rows(docs.select(key, text).join(F.broadcast(held.select(key, "toxic")), key), fit(others), text)
    both = others.unionByName(counts(_labelled(docs, held, key, text), text))
    model = fit(written(both.groupBy("run").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "runs"))
    return model, _fit_logistic(x, y) if len(x) else np.zeros(len(WINDOWS) + 2)


def scored(docs: DataFrame, fitted: tuple[Model, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score: the probability that the text is toxic."""
    share = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model, w = share.value
        for batch in batches:
            x = np.array(list(evidence(model, texts(batch.column(text))))).reshape(-1, len(WINDOWS) + 1)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(p)], names=[key, "score"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")
