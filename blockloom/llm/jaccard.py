"""Set-similarity join of texts by word shingles: the grouped prefix join.

The tokens of a document are the hashes of its distinct k-word shingles. All documents order their tokens alike: by the product
of the counts of the shingle's words, which tells how rare it should be, then by hash. Two sets with a Jaccard similarity of at least num/den share a token within their
first n - ceil(n * num / den) + 1 tokens, their prefix. The steps:

1. documents with equal sets fall into one class, classes with equal prefix and size into one group;
2. groups that share a prefix token and pass the size and position filters are candidates; a token of more than SMALL groups
   only pairs each of them with one, its head. Of a pair of groups the first members meet, of each group every member meets the
   first. These pairs are verified, by parity bitmaps and then on the exact sets;
3. the links found give components; group pairs of the larger tokens and all group pairs with more members are expanded, and the
   members that are not yet in one component are verified too.

Step 3 covers every pair that step 2 left, so no component is missed; copies of one text meet only their head, so large groups
cost few pairs. Only counts of frequent words are broadcast, at most MAX_WORDS of them, and the hot keys of joins (see :mod:`skew`).

Null and empty texts have an empty set and are linked with nothing. A text of fewer than k words has one shingle, all of it.
Repeated rows give repeated results; rows with one id count as one document. Rows with a null id get themselves a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.bloom import build, member
from blockloom.llm.components import components
from blockloom.llm.hashing import Hasher, mix, sequences, whole
from blockloom.llm.skew import lookup_join
from blockloom.llm.storage import checkpointed, frugal, written

MAX_WORDS = 1 << 20
LEAST_COUNT = 8
LEAST_PARITY_BITS = 512
#: A token's or a group's rows meet one another in blocks of about so many, each of which a task of its own may take.
BLOCK_ROWS = 256
#: Tokens of up to so many groups are paired at once; larger ones go by their head first. Both ways find the same components.
SMALL = 4


def frequent_words(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the frequent words, at most MAX_WORDS.

    A word that a task meets once in two million words adds nothing; the counts only shape the order of tokens.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher, waiting, size = Hasher(lower=True), [], 0

        def counted():
            words, n = np.unique(np.concatenate(waiting), return_counts=True)
            words, n = words[n > 1], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

        for batch in batches:
            for _, _, h, _ in hasher.documents(batch.column(0)):
                waiting.append(h)
                size += len(h)
                if size > 2_000_000:
                    yield counted()
                    waiting, size = [], 0
        if size:
            yield counted()

    counts = checkpointed(docs.select(text).mapInArrow(frugal(run), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    table = counts.where(F.col("n") >= max(LEAST_COUNT, -(-total // MAX_WORDS))).toArrow()
    words, n = (table.column(c).to_numpy() for c in ("word", "n"))
    words = words.view(np.uint64)
    order = np.argsort(words)
    return words[order], n[order]


def _shingles(h: np.ndarray, at: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, slice]]:
    """Of each document of a block: hashes of its shingles in order, and the words at which they start."""
    all_of_them = sequences(h, k)
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s >= k:
            yield all_of_them[s : e - k + 1], slice(s, e - k + 1)
        elif e > s:
            yield np.array([whole(h[s:e])], np.uint64), slice(s, s + 1)
        else:
            yield np.empty(0, np.uint64), slice(s, s)


def signatures(docs: DataFrame, words: tuple[np.ndarray, np.ndarray], k: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (set size), s1 and s2 (128 bits of the set), g (hash of the prefix), prefix (its rarest tokens in the common order), parity.

    Bit i of ``parity`` tells whether the set has an odd number of tokens whose hash ends in i; sets differ in at least as many
    tokens as these bits differ. There are as many bits as tokens, rounded up to a power of two.
    """
    known = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher = Hasher(lower=True)
        frequent, counts = known.value
        weights = np.log2(counts)
        unknown = weights.min() - 1 if len(weights) else 0.0
        for batch in batches:
            sizes, first, second, prefixes, parities, alike = [], [], [], [], [], []
            for _, _, h, at in hasher.documents(batch.column(text)):
                weight = np.full(len(h), unknown)
                if len(frequent):
                    i = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    weight = np.where(frequent[i] == h, weights[i], unknown)
                places = max(len(h) - k + 1, 0)
                least = np.zeros(places)
                for j in range(k):
                    least = least + weight[j : j + places]
                for tokens, where in _shingles(h, at, k):
                    unique, i = np.unique(tokens, return_index=True)
                    n = len(unique)
                    sizes.append(n)
                    first.append(int(mix(unique).sum().view(np.int64)) if n else 0)
                    second.append(int(mix(unique ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum().view(np.int64)) if n else 0)
                    p = n - -(-n * num // den) + 1 if n else 0
                    rank = least[where][i] if n > 1 else np.zeros(n, np.int64)
                    prefixes.append(unique[np.lexsort((unique, rank))[:p]].view(np.int64))
                    alike.append(int(sequences(prefixes[-1].view(np.uint64), p)[0].view(np.int64)) if p else 0)
                    bits = max(LEAST_PARITY_BITS, 1 << (n - 1).bit_length()) if n else LEAST_PARITY_BITS
                    odd = np.bincount((unique & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                    parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            offsets = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum([len(p) for p in prefixes], out=offsets[1:])
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64))
            parity_at = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum([len(p) for p in parities], out=parity_at[1:])
            parity = pa.ListArray.from_arrays(pa.array(parity_at), pa.array(np.concatenate(parities) if parities else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(alike, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat), parity], names=[key, "n", "s1", "s2", "g", "prefix", "parity"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(frugal(run), f"`{key}` {kind}, n bigint, s1 bigint, s2 bigint, g bigint, prefix array<bigint>, parity array<bigint>")


def _sets(docs: DataFrame, ids: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """id and token set of the documents in ``ids`` (and of few others)."""
    wanted = docs.sparkSession.sparkContext.broadcast(build(ids))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher = Hasher(lower=True)
        for batch in batches:
            batch = batch.filter(batch.column(key).is_valid())
            batch = batch.filter(pa.array(member(wanted.value, batch.column(key).to_numpy().astype(np.int64))))
            found = [np.unique(t).view(np.int64) for _, _, h, at in hasher.documents(batch.column(text)) for t, _ in _shingles(h, at, k)]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(t) for t in found], out=offsets[1:])
            yield pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))], names=["id", "tokens"])

    return docs.select(key, text).mapInArrow(frugal(run), "id bigint, tokens array<bigint>")


def _near(pa, pb, na, nb, num: int, den: int):
    """Whether two sets can be similar enough by their parities, the longer of which is folded to the shorter."""
    half = lambda p: F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(p) / 2, F.lit(1)).cast("int")), F.slice(p, (F.size(p) / 2).cast("int") + 1, F.size(p)), lambda x, y: x.bitwiseXOR(y))
    longer = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(x)
    counted = F.aggregate(F.zip_with(longer(pa, pb), longer(pb, pa), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    differ = F.when(F.size(pa).between(F.size(pb) / 2, F.size(pb) * 2), counted).otherwise(0)
    return (na + nb - differ) * F.lit(num + den) >= (na + nb) * F.lit(2 * num)


def verified(docs: DataFrame, pairs: DataFrame, parity: DataFrame, k: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pairs ``a, b`` whose exact sets are similar enough; pairs whose parities (id, n, parity) differ too much go first."""
    l, r = (parity.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}")) for c in ("a", "b"))
    near = _near(F.col("pa"), F.col("pb"), F.col("na"), F.col("nb"), num, den)
    pairs = checkpointed(pairs.join(l, "a").join(r, "b").where(near).select("a", "b"))
    sets = checkpointed(_sets(docs, pairs.select(F.explode(F.array("a", "b"))), k, key, text))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return checkpointed(both.where(shared * F.lit(num + den) >= (F.size("x") + F.size("y")) * F.lit(num)).select("a", "b"))


def _may_match(num: int, den: int):
    """Size and position filters on two postings ``l`` and ``r`` of one token."""
    n, m, i, j = (F.col(c) for c in ("l.n", "r.n", "l.pos", "r.pos"))
    most = F.least(i, j) + F.least(n - i, m - j)
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (most * (num + den) >= (n + m) * num)


def _postings(groups: DataFrame) -> DataFrame:
    """token, gid, n, pos, head, c (groups with the token) of the prefix tokens that at least two groups have.

    Tokens are counted first; a Bloom filter of the repeated ones then keeps most of the others from being shuffled again.
    """
    counts = groups.select("gid", F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c"), F.min("gid").alias("head"))
    heads = checkpointed(counts.where("c > 1"))
    repeated = groups.sparkSession.sparkContext.broadcast(build(heads.select("token")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            prefix = batch.column("prefix")
            offsets = prefix.offsets.to_numpy()
            tokens = prefix.values.to_numpy()[offsets[0] : offsets[-1]]
            rows = np.repeat(np.arange(len(prefix)), np.diff(offsets))
            keep = member(repeated.value, tokens)
            rows, tokens, pos = rows[keep], tokens[keep], (np.arange(len(tokens)) - (offsets - offsets[0])[rows])[keep]
            yield pa.RecordBatch.from_arrays([pa.array(tokens), batch.column("gid").take(pa.array(rows)), batch.column("n").take(pa.array(rows)).cast(pa.int32()), pa.array(pos.astype(np.int32))], names=["token", "gid", "n", "pos"])

    found = groups.select("gid", "n", "prefix").mapInArrow(frugal(run), "token bigint, gid bigint, n int, pos int")
    return checkpointed(lookup_join(found, heads.withColumn("__c", F.col("c")), "token", "c").withColumnRenamed("__c", "c"))


def _blocks(rows: DataFrame, key: str, count: str, member_id: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` twice with ``block``: each row in one block of its key, and each row in every block of its key."""
    n = F.ceil(F.col(count) / BLOCK_ROWS).cast("int")
    return rows.withColumn("block", F.pmod(F.xxhash64(member_id), n).cast("int")), rows.withColumn("block", F.explode(F.sequence(F.lit(0), n - 1)))


def _classes(docs: DataFrame, k: int, num: int, den: int, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows; n, s1, s2, gid, rep of the classes; parities by id; first members of the groups with their prefix."""
    found = checkpointed(signatures(docs, frequent_words(docs, text), k, num, den, key, text))
    full = found.where("n > 0").where(F.col(key).isNotNull()).withColumn("id", F.col(key).cast("bigint"))
    classes = checkpointed(full.groupBy("n", "s1", "s2", "g").agg(F.min("id").alias("rep")))
    members = classes.join(classes.groupBy("n", "g").agg(F.min("rep").alias("gid")), ["n", "g"])
    members = checkpointed(members.select("n", "s1", "s2", "gid", "rep"))
    groups = full.select("id", "n", "prefix").join(members.where("gid = rep").select(F.col("gid").alias("id"), "n"), ["id", "n"]).withColumnRenamed("id", "gid").dropDuplicates(["gid", "n"])
    return found, members, full.select("id", "n", "parity"), groups


def _crowded(pairs: DataFrame, member: DataFrame, crowds: DataFrame, condition, num: int, den: int) -> DataFrame:
    """a, b: the members (gid, r, c, p, size) of both groups of ``pairs`` that meet ``condition`` and can be similar by their parities.

    ``crowds(gid, m)`` counts the members of groups with more than one; large groups are met block by block."""
    y = member.join(crowds, "gid", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    x = y.select(F.col("gid").alias("a"), *(F.col(c).alias(f"{c}a") for c in ("r", "c", "p", "size")))
    y, _ = _blocks(y, "gid", "m", "r")
    y = y.select(F.col("gid").alias("b"), "block", *(F.col(c).alias(f"{c}b") for c in ("r", "c", "p", "size")))
    met = pairs.join(x, "a").join(crowds.select(F.col("gid").alias("b"), "m"), "b", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    _, met = _blocks(met, "b", "m", "b")
    near = _near(F.col("pa"), F.col("pb"), F.col("sizea"), F.col("sizeb"), num, den)
    return met.join(y, (met.b == y.b) & (met.block == y.block) & condition & near).select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def similarity_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest id reachable by links, itself included) for every row of ``docs``."""
    found, members, parity, groups = _classes(docs, k, num, den, key, text)
    postings = _postings(groups)
    small, large = postings.where(F.col("c") <= SMALL), postings.where(F.col("c") > SMALL)
    l, r = small.alias("l"), small.alias("r")
    pairs = l.join(r, (F.col("l.token") == F.col("r.token")) & (F.col("l.gid") < F.col("r.gid"))).where(_may_match(num, den)).select(F.col("l.gid").alias("a"), F.col("r.gid").alias("b"))
    heads = large.where("gid = head").select("token", "c", *(F.col(x).alias(f"h{x}") for x in ("gid", "n", "pos")))
    others = lookup_join(large.where("gid <> head").select("token", "gid", "n", "pos"), checkpointed(heads), "token", "c")
    stars = others.select(F.struct(F.col("hn").alias("n"), F.col("hpos").alias("pos")).alias("l"), F.struct("n", "pos").alias("r"), "hgid", "gid").where(_may_match(num, den)).select(F.col("hgid").alias("a"), F.col("gid").alias("b"))
    inside = members.where("gid <> rep").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    pairs = checkpointed(pairs.distinct())
    first = verified(docs, pairs.unionByName(stars).unionByName(inside).distinct(), parity, k, num, den, key, text)

    labels = components(first)
    members = checkpointed(members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("n", "s1", "s2", "gid", "rep", F.coalesce("component", "rep").alias("component")))
    member = members.select("gid", F.col("rep").alias("r"), F.col("component").alias("c")).join(parity.select(F.col("id").alias("r"), F.col("n").alias("size"), F.col("parity").alias("p")).dropDuplicates(["r", "size"]), "r")
    member = checkpointed(member)
    left = large.select("token", "gid", "n", "pos").join(members.select("gid", "rep", "component"), "gid")
    spread = left.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"))
    open_tokens = checkpointed(spread.where("lo < hi").select("token", "m", F.col("m").alias("rows")))
    left = lookup_join(left, open_tokens, "token", "m").select("token", "n", "pos", "rows", F.col("rep").alias("r"))
    l, r = (x.alias(side) for x, side in zip(_blocks(checkpointed(left.join(member.select("r", "c", "p"), "r")), "token", "rows", "r"), "lr", strict=True))
    ordered = (F.col("l.token") == F.col("r.token")) & (F.col("l.block") == F.col("r.block")) & (F.col("l.c") < F.col("r.c"))
    met = l.join(r, ordered & _may_match(num, den) & _near(F.col("l.p"), F.col("r.p"), F.col("l.n"), F.col("r.n"), num, den)).select(F.col("l.r").alias("a"), F.col("r.r").alias("b"))
    crowds = checkpointed(members.groupBy("gid").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("m > 1"))
    wide = pairs.join(crowds.select(F.col("gid").alias("a")), "a", "left_semi").unionByName(pairs.join(crowds.select(F.col("gid").alias("b")), "b", "left_semi").select("a", "b"))
    inside = crowds.where("lo < hi").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    crowd = _crowded(wide.unionByName(inside).distinct(), member, crowds.select("gid", "m"), F.col("ca") != F.col("cb"), num, den)
    rest = met.unionByName(crowd).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = verified(docs, rest, parity, k, num, den, key, text)

    labels = components(first.unionByName(second))
    by_class = members.select("n", "s1", "s2", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    return _by_row(found, by_class, "component", key).select(key, F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _by_row(found: DataFrame, by_class: DataFrame, column: str, key: str) -> DataFrame:
    """key, n and ``column`` of the row's class; a row without a set gets its own id, one with a null id a null.

    Large classes are looked up by broadcast, so that copies of one text don't meet in one task."""
    kind = F.struct("n", "s1", "s2").alias("kind")
    sizes = found.select(kind).groupBy("kind").agg(F.count("*").alias("rows"))
    table = written(by_class.select(kind, column).join(sizes, "kind"), "classes")
    out = lookup_join(found.select(F.col(key).alias("__key"), "n", kind), table, "kind", "rows", keep_all=True)
    own = F.when(F.col("__key").isNotNull(), F.coalesce(F.col(column), F.col("__key").cast("bigint")))
    return out.select(F.col("__key").alias(key), "n", own.alias(column))


def similar_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: ``a, b`` (a < b) of the classes of equal sets that are similar enough, and key, class_id of every row.

    A class is named by its smallest id; rows of one class are linked without a pair. Unlike :func:`similarity_components` this
    verifies every candidate pair, those within one component too."""
    found, members, parity, groups = _classes(docs, k, num, den, key, text)
    l, r = (x.alias(side) for x, side in zip(_blocks(_postings(groups), "token", "c", "gid"), "lr", strict=True))
    same = (F.col("l.token") == F.col("r.token")) & (F.col("l.block") == F.col("r.block")) & (F.col("l.gid") < F.col("r.gid"))
    pairs = l.join(r, same & _may_match(num, den)).select(F.col("l.gid").alias("a"), F.col("r.gid").alias("b"))
    crowds = checkpointed(members.groupBy("gid").agg(F.count("*").alias("m")).where("m > 1"))
    inside = crowds.select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    member = members.select("gid", F.col("rep").alias("r"), F.col("rep").alias("c")).join(parity.select(F.col("id").alias("r"), F.col("n").alias("size"), F.col("parity").alias("p")).dropDuplicates(["r", "size"]), "r")
    met = _crowded(pairs.unionByName(inside).distinct(), checkpointed(member), crowds, F.col("ca") != F.col("cb"), num, den)
    links = verified(docs, met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), parity, k, num, den, key, text)
    return links, _by_row(found, members.select("n", "s1", "s2", F.col("rep").alias("class_id")), "class_id", key).select(key, "class_id")
