"""Personal data by fixed patterns and by bootstrapped context, all of it in SQL expressions and joins.

Base spans are the leftmost non-overlapping matches of each kind that pass the kind's test. The patterns are written so that
matching takes linear time: runs are possessive, and a match begins where its run begins (or the last match ended).

Bootstrapping: words are instances, where a base span of any kind and what adjoins it counts as one word; the word before and the
word after an instance are its patterns. Instances that hold base spans are seeds. The pattern-instance graph is scored in rounds:
a pattern's confidence is the mean score of its instances, an instance's score the noisy-or of its confident patterns. Instances
whose score reaches ``threshold``, with patterns seen on at least ``support`` seeds' worth of instances, become spans of kind
``context``.

A pattern can only become confident if its distinct instances are few for its known score. Instances of one in SIEVE hash values are
counted first: where these alone are too many the pattern is out, exactly, and its other instances are never shuffled.

Null and empty texts have no spans. Repeated rows get the same spans. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.skew import lookup_join
from blockloom.llm.storage import checkpointed, written as stored

#: Instances are first counted for one in so many hash values.
SIEVE = 64
#: Tables of up to so many rows are broadcast; larger ones are joined by a shuffle.
MOST_BROADCAST = 1 << 19
CHUNK = 256
# Kinds in order.
KINDS = ["email", "ip", "card", "phone", "context"]
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
SPAN = "array<struct<start:int,kind:int,end:int>>"
MARK, JOINT = "\u0002", "\u0001"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.reverse(_digits(m))
    at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(at(i))).otherwise(at(i))) % 10 == 0


TESTS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def _folded(items: Column, state: dict[str, Column], step, kind: str, done=None) -> Column:
    """The array of ``kind`` that ``step(state, item)`` makes: it gives the next state and a condition and value to add, which a
    fold with one growing array would copy at each step; here CHUNK steps share a short array. ``done(state)`` adds a last value.

    ``step`` returns (dict of the state's columns, condition, value)."""
    empty = F.array().cast(f"array<{kind}>")
    names = list(state)

    def one(acc: Column, x: Column) -> Column:
        new, adds, value = step(acc, x)
        return F.struct(*(new[n].alias(n) for n in names), F.when(adds, F.array_append(acc["out"], value)).otherwise(acc["out"]).alias("out"))

    def over(z: Column) -> Column:
        def chunk(acc: Column, i: Column) -> Column:
            inner = F.aggregate(F.slice(z, i * CHUNK + 1, F.lit(CHUNK)), F.struct(*(acc[n].alias(n) for n in names), empty.alias("out")), one)
            return F.get(F.transform(F.array(inner), lambda y: F.struct(*(y[n].alias(n) for n in names), F.array_append(acc["all"], y["out"]).alias("all"))), F.lit(0))

        start = F.struct(*(c.alias(n) for n, c in state.items()), F.array().cast(f"array<array<{kind}>>").alias("all"))
        last = (lambda acc: F.flatten(acc["all"])) if done is None else (lambda acc: F.array_append(F.flatten(acc["all"]), done(acc)))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.greatest(F.size(z), F.lit(1)) - 1) / CHUNK).cast("int")), start, chunk, last)

    return F.get(F.transform(F.array(items), over), F.lit(0))


def _located(text: Column, pattern: str, test, number: int) -> Column:
    """Spans of kind ``number``: the matches that pass the test."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, x: Column):
        begin = acc["pos"] + F.length(x["g"])
        end = begin + F.length(F.coalesce(x["m"], F.lit("")))
        return {"pos": end}, x["m"].isNotNull() & test(F.coalesce(x["m"], F.lit(""))), F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end"))

    return _folded(F.arrays_zip(gaps.alias("g"), matches.alias("m")), {"pos": F.lit(0)}, step, "struct<start:int,kind:int,end:int>")


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one base kind; texts without its hint are not searched."""
    number = KINDS.index(kind)
    hint = text.rlike("[0-9]") if HINTS[kind] is None else F.contains(text, F.lit(HINTS[kind]))
    if kind in ("ip", "phone"):
        hint &= text.rlike("[0-9]")
    return F.when(hint, _located(text, PATTERNS[kind], TESTS[kind], number)).otherwise(F.array().cast(SPAN))


def _marked(text: Column, base: Column) -> Column:
    """The text with MARK before each base span, or what of it no earlier span covers, and its spaces replaced."""
    clean = F.translate(text, JOINT + MARK, "\u0003\u0003")

    def step(acc: Column, s: Column):
        begin = F.greatest(s["start"], acc["pos"])
        before, span = F.substring(clean, acc["pos"] + 1, begin - acc["pos"]), F.substring(clean, begin + 1, s["end"] - begin)
        return {"pos": F.greatest(s["end"], acc["pos"])}, s["end"] > acc["pos"], F.concat(before, F.lit(MARK), F.translate(span, " ", JOINT))

    parts = _folded(base, {"pos": F.lit(0)}, step, "string", lambda acc: F.substring(clean, acc["pos"] + 1, F.length(clean)))
    return F.when(F.size(base) == 0, clean).otherwise(F.array_join(parts, ""))


def mentions(marked: DataFrame, *ids: str) -> DataFrame:
    """ids, i, instance, known, left, right of every word of ``marked(marked)``; words with a digit or span count as ``#``."""
    words, edge = F.split("marked", r"\s+"), F.array(F.lit("#"))
    side = lambda w: F.when((w == "") | w.rlike(f"[0-9{MARK}]"), "#").otherwise(F.lower(w))
    sided = marked.select(*ids, words.alias("w")).select(*ids, "w", F.transform("w", side).alias("s"))
    beside = F.arrays_zip(F.col("w"), F.concat(edge, "s").alias("l"), F.concat(F.slice("s", F.lit(2), F.size("s")), edge).alias("r"))
    each = sided.select(*ids, F.posexplode(beside).alias("i", "x")).select(*ids, "i", "x.*").where("w <> ''")
    return each.select(*ids, "i", F.lower("w").alias("instance"), F.contains("w", F.lit(MARK)).alias("known"), F.col("l").alias("left"), F.col("r").alias("right"))


def _edges(each: DataFrame) -> DataFrame:
    pattern = F.explode(F.array(F.concat(F.lit("l:"), "left"), F.concat(F.lit("r:"), "right"))).alias("pattern")
    return each.select("instance", pattern).where("pattern not in ('l:#', 'r:#')")


def _joined(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join with a checkpointed table that is broadcast if its size, which is counted, allows it."""
    return rows.join(F.broadcast(table) if table.count() <= MOST_BROADCAST else table.hint("merge"), key, how)


def scored(marked: DataFrame, rounds: int, support: float, threshold: float) -> DataFrame:
    """instance of the unknown instances that confident patterns bring to the threshold.

    Only patterns whose instances' scores sum up to ``support`` can be confident, so a round reads the corpus for the edges of
    instances with a score and for all instances of such patterns that pass the sieve; other edges can't matter."""
    seeds = mentions(marked.where(F.contains("marked", F.lit(MARK)))).where("known")
    touched = checkpointed(_edges(seeds).distinct())
    scores = touched.select("instance").distinct().select("instance", F.lit(1.0).alias("seed"), F.lit(1.0).alias("score"))
    for _ in range(rounds):
        known = touched.join(scores, "instance").groupBy("pattern").agg(F.sum("score").alias("known")).where(F.col("known") >= support)
        known = stored(known, "patterns")
        some = _edges(mentions(marked).where(F.pmod(F.xxhash64("instance"), F.lit(SIEVE)) == 0))
        many = _joined(some, known, "pattern").distinct().groupBy("pattern").agg(F.count("*").alias("n"), F.max("known").alias("known")).where(F.col("n") * threshold > F.col("known"))
        known = stored(known.join(many, "pattern", "left_anti"), "patterns")
        slots = stored(_joined(_edges(mentions(marked)), known, "pattern").distinct(), "slots")
        n = slots.groupBy("pattern").agg(F.count("*").alias("n"), F.max("known").alias("known"))
        confident = stored(n.where(F.col("known") >= threshold * F.col("n")).select("pattern", "n", F.least(F.col("known") / F.col("n"), F.lit(0.999)).alias("confidence")), "patterns")
        lifted = lookup_join(slots.select("instance", "pattern"), confident, "pattern", "n").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("new"))
        joined = scores.join(lifted, "instance", "full").select("instance", F.coalesce("seed", F.lit(0.0)).alias("seed"), F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("new", F.lit(0.0))).alias("score"))
        after = stored(joined, "scores")
        fresh = stored(after.join(scores.select("instance"), "instance", "left_anti").select("instance"), "instances")
        scores = after
        if fresh.isEmpty():
            break
        touched = stored(touched.union(_edges(_joined(mentions(marked), fresh, "instance", "left_semi")).distinct()), "edges")
    return scores.where((F.col("seed") == 0) & (F.col("score") >= threshold)).select("instance")


def all_spans(docs: DataFrame, rounds: int = 3, support: float = 4.0, threshold: float = 0.9, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, row (hash of the text), base and spans (both ``array<struct<start,kind,end>>``, sorted) for every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(*(base_spans(body, k) for k in KINDS[:4])))
    based = docs.select(F.xxhash64(text).alias("row"), F.col(key), base.alias("base"), body.alias("body"))
    found = stored(based.select("row", key, "base", _marked(F.col("body"), F.col("base")).alias("marked")), "marked")
    new = stored(scored(found.select("marked"), rounds, support, threshold), "instances")
    hits = _joined(mentions(found, key, "row").where("not known"), new, "instance", "left_semi")
    hits = stored(hits.groupBy(key, "row").agg(F.array_sort(F.collect_set("i")).alias("hits")), "hits")

    def step(acc: Column, x: Column):
        begin = acc["pos"] + F.length(F.replace(F.coalesce(x["g"], F.lit("")), F.lit(MARK)))
        end = begin + F.length(F.replace(x["w"], F.lit(MARK)))
        hit = F.coalesce(F.get("hits", acc["j"]) == acc["i"], F.lit(False))
        return {"pos": end, "i": acc["i"] + 1, "j": acc["j"] + hit.cast("int")}, hit, F.struct(begin.alias("start"), F.lit(KINDS.index("context")).alias("kind"), end.alias("end"))

    words, gaps = F.split("marked", r"\s+"), F.concat(F.array(F.lit("")), F.regexp_extract_all("marked", F.lit(r"\s+"), F.lit(0)))
    extra = _folded(F.arrays_zip(gaps.alias("g"), words.alias("w")), {"pos": F.lit(0), "i": F.lit(0), "j": F.lit(0)}, step, "struct<start:int,kind:int,end:int>")
    f, h = found.alias("f"), hits.alias("h")
    joined = f.join(h, (F.col("f.row") == F.col("h.row")) & F.col(f"f.{key}").eqNullSafe(F.col(f"h.{key}")), "left").select("f.*", "h.hits")
    return joined.select("row", key, "base", F.when(F.col("hits").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", extra))).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (text form of all spans)."""
    of_kind = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("bigint")
    counts = [of_kind(n).alias(f"n_{k}") for n, k in enumerate(KINDS[:4])]
    return all_spans(docs, key=key, text=text).select(key, *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets; of overlapping spans the first is named.

    A column ``length`` of changed texts is set anew.
    """
    spans = all_spans(docs, key=key, text=text).where(F.size("spans") > 0).select(key, "row", "spans").dropDuplicates([key, "row"])
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    body = F.col(f"__doc.{text}")

    def step(acc: Column, s: Column):
        cut = F.concat(F.substring(body, acc["pos"] + 1, s["start"] - acc["pos"]), F.get(names, s["kind"]))
        return {"pos": F.greatest(acc["pos"], s["end"])}, s["start"] >= acc["pos"], cut

    new = F.array_join(_folded(F.col("__spans"), {"pos": F.lit(0)}, step, "string", lambda acc: F.substring(body, acc["pos"] + 1, F.length(body))), "")
    rows = docs.select(F.struct("*").alias("__doc"), F.col(key).alias("__key"), F.xxhash64(text).alias("__row"))
    r, t = rows.alias("r"), spans.select(F.col(key).alias("__key"), F.col("row").alias("__row"), F.col("spans").alias("__spans")).alias("t")
    joined = r.join(t, (F.col("r.__row") == F.col("t.__row")) & F.col("r.__key").eqNullSafe(F.col("t.__key")), "left").select("__doc", "__spans")
    with_new = joined.select("__doc", F.when(F.col("__spans").isNotNull(), new).alias("__new"))
    kept = {text: F.coalesce("__new", body)}
    if length in docs.columns:
        kept[length] = F.when(F.col("__new").isNotNull(), F.length("__new").cast(docs.schema[length].dataType)).otherwise(F.col(f"__doc.{length}"))
    return with_new.select(*(kept.get(c, F.col(f"__doc.{c}")).alias(c) for c in docs.columns))
