"""The few functions that need Python: sequence similarity, nested CriticMarkup, inline markdown runs, token counts.

All are Arrow-batched pandas UDFs; callers filter by cheap expressions first, as Catalyst doesn't order Python functions by cost.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from blockloom.functions import text as T


def ratio(old: str | None, new: str | None) -> float:
    """Share of matching characters; the order of the arguments matters."""
    return SequenceMatcher(None, old or "", new or "").ratio()


@F.pandas_udf(DoubleType())
def similarity(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([ratio(a, b) for a, b in zip(old, new, strict=True)], dtype="float64")


_MARKS = [(kind, re.compile(p.removeprefix("(?d)"))) for kind, p in (("insertion", T.INSERTION), ("deletion", T.DELETION), ("substitution", T.SUBSTITUTION))]


def segments(text: str | None) -> list[dict]:
    """CriticMarkup segments; marks that overlap each give theirs, and the text cursor follows the last one taken."""
    text = text or ""
    found = sorted(((m.start(), m.end(), rank, kind, m.groups()) for rank, (kind, p) in enumerate(_MARKS) for m in p.finditer(text)), key=lambda x: (x[0], x[2]))
    out, cursor = [], 0
    for start, end, _, kind, groups in found:
        if start > cursor:
            out.append(("text", text[cursor:start]))
        out += [("deletion", groups[0]), ("insertion", groups[1])] if kind == "substitution" else [(kind, groups[0])]
        cursor = end
    if cursor < len(text):
        out.append(("text", text[cursor:]))
    return [{"kind": k, "text": t} for k, t in out or [("text", text)]]


@F.pandas_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType())])))
def critic_segments(text: pd.Series) -> pd.Series:
    return text.map(segments)


_TOKEN = re.compile(r"\\([!-/:-@\[-`{-~])|(`+)|(\*+|_+)|(\n)|([^\\`*_\n]+|\\)")


def runs(text: str | None) -> list[dict]:
    """(text, bold, italic) runs of inline markdown: emphasis nests, escapes and code spans are literal, breaks are spaces.

    Delimiters pair by the flanking rules of CommonMark; what finds no partner stays text.
    """
    text = text or ""
    items: list[list] = []  # [kind, text, can open, can close, marks left]
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        escaped, ticks, marks, newline, plain = m.groups()
        end = m.end()
        if ticks:
            close = re.compile(rf"(?<!`){re.escape(ticks)}(?!`)").search(text, end)
            if close:
                items.append(["text", text[end : close.start()].replace("\n", " ")])
                end = close.end()
            else:
                items.append(["text", ticks])
        elif marks:
            before, after = text[at - 1 : at] if at else "", text[end : end + 1]
            space = lambda c: not c or c.isspace()
            punctuation = lambda c: bool(c) and not c.isalnum() and not c.isspace()
            left = not space(after) and (not punctuation(after) or space(before) or punctuation(before))
            right = not space(before) and (not punctuation(before) or space(after) or punctuation(after))
            word = marks[0] == "_"
            items.append([marks[0], marks, left and (not word or not right or punctuation(before)), right and (not word or not left or punctuation(after)), len(marks)])
        else:
            items.append(["text", " " if newline else escaped or plain])
        at = end
    spans, i = [], 0
    while i < len(items):
        closer = items[i]
        if closer[0] == "text" or not closer[3] or not closer[4]:
            i += 1
            continue
        for j in range(i - 1, -1, -1):
            opener = items[j]
            if opener[0] == closer[0] and opener[2] and opener[4] and not ((opener[3] or closer[2]) and (len(opener[1]) + len(closer[1])) % 3 == 0 and (len(opener[1]) % 3 or len(closer[1]) % 3)):
                n = 2 if opener[4] > 1 and closer[4] > 1 else 1
                spans.append((j, i, n))
                opener[4] -= n
                closer[4] -= n
                for k in range(j + 1, i):
                    if items[k][0] != "text":
                        items[k][2] = items[k][3] = False
                break
        else:
            i += 1
    out: list[dict] = []
    for k, item in enumerate(items):
        piece = item[1] if item[0] == "text" else item[0] * item[4]
        bold = any(a < k < z and n == 2 for a, z, n in spans)
        italic = any(a < k < z and n == 1 for a, z, n in spans)
        if not piece:
            continue
        if out and (out[-1]["bold"], out[-1]["italic"]) == (bold, italic):
            out[-1]["text"] += piece
        else:
            out.append({"text": piece, "bold": bold, "italic": italic})
    return out or [{"text": text, "bold": False, "italic": False}]


_RUNS = ArrayType(StructType([StructField("text", StringType()), StructField("bold", BooleanType()), StructField("italic", BooleanType())]))


@F.pandas_udf(_RUNS)
def _parsed_runs(text: pd.Series) -> pd.Series:
    return text.map(runs)


def inline_runs(text):
    """Runs of a text column; texts without markup don't reach Python."""
    plain = F.array(F.struct(text.alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic")))
    return F.when(text.rlike(r"[*_\\`\n]"), _parsed_runs(F.when(text.rlike(r"[*_\\`\n]"), text))).otherwise(plain)


def token_counter(encode):
    """A token-count column function around any ``encode(text) -> sequence``; empty texts count 0."""

    @F.pandas_udf(LongType())
    def count(text: pd.Series) -> pd.Series:
        return text.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count


def approximate_tokens(text):
    """Without a vocabulary at hand: words, and single punctuation marks. An approximation, and named so."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))).otherwise(0).cast("bigint")


def register(spark) -> None:
    """The functions that need Python, for use in SQL texts."""
    for name, f in (("doc_similarity", similarity), ("doc_critic_segments", critic_segments), ("doc_inline_runs", _parsed_runs)):
        spark.udf.register(name, f)
