import pytest
from pyspark.sql import functions as F

from blockloom.functions import inline
from blockloom.functions import text as T


def values(spark, function, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r["y"] for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_row_cells(spark):
    rows = ["| a | b |", r"| a\|b | c|", "|", "||", "| a |  |", r"|x\|", "a | b"]
    assert values(spark, T.row_cells, rows) == [["a", "b"], ["a|b", "c"], [""], [""], ["a", ""], ["x\\"], ["a", "b"]]


def test_separator(spark):
    rows = ["| --- | :-: |", "|:--|--:|", "|", "| |", "| - a |", "--- | ---", "| :: |", "|-|"]
    assert values(spark, T.is_table_separator, rows) == [True, True, True, True, False, False, False, True]


def test_alignments(spark):
    assert values(spark, T.alignments, ["| --- | :---: | ---: | :--- |", "| | --: |"]) == [["left", "center", "right", "left"], ["right"]]


def test_strip_takes_unicode_space(spark):
    assert values(spark, T.strip, ["   x y\u0085\n", "\x1c a \x1f", "", "\t"]) == [r.strip() for r in ["   x y\u0085\n", "\x1c a \x1f", "", "\t"]]


def test_urls(spark):
    assert values(spark, T.encode_url, ["a b(c)%", "x"]) == ["a%20b%28c%29%", "x"]
    assert values(spark, lambda c: T.decode_url(T.encode_url(c)), ["a b (c)+d"]) == ["a b (c)+d"]


def test_links(spark):
    rows = [r"see [a\]b](u) and ![p](q)", "none"]
    found = values(spark, T.links, rows)
    assert [[(x["text"], x["url"]) for x in r] for r in found] == [[(r"a\]b", "u"), ("p", "q")], []]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("***a***", ("a", True, True)), ("___a___", ("a", True, True)), ("**a**", ("a", True, False)), ("_a_", ("a", False, True)), ("**", ("**", False, False)), ("****", ("**", False, True)), (r"\[a\]", ("[a]", False, False))],
)
def test_link_formatting(spark, text, expected):
    (got,) = values(spark, T.link_formatting, [text])
    assert tuple(got) == expected


CRITIC = ["plain", "a{++b++}c", "{--x--}", "{~~o~>n~~} t", "{++open", "", "{++a++}{--b--}", "{~~a~>~~}", "x {~~no sep~~}"]


def test_critic_segments_agree_with_sequential(spark):
    found = values(spark, T.critic_segments, CRITIC)
    assert [[(s["kind"], s["text"]) for s in r] for r in found] == [[(s["kind"], s["text"]) for s in inline.segments(t)] for t in CRITIC]




def test_accept_and_reject(spark):
    text = ["a {++b++} {--c--} {~~d~>e~~}"]
    assert values(spark, T.accept_changes, text) == ["a b  e"]
    assert values(spark, T.reject_changes, text) == ["a  c d"]


def test_critic_errors(spark):
    rows = ["{++a", "{--a--} {--b", "{~~a~~}", "{~~a", "ok {++a++}"]
    assert values(spark, T.critic_errors, rows) == [["unclosed insertion"], ["unclosed deletion"], ["malformed substitution"], ["unclosed substitution"], []]


def test_safe_path(spark):
    rows = ["a/b", "/a", "../a", "a/../b", "a/../../b", "./a", "a//b", ".."]
    assert values(spark, T.safe_path, rows) == [True, False, False, True, False, True, True, False]


def test_extensions(spark):
    assert values(spark, lambda c: T.with_extension(c, ".sdoc"), ["a.docx", "a.sdoc", "dir.x/a", "a.b.c"]) == ["a.sdoc", "a.sdoc", "dir.x/a.sdoc", "a.b.sdoc"]
    assert values(spark, T.image_extension, ["a.png", "a.p-n!g", "a", "a.abcdefghijklm"]) == ["png", "png", "bin", "abcdefghij"]


def test_preview_and_description(spark):
    assert values(spark, T.preview, ["x" * 50, "x" * 51]) == ["x" * 50, "x" * 50 + "..."]


def test_image_problem(spark):
    df = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n..."), "png"), (bytearray(b"\xff\xd8\xff"), "png"), (bytearray(b"junk"), "gif")], "b binary, e string")
    assert [r[0] for r in df.select(T.image_problem(F.col("b"), F.col("e"))).collect()] == [None, "is jpeg", "unknown content"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a **b** c", [("a ", 0, 0), ("b", 1, 0), (" c", 0, 0)]), ("***x***", [("x", 1, 1)]), ("*a **b** c*", [("a ", 0, 1), ("b", 1, 1), (" c", 0, 1)]),
        (r"\*a\*", [("*a*", 0, 0)]), ("`*a*`", [("*a*", 0, 0)]), ("a\nb", [("a b", 0, 0)]), ("snake_case_word", [("snake_case_word", 0, 0)]), ("**open", [("**open", 0, 0)]), ("2 * 3 * 4", [("2 * 3 * 4", 0, 0)]),
    ],
)
def test_inline_runs(text, expected):
    assert [(r["text"], int(r["bold"]), int(r["italic"])) for r in inline.runs(text)] == expected


def test_similarity_depends_on_order():
    assert (inline.ratio("tide", "diet"), inline.ratio("diet", "tide")) == (0.25, 0.5)
    assert (inline.ratio("", "x"), inline.ratio("", "")) == (0.0, 1.0)
