import random
import re

from pyspark.sql import functions as F

from blockloom.operators import parse


def sequential(md):
    """The parsing rules one line at a time: (type, content)."""
    lines, out, i = [x.strip() for x in md.split("\n")], [], 0
    row = lambda s: s.startswith("|") and s.endswith("|")
    rule = lambda s: row(s) and all(re.fullmatch(":*-+:*", c.strip()) for c in s[1:-1].split("|") if c.strip())
    while i < len(lines):
        s = lines[i]
        j = i + 1
        if not s or re.match(r"^\[\^(\d+)\]:\s*(.+)$", s):
            pass
        elif s.startswith("<!-- textbox"):
            while j < len(lines) and lines[j] != "<!-- /textbox -->":
                j += 1
            j = min(j + 1, len(lines))
            out.append(("textbox", "\n".join(lines[i:j])))
        elif row(s) and j < len(lines) and rule(lines[j]):
            j += 1
            while j < len(lines) and row(lines[j]):
                j += 1
            out.append(("table", "\n".join(lines[i:j])))
        elif s.startswith("![") and "](" in s and s.endswith(")"):
            out.append(("chart" if s[2 : s.find("](")].startswith("Chart") else "image", s))
        else:
            out.append(("heading" if s.startswith("#") else "paragraph", s))
        i = j
    return out


PARTS = ["", " ", "text", "# h", "#tag", "| a | b |", "| --- | :-: |", "|", "| x |", "| |", "<!-- textbox -->", "<!-- textbox wide -->", "<!-- /textbox -->", "![a](b.png)", "![Chart 1](c)", "![chart](c)", "[^1]: note", "  - item", "![](x)", "![Ch](art)"]


def test_parser_equals_sequential_rules(spark):
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choice(PARTS) for _ in range(rng.randrange(14)))) for i in range(1500)]
    content = spark.createDataFrame(docs, "doc_id bigint, content_md string").withColumn("version", F.lit(1))
    got = {}
    for r in parse.parse_blocks(content).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append((r["type"], r["content"]))
        assert r["content_end"] - r["content_start"] == len(r["content"])
        assert r["block_id"] == f"block-{r['pos']}"
    assert {i: got.get(i, []) for i, _ in docs} == {i: sequential(md) for i, md in docs}


def one(spark, md):
    return spark.createDataFrame([(1, 1, md)], "doc_id bigint, version int, content_md string")


def test_table_metadata_and_cells(spark):
    blocks = parse.parse_blocks(one(spark, "# t\n| a | b |\n|:--|--:|\n| 1 |\n| 2 | 3 | 4 |\n\n| c |\n|---|"))
    tables = blocks.where("type = 'table'").orderBy("pos").collect()
    assert [(t["table_metadata"]["rows"], t["table_metadata"]["cols"], t["table_metadata"]["docx_table_index"], t["docx_paragraph_index"]) for t in tables] == [(3, 2, 0, -1), (1, 1, 1, -1)]
    cells = parse.table_cells(blocks).where("pos = 1").orderBy("row", "col").collect()
    assert [(c["row"], c["text"], c["align"]) for c in cells] == [(0, "a", "left"), (0, "b", "right"), (1, "1", "left"), (1, "", "right"), (2, "2", "left"), (2, "3", "right")]


def test_footnotes_last_definition_wins(spark):
    content = one(spark, "a[^2] b[^1]\n[^1]: one\n[^2]: two\n[^1]: again\nc[^9]")
    blocks = parse.parse_blocks(content)
    got = parse.footnote_numbers(parse.footnotes(blocks, content)).orderBy("number").collect()
    assert [(r["number"], r["note_id"], r["content"]) for r in got] == [(1, 2, "two"), (2, 1, "again"), (3, 9, "")]


def test_line_blocks_and_rebuild(spark):
    content = one(spark, "# a\n\n- x\n12. y\n* z\n![i](p)")
    assert [r["type"] for r in parse.line_blocks(content).orderBy("pos").collect()] == ["heading", "paragraph", "list", "list", "list", "image"]
    assert parse.rebuild_markdown(parse.parse_blocks(content)).first()["content_md"] == "# a\n- x\n12. y\n* z\n![i](p)"


def test_oversize(spark):
    md = "| a |\n|---|\n" + "\n".join(["| x |"] * 1001)
    assert parse.oversize_tables(parse.parse_blocks(one(spark, md))).first()["exceeds"] == "rows"


def test_list_numbers(spark):
    rows = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(["List Number", "List Number", "Normal", "List Number"])], "doc_id bigint, version int, pos int, type string")
    assert [r["number"] for r in parse.list_numbers(rows).orderBy("pos").collect()] == [1, 2, None, 1]
