import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from blockloom import cli
from blockloom.operators import parse
from blockloom.sources import container, docx, docx_writer
from blockloom.streaming import versions

PNG = b"\x89PNG\r\n\x1a\n" + b"0" * 20
MD = "# Title\n\nplain *it* **bold**\n| a | b |\n| --- | ---: |\n| x\\|y | 2 |\n\nlink [site](https://x/a%20b)\nchange {++in++}{--out--}\n![Image 1](assets/image1.png)\nnote[^1]\n[^1]: the note"


def content(spark, md, doc_id=1):
    return spark.createDataFrame([(doc_id, 1, md)], "doc_id bigint, version bigint, content_md string")


def built(spark, md):
    blocks = parse.parse_blocks(content(spark, md)).withColumn("asset", F.when(F.col("type") == "image", F.lit(PNG)))
    return blocks, docx_writer.build(blocks, "Ann", "2026-01-01T00:00:00Z", notes=parse.footnote_definitions(content(spark, md)))


def test_round_trip(spark):
    _, made = built(spark, MD)
    found = docx.elements(made.select(F.lit("a").alias("path"), F.col("docx").alias("content")))
    rows = docx.blocks(found).orderBy("pos").collect()
    assert [(r["type"], r["content"]) for r in rows] == [
        ("heading", "# Title"), ("paragraph", "plain *it* **bold**"), ("table", "| a | b |\n| --- | ---: |\n| x\\|y | 2 |"), ("paragraph", "link [site](https://x/a%20b)"),
        ("paragraph", "change {++in++}{--out--}"), ("image", "![Image 1](assets/image1.png)"), ("paragraph", "note[^1]"), ("paragraph", "[^1]: the note"),
    ]
    (change, gone) = rows[4]["track_changes"]
    assert (change["type"], change["start"], change["end"], change["author"]) == ("insertion", 7, 9, "Ann") and gone["deleted_text"] == "out"
    assert bytes(rows[5]["asset"]) == PNG
    assert rows[-1]["content_start"] == sum(len(r["content"]) + 1 for r in rows[:-1])
    accepted = docx.blocks(found, track_changes=False).where("pos = 4").first()
    assert accepted["content"] == "change in" and accepted["track_changes"] is None


def test_unreadable_file_is_a_row(spark):
    rows = spark.createDataFrame([("x", bytearray(b"junk"))], "path string, content binary")
    assert docx.elements(rows).first()["error"].startswith("BadZipFile")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<!DOCTYPE a><a/>")
    rows = spark.createDataFrame([("x", bytearray(out.getvalue()))], "path string, content binary")
    assert "document type" in docx.elements(rows).first()["error"]


def test_containers(spark, tmp_path):
    blocks = parse.parse_blocks(content(spark, MD))
    styles = blocks.select("doc_id", "block_id", F.lit("Normal").alias("docx_style"))
    docs = container.documents(blocks, styles, "2026-01-01T00:00:00Z").withColumn("assets", F.create_map(F.lit("i.png"), F.lit(PNG), F.lit("../evil"), F.lit(PNG)))
    container.write(docs, str(tmp_path)).collect()
    members = container.read_zips(spark, str(tmp_path))
    assert container.containers(members).first()["files"] == ["assets/i.png", "content.md", "manifest.json", "structure.json", "styles.json"]
    back = container.structure_blocks(members).orderBy("pos")
    assert [r["content"] for r in back.collect()] == [r["content"] for r in blocks.orderBy("pos").collect()]


def test_unsafe_and_broken_zips(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.sdoc", "w") as z:
        z.writestr("../evil", "x")
        z.writestr("content.md", "x")
    (tmp_path / "b.sdoc").write_bytes(b"junk")
    rows = {(os.path.basename(r["path"]), r["name"]): r for r in container.read_zips(spark, str(tmp_path)).collect()}
    assert rows["a.sdoc", "../evil"]["error"] == "unsafe name" and rows["a.sdoc", "../evil"]["bytes"] is None
    assert rows["a.sdoc", "content.md"]["safe"] and rows["b.sdoc", None]["error"].startswith("BadZipFile")
    with pytest.raises(ValueError):
        container.unpack(str(tmp_path / "a.sdoc"), str(tmp_path / "out"))
    assert not (tmp_path / "evil").exists()


def test_command_line(spark, tmp_path, capsys):
    _, made = built(spark, MD)
    source = tmp_path / "a.docx"
    source.write_bytes(bytes(made.first()["docx"]))
    box = tmp_path / "box.docdir"
    assert cli.main(["extract", str(source), "-o", str(box)]) == 0
    assert sorted(os.listdir(box)) == ["assets", "content.md", "manifest.json", "structure.json", "styles.json"]
    assert cli.main(["extract", str(source), "-o", str(box)]) == 1
    assert cli.main(["validate", str(box)]) == 0
    assert cli.main(["info", str(box)]) == 0
    assert cli.main(["diff", str(box)]) == 0
    (box / "content.md").write_text((box / "content.md").read_text().replace("plain *it*", "plainer *it*") + "\nadded")
    capsys.readouterr()
    assert cli.main(["diff", str(box)]) == 0
    said = capsys.readouterr().out
    assert "~ [paragraph] plainer" in said and "+ [paragraph] added" in said
    assert cli.main(["sync", str(box), "-o", str(tmp_path / "b.docx")]) == 0 and (tmp_path / "b.docx").exists()
    assert cli.main(["pack", str(box), "-o", str(tmp_path / "p.sdoc")]) == 0
    assert cli.main(["unpack", str(tmp_path / "p.sdoc"), "-o", str(tmp_path / "q.docdir")]) == 0
    assert cli.main(["build", str(tmp_path / "p.sdoc"), "-o", str(tmp_path / "c.docx")]) == 0
    assert cli.main(["diff", str(tmp_path / "p.sdoc")]) == 3
    assert cli.main(["info", str(tmp_path / "none")]) == 2


def test_stream_of_versions(spark, tmp_path):
    source, state, changes, marks = (str(tmp_path / n) for n in ("in", "state", "changes", "marks"))
    for version, md in ((1, "a\nb"), (2, "a\nc is new")):
        spark.createDataFrame([(1, version, md)], "doc_id bigint, version bigint, content_md string").coalesce(1).write.mode("append").parquet(source)
        versions.sync_stream(spark, source, state, changes, marks).awaitTermination()
    got = sorted((r["epoch"], r["change"], r["content"]) for r in spark.read.parquet(changes).collect())
    assert got == [(0, "added", "a"), (0, "added", "b"), (1, "added", "c is new"), (1, "removed", "b"), (1, "unchanged", "a")]


def test_merged_cells_fold_and_repeat(spark):
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    rows = [cell("h", '<w:gridSpan w:val="2"/>') + cell("x"), cell("m", '<w:vMerge w:val="restart"/>') + cell("1") + cell("2"), cell("", "<w:vMerge/>") + cell("3") + cell("4")]
    table = "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{table}</w:body></w:document>')
    (block,) = docx.blocks(docx.elements(spark.createDataFrame([("t", bytearray(out.getvalue()))], "path string, content binary"))).collect()
    assert block["content"].split("\n")[2:] == ["| m | 1 | 2 |", "| m | 3 | 4 |"] and block["content"].startswith("| h | h | x |")
    assert [tuple(m) for m in block["table_metadata"]["merged_cells"]] == [(0, 0, 1, 2), (1, 0, 2, 1)]


def test_changes_keep_their_author(spark):
    change = [{"type": "deletion", "author": "Bo", "date": "2020-01-01T00:00:00Z", "deleted_text": "out"}, {"type": "insertion", "author": "Cy", "date": "2021-01-01T00:00:00Z", "deleted_text": None}]
    made = docx_writer.document([{"type": "paragraph", "content": "a {++in++}{--out--}{--else--}", "level": None, "image_path": None, "track_changes": change}, {"type": "paragraph", "content": "{++new++}", "level": None, "image_path": None}], "Ann", "2026-01-01T00:00:00Z")
    rows = docx.blocks(docx.elements(spark.createDataFrame([("t", bytearray(made))], "path string, content binary"))).orderBy("pos").collect()
    assert [(c["author"], c["revision_id"]) for c in rows[0]["track_changes"]] == [("Cy", "1"), ("Bo", "2"), ("Ann", "3")]
    assert [(c["author"], c["revision_id"]) for c in rows[1]["track_changes"]] == [("Ann", "1")]
