"""Blocks to Word files: one document for each group of rows, with the standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions import text as T
from blockloom.functions.inline import runs, segments

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_LINK = re.compile(T.LINK.removeprefix("(?d)"))
_NOTE = re.compile(T.FOOTNOTE_REF)
_DEFINITION = re.compile(T.FOOTNOTE_DEF)
_ITEM = re.compile(r"^(?:(-|\*) |(\d+)\. )")


class _Document:
    def __init__(self, author: str, date: str, notes: dict[str, str]):
        self.author, self.date, self.notes = author, date, notes
        self.links: list[str] = []
        self.used: list[str] = []
        self.changes: list[dict] = []

    def run(self, text: str, bold: bool = False, italic: bool = False, tag: str = "t", extra: str = "") -> str:
        props = ("<w:b/>" if bold else "") + ("<w:i/>" if italic else "") + extra
        body = "<w:br/>".join(f'<w:{tag} xml:space="preserve">{escape(t)}</w:{tag}>' for t in text.split("\n"))
        return f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}{body}</w:r>" if text else ""

    def emphasised(self, text: str) -> str:
        return "".join(self.run(x["text"], x["bold"], x["italic"]) for x in runs(text)) if text else ""

    def changed(self, text: str) -> str:
        """Changes take author and date from those the block had: a deletion by its text (the last of equal ones), an insertion from
        the first insertion. Ids count within the paragraph."""
        out, revision = [], 0
        gone = {c.get("deleted_text"): c for c in self.changes if c["type"] == "deletion"}
        first = next((c for c in self.changes if c["type"] == "insertion"), {})
        for s in segments(text):
            if s["kind"] == "text":
                out.append(self.run(s["text"]))
                continue
            revision += 1
            known = first if s["kind"] == "insertion" else gone.get(s["text"], {})
            author, date = known.get("author") or self.author, known.get("date") or self.date
            tag, name = ("t", "ins") if s["kind"] == "insertion" else ("delText", "del")
            out.append(f'<w:{name} w:id="{revision}" w:author={quoteattr(author)} w:date={quoteattr(date)}>{self.run(s["text"], tag=tag)}</w:{name}>')
        return "".join(out)

    def linked(self, text: str) -> str:
        out, at = [], 0
        for m in _LINK.finditer(text):
            out.append(self.emphasised(text[at : m.start()]))
            shown, bold, italic = _formatting(m[1])
            self.links.append(unquote(m[2]))
            out.append(f'<w:hyperlink r:id="rIdL{len(self.links)}">{self.run(shown, bold, italic, extra="<w:color w:val=%s/><w:u w:val=%s/>" % (chr(34) + "0563C1" + chr(34), chr(34) + "single" + chr(34)))}</w:hyperlink>')
            at = m.end()
        return "".join([*out, self.emphasised(text[at:])])

    def noted(self, text: str) -> str:
        out, at = [], 0
        for m in _NOTE.finditer(text):
            out.append(self.emphasised(text[at : m.start()]))
            self.used.append(m[1])
            out.append(f'<w:r><w:footnoteReference w:id="{len(self.used)}"/></w:r>')
            at = m.end()
        return "".join([*out, self.emphasised(text[at:])])

    def inline(self, text: str) -> str:
        """One rule for a text: changes, else notes, else links, else emphasis."""
        if any(s["kind"] != "text" for s in segments(text)):
            return self.changed(text)
        return self.noted(text) if _NOTE.search(text) else self.linked(text) if _LINK.search(text) else self.emphasised(text)

    def paragraph(self, text: str, style: str | None = None, align: str | None = None) -> str:
        jc = {"center": "center", "right": "right", "justify": "both"}.get(align or "")
        props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:jc w:val="{jc}"/>' if jc else "")
        parts = [self.inline(p.strip()) for p in text.split(T.COLUMN_BREAK)]
        return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}" + '<w:r><w:br w:type="column"/></w:r>'.join(parts) + "</w:p>"

    def table(self, content: str) -> str:
        rows, aligns = [], []
        for line in content.split("\n"):
            cells = _cells(line)
            if all(re.fullmatch(r":*-+:*|", c) for c in cells):
                aligns = ["center" if c.startswith(":") and c.endswith(":") else "right" if c.endswith(":") else "left" for c in cells if c]
            else:
                rows.append(cells)
        width = len(rows[0]) if rows else 0
        out = ["<w:tbl><w:tblPr/><w:tblGrid>" + '<w:gridCol w:w="1440"/>' * width + "</w:tblGrid>"]
        for i, cells in enumerate(rows):
            cells = (cells + [""] * width)[:width]
            head = "<w:trPr><w:tblHeader/></w:trPr>" if i == 0 else ""
            out.append(f"<w:tr>{head}" + "".join(f"<w:tc>{self.paragraph(c, align=aligns[k] if k < len(aligns) else None)}</w:tc>" for k, c in enumerate(cells)) + "</w:tr>")
        return "".join([*out, "</w:tbl>"])


def _cells(line: str) -> list[str]:
    s = line.strip()
    s = s[1:] if s.startswith("|") else s
    s = s[:-1] if s.endswith("|") else s
    return [c.replace("\x01", "|").strip() for c in s.replace("\\|", "\x01").split("|")]


def _formatting(text: str) -> tuple[str, bool, bool]:
    for width in (3, 2, 1):
        for mark in "*_":
            if len(text) > 2 * width and text.startswith(mark * width) and text.endswith(mark * width):
                return _unescaped(text[width:-width]), width >= 2, width != 2
    return _unescaped(text), False, False


def _unescaped(text: str) -> str:
    return text.replace("\\[", "[").replace("\\]", "]")


def document(rows: list[dict], author: str = "editor", date: str = "1970-01-01T00:00:00Z", assets: dict[str, bytes] | None = None) -> bytes:
    """A Word file of blocks ``(type, content, level, image_path)`` in order; headings deeper than nine are cut to nine."""
    notes, body = {}, []
    for r in rows:
        for line in r["content"].split("\n"):
            if m := _DEFINITION.match(line.strip()):
                notes[m[1]] = m[2]
    doc, assets = _Document(author, date, notes), assets or {}
    media: list[tuple[str, bytes]] = []
    for r in rows:
        kind, content = r["type"], r["content"]
        doc.changes = r.get("track_changes") or []
        if kind == "table":
            body.append(doc.table(content))
        elif kind == "heading":
            body.append(doc.paragraph(content.lstrip("#").strip(), f"Heading{max(1, min(9, r['level'] or 1))}"))
        elif kind in ("image", "chart"):
            name = (r["image_path"] or "").removeprefix("assets/")
            if name in assets:
                media.append((name, assets[name]))
                body.append(f'<w:p><w:r><w:drawing><a:blip xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" r:embed="rIdM{len(media)}"/></w:drawing></w:r></w:p>')
            else:
                body.append(doc.paragraph("[Chart: no preview available]" if kind == "chart" else "[Image]"))
        elif kind == "textbox":
            inner = [x for x in content.split("\n") if not x.startswith("<!-- textbox") and x != "<!-- /textbox -->"]
            paragraphs = "".join(doc.paragraph(x) for x in inner)
            body.append(f'<w:p><w:r><w:drawing><wp:inline xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"><wp:extent cx="914400" cy="914400"/><wps:wsp xmlns:wps="http://schemas.microsoft.com/office/word/2010/wordprocessingShape"><wps:txbx><w:txbxContent>{paragraphs}</w:txbxContent></wps:txbx></wps:wsp></wp:inline></w:drawing></w:r></w:p>')
        else:
            lines = [x for x in content.split("\n") if not _DEFINITION.match(x.strip())]
            if content and not lines:
                continue
            text = "\n".join(lines)
            item = _ITEM.match(text) if kind == "list" else None
            body.append(doc.paragraph(text[item.end() :], "ListBullet" if item[1] else "ListNumber") if item else doc.paragraph(text))
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in [("ListBullet", "List Bullet"), ("ListNumber", "List Number"), *((f"Heading{k}", f"Heading {k}") for k in range(1, 10))])
    rels = [f'<Relationship Id="rIdL{i + 1}" Type="{_REL}/hyperlink" Target={quoteattr(u)} TargetMode="External"/>' for i, u in enumerate(doc.links)]
    rels += [f'<Relationship Id="rIdM{i + 1}" Type="{_REL}/image" Target={quoteattr("media/" + n)}/>' for i, (n, _) in enumerate(media)]
    rels += [f'<Relationship Id="rIdS" Type="{_REL}/styles" Target="styles.xml"/>'] + ([f'<Relationship Id="rIdF" Type="{_REL}/footnotes" Target="footnotes.xml"/>'] if doc.used else [])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda n, x: z.writestr(zipfile.ZipInfo(n), x)  # noqa: E731  a fixed time, so equal blocks give equal files
        extensions = {n.rpartition(".")[2] for n, _ in media}
        put("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Default Extension="{e}" ContentType="image/{e}"/>' for e in sorted(extensions)) + '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/>' + ('<Override PartName="/word/footnotes.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.footnotes+xml"/>' if doc.used else "") + "</Types>")
        put("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="word/document.xml"/></Relationships>')
        put("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {_NS}><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>')
        put("word/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:styles {_NS}>{styles}</w:styles>')
        put("word/_rels/document.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(rels)}</Relationships>')
        if doc.used:
            each = "".join(f'<w:footnote w:id="{i + 1}"><w:p>{doc.run(" ")}{doc.emphasised(notes.get(n, ""))}</w:p></w:footnote>' for i, n in enumerate(doc.used))
            put("word/footnotes.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:footnotes {_NS}><w:footnote w:type="separator" w:id="-1"><w:p/></w:footnote>{each}</w:footnotes>')
        for name, data in media:
            put(f"word/media/{name}", data)
    return out.getvalue()


def build(blocks: DataFrame, author: str = "editor", date: str = "1970-01-01T00:00:00Z", key: str = "doc_id", notes: DataFrame | None = None) -> DataFrame:
    """key, docx (binary) from block rows; a column ``assets`` of maps isn't needed, ``asset`` bytes of image rows are taken.

    ``notes`` (key, note_id, content) are the note definitions, which aren't blocks of a parsed content.
    """
    asset = F.col("asset") if "asset" in blocks.columns else F.lit(None).cast("binary")
    kept = "array<struct<type:string,author:string,date:string,deleted_text:string>>"
    change = lambda t: F.struct(t["type"].alias("type"), t["author"].alias("author"), t["date"].alias("date"), t["deleted_text"].alias("deleted_text"))
    changes = F.transform("track_changes", change).cast(kept) if "track_changes" in blocks.columns else F.lit(None).cast(kept)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "type", "content", "level", "image_path", "asset", "track_changes")))
    rows = blocks.select(key, "pos", "type", "content", F.col("level").cast("int").alias("level"), "image_path", asset.alias("asset"), changes.alias("track_changes"))
    if notes is not None:
        line = F.concat(F.lit("[^"), F.col("note_id").cast("string"), F.lit("]: "), F.col("content"))
        empty = lambda t: F.lit(None).cast(t)
        rows = rows.unionByName(notes.select(key, F.lit(2147483647).alias("pos"), F.lit("paragraph").alias("type"), line.alias("content"), empty("int").alias("level"), empty("string").alias("image_path"), empty("binary").alias("asset"), empty(kept).alias("track_changes")))
    docs = rows.groupBy(key).agg(ordered.alias("rows"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = []
            for rows in batch.column("rows").to_pylist():
                assets = {(r["image_path"] or "").removeprefix("assets/"): r["asset"] for r in rows if r["asset"] is not None}
                made.append(document(rows, author, date, assets))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(made, pa.binary())], names=[key, "docx"])

    return docs.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, docx binary")
