"""Word files to flat element rows, with the standard library only. Rows leave it; structure is computed from them in Spark."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
WPS = "{http://schemas.microsoft.com/office/word/2010/wordprocessingShape}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
MAX_PART = 256 << 20
PIECE = "struct<kind:string,text:string,bold:boolean,italic:boolean,underline:boolean,url:string,author:string,date:string,rev:string,note:string,font:string,size:double>"
CELL = "struct<text:string,span:int,merge:string,align:string,fill:string,pattern:string,borders:map<string,struct<style:string,width:int,color:string>>>"
BOX = "struct<texts:array<string>,anchor_type:string,width:bigint,height:bigint,position_h:bigint,position_v:bigint,fill_color:string,border_color:string,drawing_xml:string>"
SECTION = "struct<column_count:int,column_spacing:int,equal_width:boolean,columns:array<struct<width:int,space:int>>>"
ELEMENTS_SCHEMA = (
    "path string, ord int, tag string, style string, align string, is_list boolean, "
    f"pieces array<{PIECE}>, image struct<ext:string,bytes:binary,chart:boolean,rel:string>, boxes array<{BOX}>, "
    f"cells array<array<{CELL}>>, merged array<struct<start_row:int,start_col:int,row_span:int,col_span:int>>, widths array<double>, table_style string, header_rows int, section {SECTION}, "
    "note struct<type:string,id:string,text:string>, variant string, page map<string,string>, error string"
)


class Package:
    """Parts of one Word file; XML with a document type is refused."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        if name not in self.names:
            return None
        if self.zip.getinfo(name).file_size > MAX_PART:
            raise ValueError(f"{name} is too large")
        data = self.zip.read(name)
        if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
            raise ValueError(f"{name} has a document type")
        return ET.fromstring(data)

    def targets(self, part: str) -> dict[str, tuple[str, bool]]:
        """Relationship id to (target, is external) of a part."""
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels")
        return {} if root is None else {r.get("Id"): (r.get("Target", ""), r.get("TargetMode") == "External") for r in root.iter(f"{RELS}Relationship")}

    def blob(self, part: str, target: str) -> bytes | None:
        name = posixpath.normpath(posixpath.join(posixpath.dirname(part), target)) if not target.startswith("/") else target[1:]
        return self.zip.read(name) if name in self.names else None


def _on(props: ET.Element | None, tag: str) -> bool:
    e = None if props is None else props.find(W + tag)
    return e is not None and (e.get(W + "val") or "1").lower() not in ("0", "false", "none")


def _integer(value: str | None, default: int | None = None) -> int | None:
    try:
        return default if value is None else int(value)
    except ValueError:
        return default


def _text(e: ET.Element, tag: str = "t") -> str:
    return "".join(t.text or "" for t in e.iter(W + tag))


def _run_text(run: ET.Element) -> str:
    out = []
    for c in run:
        if c.tag == W + "t":
            out.append(c.text or "")
        elif c.tag == W + "br":
            out.append("\n<!-- column-break -->\n" if c.get(W + "type") == "column" else "\n")
    return "".join(out)


def pieces(paragraph: ET.Element, rels: dict) -> list[dict]:
    """The paragraph's direct children that carry text: runs, insertions, deletions, links and note references."""
    out = []
    for e in paragraph:
        mark = {"author": e.get(W + "author", ""), "date": e.get(W + "date", ""), "rev": e.get(W + "id", "")}
        if e.tag == W + "ins":
            out.append({"kind": "ins", "text": _text(e), **mark})
        elif e.tag == W + "del":
            out.append({"kind": "del", "text": _text(e, "delText"), **mark})
        elif e.tag == W + "hyperlink":
            target, _ = rels.get(e.get(R + "id"), (None, None))
            props = [r.find(W + "rPr") for r in e.iter(W + "r")]
            out.append({"kind": "link", "text": _text(e), "url": target, "bold": any(_on(p, "b") for p in props), "italic": any(_on(p, "i") for p in props)})
        elif e.tag == W + "r":
            for name, kind in (("footnoteReference", "footnote"), ("endnoteReference", "endnote")):
                ref = e.find(W + name)
                if ref is not None:
                    if (_integer(ref.get(W + "id")) or 0) > 0:
                        out.append({"kind": kind, "text": "", "note": ref.get(W + "id")})
                    break
            else:
                p = e.find(W + "rPr")
                font = None if p is None or p.find(W + "rFonts") is None else p.find(W + "rFonts").get(W + "ascii")
                size = None if p is None or p.find(W + "sz") is None else (_integer(p.find(W + "sz").get(W + "val"), 0) or 0) / 2
                out.append({"kind": "run", "text": _run_text(e), "bold": _on(p, "b"), "italic": _on(p, "i"), "underline": _on(p, "u"), "font": font, "size": size})
    return [p for p in out if p["text"] or p["kind"] in ("footnote", "endnote")]


def _image(paragraph: ET.Element, package: Package, part: str, rels: dict) -> dict | None:
    chart = next(paragraph.iter(C + "chart"), None)
    blip = next(paragraph.iter(A + "blip"), None)
    if chart is None and blip is None:
        return None
    target, external = rels.get(None if blip is None else blip.get(R + "embed"), (None, True))
    data = None if target is None or external else package.blob(part, target)
    if chart is None and data is None:
        return None
    ext = "".join(c for c in (posixpath.splitext(target or "")[1][1:]) if c.isalnum() and c.isascii())[:10] or "bin"
    return {"ext": ext, "bytes": data, "chart": chart is not None, "rel": None if chart is None else chart.get(R + "id")}


def _boxes(paragraph: ET.Element) -> list[dict]:
    out = []
    fallbacks = {id(x) for f in paragraph.iter(MC + "Fallback") for x in f.iter()}
    for drawing in paragraph.iter(W + "drawing"):
        if id(drawing) in fallbacks:
            continue
        for holder in drawing:
            for box in holder.iter(WPS + "wsp"):
                content = next(box.iter(W + "txbxContent"), None)
                if content is None:
                    continue
                extent, props = holder.find(WP + "extent"), box.find(WPS + "spPr")
                offset = lambda a, h=holder: _integer(next((o.text for p in h.iter(WP + a) for o in p.iter(WP + "posOffset")), None))
                color = lambda path, p=props: None if p is None or p.find(path) is None else p.find(path).get("val")
                size = (lambda k, e=extent: 0 if e is None else _integer(e.get(k), 0))
                out.append({
                    "texts": [_text(p) for p in content.iter(W + "p")], "anchor_type": holder.tag.rpartition("}")[2], "width": size("cx"), "height": size("cy"),
                    "position_h": offset("positionH"), "position_v": offset("positionV"), "fill_color": color(f"{A}solidFill/{A}srgbClr"),
                    "border_color": color(f"{A}ln/{A}solidFill/{A}srgbClr"), "drawing_xml": ET.tostring(drawing, encoding="unicode"),
                })
    return out


def _emphasised(text: str, bold: bool, italic: bool) -> str:
    stars = "*" * (2 * bold + italic)
    return f"{stars}{text}{stars}"


def _cell_text(cell: ET.Element, rels: dict) -> str:
    rows = []
    for p in cell.findall(W + "p"):
        parts = []
        for x in pieces(p, rels):
            if x["kind"] == "link" and x["url"] is not None:
                inner = _emphasised(x["text"].replace("[", "\\[").replace("]", "\\]"), x["bold"], x["italic"])
                parts.append(f"[{inner}]({x['url'].replace(' ', '%20').replace('(', '%28').replace(')', '%29')})")
            elif x["kind"] in ("link", "run"):
                parts.append(_emphasised(x["text"].replace("\n", ""), x["bold"], x["italic"]))
        if parts:
            rows.append("".join(parts))
    return " ".join(rows).strip().replace("|", "\\|").replace("\n", " ")


def _borders(props: ET.Element | None) -> dict:
    found = None if props is None else props.find(W + "tcBorders")
    out = {}
    for e in () if found is None else found:
        style = e.get(W + "val")
        if style and style != "nil":
            out[e.tag.rpartition("}")[2]] = {"style": style, "width": _integer(e.get(W + "sz"), 0), "color": e.get(W + "color")}
    return out


def _merged(rows: list[list[dict]]) -> list[dict]:
    """Cells over more than one row or column, by their first row and column; the cells they continue into get their text."""
    found, above = [], {}
    for r, cells in enumerate(rows):
        at, now = 0, {}
        for c in cells:
            origin = above.get(at) if c["merge"] == "continue" else None
            if origin is not None:
                origin["row_span"] += 1
                c["text"] = origin["text"]
            elif c["merge"] is not None or c["span"] > 1:
                origin = {"start_row": r, "start_col": at, "row_span": 1, "col_span": c["span"], "text": c["text"]}
                found.append(origin)
            if origin is not None and c["merge"] is not None:
                now[at] = origin
            at += c["span"]
        above = now
    return [{k: v for k, v in x.items() if k != "text"} for x in found if x["row_span"] > 1 or x["col_span"] > 1]


def _table(table: ET.Element, rels: dict) -> dict:
    rows, header = [], 0
    counting = True
    for tr in table.findall(W + "tr"):
        counting = counting and tr.find(f"{W}trPr/{W}tblHeader") is not None
        header += counting
        cells = []
        for tc in tr.findall(W + "tc"):
            p = tc.find(W + "tcPr")
            get = lambda tag, p=p: None if p is None else p.find(W + tag)
            merge, span, shade = get("vMerge"), get("gridSpan"), get("shd")
            jc = tc.find(f"{W}p/{W}pPr/{W}jc")
            fill = None if shade is None or shade.get(W + "fill", "auto").lower() == "auto" else shade.get(W + "fill").upper()
            pattern = None if shade is None or shade.get(W + "val") in (None, "clear", "nil", "solid") else shade.get(W + "val")
            align = {"center": "center", "right": "right", "end": "right"}.get(None if jc is None else jc.get(W + "val"), "left")
            cells.append({"text": _cell_text(tc, rels), "span": 1 if span is None else _integer(span.get(W + "val"), 1), "merge": None if merge is None else merge.get(W + "val", "continue"), "align": align, "fill": fill, "pattern": pattern, "borders": _borders(p)})
        rows.append(cells)
    merged = _merged(rows)
    style = table.find(f"{W}tblPr/{W}tblStyle")
    widths = [round((_integer(g.get(W + "w"), 1440) or 1440) / 1440, 2) for g in table.iter(W + "gridCol")]
    return {"cells": rows, "merged": merged, "widths": widths, "table_style": None if style is None else style.get(W + "val"), "header_rows": max(1, header)}


def _section(e: ET.Element) -> dict:
    cols = e.find(W + "cols")
    if cols is None:
        return {"column_count": 1, "column_spacing": None, "equal_width": True, "columns": None}
    equal = cols.get(W + "equalWidth") != "0"
    each = [{"width": _integer(c.get(W + "w"), 0) or 0, "space": _integer(c.get(W + "space"))} for c in cols.findall(W + "col")]
    return {"column_count": _integer(cols.get(W + "num"), 1) or 1, "column_spacing": _integer(cols.get(W + "space")), "equal_width": equal, "columns": each or None if not equal else None}


PAGE = {"pgSz": ("w", "h", "orient"), "pgMar": ("top", "bottom", "left", "right", "header", "footer", "gutter")}


def elements(path: str, data: bytes) -> Iterator[dict]:
    """Rows of ELEMENTS_SCHEMA: body elements in order, then notes, then header and footer paragraphs; one error row if unreadable."""
    try:
        package = Package(data)
        part = "word/document.xml"
        body = package.xml(part).find(W + "body")
        rels = package.targets(part)
        styles = package.xml("word/styles.xml")
        names = {} if styles is None else {s.get(W + "styleId"): (s.find(W + "name").get(W + "val") if s.find(W + "name") is not None else s.get(W + "styleId")) for s in styles.iter(W + "style")}
        names = {k: "Heading" + v[7:] if v.lower().startswith("heading") else v for k, v in names.items()}
        found, variants = [], {}
        for e in body:
            tag = e.tag.rpartition("}")[2]
            row = {"tag": tag}
            if tag == "p":
                p = e.find(W + "pPr")
                style = None if p is None else p.find(W + "pStyle")
                jc = None if p is None else p.find(W + "jc")
                name = "Normal" if style is None else names.get(style.get(W + "val"), style.get(W + "val"))
                section = None if p is None else p.find(W + "sectPr")
                row |= {"style": name, "align": "left" if jc is None else {"both": "justify", "end": "right", "start": "left"}.get(jc.get(W + "val"), jc.get(W + "val")), "is_list": p is not None and p.find(W + "numPr") is not None}
                row |= {"boxes": _boxes(e), "section": None if section is None else _section(section)}
                if not row["boxes"]:
                    row["image"] = _image(e, package, part, rels)
                    row["pieces"] = pieces(e, rels)
                sections = [section] if section is not None else []
            elif tag == "tbl":
                row |= _table(e, rels)
                sections = []
            elif tag == "sectPr":
                row["section"] = _section(e)
                row["page"] = {a: v.get(W + a) for t, names_ in PAGE.items() for v in e.findall(W + t) for a in names_ if v.get(W + a) is not None}
                sections = [e]
            else:
                continue
            for s in sections:
                for kind in ("header", "footer"):
                    for ref in s.findall(f"{W}{kind}Reference"):
                        variants[f"{kind}_{ref.get(W + 'type', 'default')}"] = ref.get(R + "id")
            found.append(row)
        for file, kind in (("footnotes", "footnote"), ("endnotes", "endnote")):
            root = package.xml(f"word/{file}.xml")
            for n in () if root is None else root.findall(W + kind):
                if n.get(W + "type") in (None, "normal"):
                    text = "".join(_emphasised(x["text"], x.get("bold", False), x.get("italic", False)) for p in n.findall(W + "p") for x in pieces(p, {}) if x["kind"] == "run")
                    found.append({"tag": "note", "note": {"type": kind, "id": n.get(W + "id"), "text": text.removeprefix(" ")}})
        for variant, rel in variants.items():
            target, external = rels.get(rel, (None, True))
            root = None if target is None or external else package.xml(f"word/{target}")
            for p in () if root is None else root.iter(W + "p"):
                image = _image(p, package, f"word/{target}", package.targets(f"word/{target}"))
                if image or _text(p).strip():
                    found.append({"tag": "hf", "variant": variant, "pieces": [{"kind": "run", "text": _text(p)}], "image": image})
        for i, row in enumerate(found):
            yield {"path": path, "ord": i, **row}
    except (zipfile.BadZipFile, ET.ParseError, ValueError, KeyError, AttributeError) as e:
        yield {"path": path, "ord": 0, "tag": "error", "error": f"{type(e).__name__}: {e}"[:150]}
