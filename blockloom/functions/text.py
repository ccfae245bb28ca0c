"""Markdown and CriticMarkup as Spark column expressions; none of them needs Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockloom.functions import constants as K

FOOTNOTE_DEF = r"^\[\^(\d+)\]:\s*(.+)$"
FOOTNOTE_REF = r"\[\^(\d+)\]"
LINK = r"(?d)\[((?:[^\]\\]|\\.)*)\]\(([^)]+)\)"
INSERTION = r"(?d)\{\+\+(.+?)\+\+\}"
DELETION = r"(?d)\{--(.+?)--\}"
SUBSTITUTION = r"(?d)\{~~(.+?)~>(.+?)~~\}"
CRITIC = rf"{INSERTION}|{DELETION.removeprefix('(?d)')}|{SUBSTITUTION.removeprefix('(?d)')}"
CELL_EMPHASIS = r"(?d)\*\*.+?\*\*|\*[^*]+?\*"
EMPHASIS = r"(?d)(\*{1,3})(.*?)\1"
COLUMN_BREAK = "<!-- column-break -->"
_SPACES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    """White space of any kind is taken off both ends."""
    return F.regexp_replace(c, _SPACES, "")


def after(c: Column, n: int) -> Column:
    """All but the first n characters."""
    return F.substring(c, n + 1, 2147483647)


def wrap_formatting(text: Column, bold: Column, italic: Column) -> Column:
    stars = F.repeat(F.lit("*"), bold.cast("int") * 2 + italic.cast("int"))
    return F.concat(stars, text, stars)


def encode_url(url: Column) -> Column:
    """Spaces and round brackets only."""
    return F.replace(F.replace(F.replace(url, F.lit(" "), F.lit("%20")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def decode_url(url: Column) -> Column:
    """Percent signs are decoded, plus signs stay."""
    return F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))


def escape_link_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def unescape_link_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\["), F.lit("[")), F.lit("\\]"), F.lit("]"))


def link(text: Column, url: Column, bold: Column, italic: Column) -> Column:
    """``[text](url)`` with the emphasis inside the brackets."""
    return F.concat(F.lit("["), wrap_formatting(escape_link_text(text), bold, italic), F.lit("]("), encode_url(url), F.lit(")"))


def links(text: Column) -> Column:
    """array of struct(text, url) of the links in a text, the text still escaped."""
    made = F.arrays_zip(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)).alias("text"), F.regexp_extract_all(text, F.lit(LINK), F.lit(2)).alias("url"))
    return F.when(F.contains(text, F.lit("](")), made).otherwise(F.array().cast("array<struct<text:string,url:string>>"))


def link_formatting(text: Column) -> Column:
    """struct(text, bold, italic) of a link's text; the outermost pair of markers decides."""
    n = F.length(text)
    out = F.struct(text.alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"))
    for width in (1, 2, 3):
        for mark in ("_", "*"):
            marks = mark * width
            inner = F.substring(text, F.lit(width + 1), n - 2 * width)
            hit = text.startswith(marks) & text.endswith(marks) & (n > 2 * width)
            out = F.when(hit, F.struct(inner.alias("text"), F.lit(width >= 2).alias("bold"), F.lit(width != 2).alias("italic"))).otherwise(out)
    return F.struct(unescape_link_text(out["text"]).alias("text"), out["bold"].alias("bold"), out["italic"].alias("italic"))


def emphasis(text: Column) -> Column:
    """array of struct(stars, text) of the emphasised runs."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(EMPHASIS), F.lit(1)).alias("stars"), F.regexp_extract_all(text, F.lit(EMPHASIS), F.lit(2)).alias("text"))


def is_table_row(s: Column) -> Column:
    return s.startswith("|") & s.endswith("|")


def is_table_separator(s: Column) -> Column:
    """A row whose cells are empty, or dashes with colons around them."""
    inner = F.substring(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0)))
    cells = F.transform(F.split(inner, "[|]", -1), strip)
    return is_table_row(s) & F.forall(cells, lambda c: (c == "") | c.rlike("^:*-+:*$"))


def row_cells(line: Column) -> Column:
    """Cells of a table row: one outer pipe is dropped at each end, then escaped pipes belong to their cell."""
    s = strip(line)
    s = F.when(s.startswith("|"), after(s, 1)).otherwise(s)
    s = F.when(s.endswith("|"), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)
    held = F.replace(s, F.lit("\\|"), F.lit("\x01"))
    return F.transform(F.split(held, "[|]", -1), lambda c: strip(F.replace(c, F.lit("\x01"), F.lit("|"))))


def alignments(separator: Column) -> Column:
    """left, center or right of the separator's non-empty cells."""
    cells = F.filter(row_cells(separator), lambda c: c != "")
    return F.transform(cells, lambda c: F.when(c.startswith(":") & c.endswith(":"), F.lit("center")).when(c.endswith(":"), F.lit("right")).otherwise(F.lit("left")))


def alignment_separator(alignment: Column) -> Column:
    return F.when(alignment == "center", ":---:").when(alignment == "right", "---:").otherwise("---")


def escape_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def has_criticmarkup(text: Column) -> Column:
    return text.rlike(CRITIC)


def has_links(text: Column) -> Column:
    return text.rlike(LINK)


def has_footnote_refs(text: Column) -> Column:
    return text.rlike(FOOTNOTE_REF)


def accept_changes(text: Column) -> Column:
    """Insertions stay, deletions go, substitutions become their new text."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SUBSTITUTION, "$2"), DELETION, ""), INSERTION, "$1")


def reject_changes(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SUBSTITUTION, "$1"), INSERTION, ""), DELETION, "$1")


def critic_segments(text: Column) -> Column:
    """array of struct(kind, text) for CriticMarkup that isn't nested: text between marks, insertions, deletions.

    Substitutions give a deletion and an insertion. Nested marks need :func:`blockloom.functions.inline.critic_segments`.
    """
    kind = "array<struct<kind:string,text:string>>"
    gaps, marks = F.split(text, CRITIC, -1), F.regexp_extract_all(text, F.lit(CRITIC), F.lit(0))
    part = lambda k, t: F.struct(F.lit(k).alias("kind"), t.alias("text"))
    inner = lambda m: F.substring(m, F.lit(4), F.length(m) - 6)
    def made(x: Column) -> Column:
        m, body = x["m"], inner(x["m"])
        both = F.array(part("deletion", F.substring_index(body, "~>", 1)), part("insertion", F.substring(body, F.locate("~>", body) + 2, F.length(body))))
        change = F.when(m.startswith("{++"), F.array(part("insertion", body))).when(m.startswith("{--"), F.array(part("deletion", body))).otherwise(both)
        return F.concat(F.when(x["g"] != "", F.array(part("text", x["g"]))).otherwise(F.array().cast(kind)), F.when(m.isNotNull(), change).otherwise(F.array().cast(kind)))
    found = F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), marks.alias("m")), made))
    return F.when(~F.contains(text, F.lit("{")) | (text == ""), F.array(part("text", text))).otherwise(found)


def critic_errors(line: Column) -> Column:
    """Error kinds of one line: unclosed insertions, deletions and substitutions, substitutions without ``~>``."""
    opens = lambda mark: F.regexp_count(line, F.lit(mark))
    unclosed = [F.when(opens(a) > opens(z), F.lit(f"unclosed {name}")) for name, a, z in (("insertion", r"\{\+\+", r"\+\+\}"), ("deletion", r"\{--", r"--\}"), ("substitution", r"\{~~", r"~~\}"))]
    # no "~" can lie inside such a mark, so each match lacks the separator
    malformed = F.transform(F.regexp_extract_all(line, F.lit(r"\{~~([^~]*)~~\}"), F.lit(1)), lambda _: F.lit("malformed substitution"))
    return F.concat(F.array_compact(F.array(*unclosed)), malformed)


def render_kind(kind: Column, content: Column) -> Column:
    """Which single inline rule a block's text is rendered by."""
    plain = F.when(has_criticmarkup(content), "critic").when(has_footnote_refs(content), "footnote").when(has_links(content), "link").otherwise("plain")
    with_break = F.when(F.contains(content, F.lit(COLUMN_BREAK)), "column-break").otherwise(plain)
    return F.when(kind == "heading", plain).when(kind == "paragraph", with_break).otherwise(kind)


def cell_kind(text: Column) -> Column:
    return F.when(has_criticmarkup(text), "critic").when(has_links(text), "link").when(text.rlike(CELL_EMPHASIS), "emphasis").otherwise("plain")


def column_parts(text: Column) -> Column:
    """The stripped parts between column breaks."""
    return F.transform(F.split(text, COLUMN_BREAK, -1), strip)


def textbox_inner(content: Column) -> Column:
    """A text box without its marker lines."""
    inner = F.filter(F.split(content, "\n", -1), lambda s: ~s.startswith("<!-- textbox") & (s != "<!-- /textbox -->"))
    return F.array_join(inner, "\n")


def preview(content: Column) -> Column:
    return F.concat(F.substring(content, 1, K.PREVIEW_LENGTH), F.when(F.length(content) > K.PREVIEW_LENGTH, "...").otherwise(""))


def block_description(kind: Column, level: Column) -> Column:
    return F.when(F.coalesce(level, F.lit(0)) != 0, F.concat(kind, F.lit(" (level "), level.cast("string"), F.lit(")"))).otherwise(kind)


def with_extension(path: Column, extension: str) -> Column:
    """The path with its suffix replaced by an extension, which starts with a dot."""
    return F.when(path.endswith(extension), path).otherwise(F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(extension)))


def safe_path(name: Column) -> Column:
    """Whether a relative name stays in its folder at every step's end: not absolute, no more ``..`` than folders at the end."""
    parts = F.filter(F.split(name, "/", -1), lambda p: (p != "") & (p != "."))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("above"))
    # names below the base after leaving it could only come back under the base's own unknown name, which counts as unsafe
    walked = F.aggregate(parts, start, lambda a, p: F.struct(F.when(p == "..", a["depth"] - 1).otherwise(a["depth"] + 1).alias("depth"), F.least(a["above"], F.when(p == "..", a["depth"] - 1).otherwise(a["depth"])).alias("above")))
    return ~name.startswith("/") & (walked["above"] >= 0)


def sanitized_part(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9/._\[\]-]", "_")


def image_extension(name: Column) -> Column:
    """At most ten alphanumeric characters after the last dot; ``bin`` without any."""
    kept = F.substring(F.regexp_replace(F.regexp_extract(name, r"\.([^.]*)$", 1), "[^a-zA-Z0-9]", ""), 1, 10)
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("bin"))


def image_problem(data: Column, extension: Column) -> Column:
    """Null for an acceptable image, else why not: size, or a content that another format's signature starts."""
    head = F.hex(F.substring(data, 1, 12))
    found = (
        F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("474946"), "gif")
        .when(head.startswith("424D"), "bmp").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
        .when(head.startswith("D7CDC69A") | head.startswith("01000900") | head.startswith("02000900"), "wmf").when(head.startswith("01000000"), "emf")
    )
    wanted = F.when(F.lower(extension).isin("jpg", "jpeg"), "jpeg").when(F.lower(extension).isin("tif", "tiff"), "tiff").otherwise(F.lower(extension))
    return F.when(F.octet_length(data) > K.MAX_IMAGE_BYTES, "too large").when(found.isNull(), "unknown content").when(found != wanted, F.concat(F.lit("is "), found))
