"""The registered queries over the document operators, each with its DuckDB SQL where SQL can say it.

Whole numbers come out as bigint and real ones rounded to six places, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import constants as K
from blockloom.functions import inline
from blockloom.functions import text as T
from blockloom.operators import match, parse, report, score, validate
from blockloom.plans import corpora as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    kinds = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.select(*(F.round(F.col(c).cast("double"), 6).alias(c) if kinds.get(t, t) == "double" else F.col(c).cast(kinds.get(t, t)).alias(c) for c, t in df.dtypes))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: _plain(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_blocks(C.markdown(spark, sf_dir))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    content = C.markdown(spark, sf_dir)
    return parse.parse_blocks(content), parse.parse_blocks(C.edited(content))


@query(f"with {C.BLOCKS_SQL} select doc_id, version, pos, block_id, type, content, content_start, content_end, content_hash, level, image_path from blocks")
def parse_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).drop("docx_paragraph_index", "table_metadata")


@query(f"with {C.BLOCKS_SQL} select type, count(*) as n, sum(length(content))::bigint as chars from blocks group by type")
def block_type_counts(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query(f"with {C.BLOCKS_SQL} select doc_id, count(*) as n, max(content_end)::bigint as total, sum(content_start)::bigint as starts from blocks group by doc_id")
def block_offsets(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("content_end").alias("total"), F.sum("content_start").alias("starts"))


@query(f"with {C.BLOCKS_SQL} select doc_id, pos, level, trim(regexp_replace(content, '^#+', '')) as title from blocks where type = 'heading'")
def heading_outline(spark, sf_dir):
    return _blocks(spark, sf_dir).where("type = 'heading'").select("doc_id", "pos", "level", T.strip(F.regexp_replace("content", "^#+", "")).alias("title"))


@query(f"with {C.BLOCKS_SQL} select level, count(*) as n from blocks where type = 'heading' group by level")
def heading_levels(spark, sf_dir):
    return _blocks(spark, sf_dir).where("type = 'heading'").groupBy("level").agg(F.count("*").alias("n"))


@query(f"with {C.BLOCKS_SQL} select type, image_path, count(*) as n from blocks where type in ('image', 'chart') group by type, image_path")
def image_chart_split(spark, sf_dir):
    return _blocks(spark, sf_dir).where("type in ('image', 'chart')").groupBy("type", "image_path").agg(F.count("*").alias("n"))


_INDEX = "coalesce(sum((type = 'table')::int) over (partition by doc_id, version order by pos rows between unbounded preceding and 1 preceding), 0)::bigint"


@query(f"with {C.BLOCKS_SQL} select * from (select doc_id, pos, type, n_lines - 1 as n_rows, {_INDEX} as table_index, case when type = 'table' then -1 else pos end as paragraph_index from blocks) where type = 'table'")
def gfm_tables_found(spark, sf_dir):
    t = F.col("table_metadata")
    return _blocks(spark, sf_dir).where("type = 'table'").select("doc_id", "pos", "type", t["rows"].alias("n_rows"), t["docx_table_index"].alias("table_index"), F.col("docx_paragraph_index").alias("paragraph_index"))


_CELLS = """tl as (select doc_id, version, pos, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as i from blocks where type = 'table'),
tr as (select *, list_transform(string_split(replace(substr(line, 2, length(line) - 2), '\\|', chr(1)), '|'), lambda c: trim(replace(c, chr(1), '|'))) as cells,
  row_number() over (partition by doc_id, version, pos order by i) - 1 as r from tl where not regexp_matches(line, '^\\|[ :|-]*-[ :|-]*\\|$')),
tw as (select *, max(case when r = 0 then len(cells) end) over (partition by doc_id, version, pos) as width from tr),
tc as (select doc_id, version, pos, r, unnest(range(width)) as c, cells from tw)"""


@query(f"with {C.BLOCKS_SQL}, {_CELLS} select doc_id, pos, r as \"row\", c as col, coalesce(cells[c + 1], '') as text, case c when 1 then 'right' else 'left' end as align from tc")
def gfm_cells(spark, sf_dir):
    return parse.table_cells(_blocks(spark, sf_dir)).select("doc_id", "pos", "row", "col", "text", "align")


@query(f"with {C.NATIONS_SQL}, {C.blocks_sql('grid', 'blocks')} select doc_id, n_lines - 1 as n_rows, 2::bigint as n_cols, 'center,right' as aligns from blocks")
def gfm_alignments(spark, sf_dir):
    t = F.col("table_metadata")
    return parse.parse_blocks(C.nations(spark, sf_dir)).select("doc_id", t["rows"].alias("n_rows"), t["cols"].alias("n_cols"), F.array_join(t["column_alignments"], ",").alias("aligns"))


@query(f"with {C.BLOCKS_SQL}, {_CELLS} select doc_id, pos, count(*) as n, count(*) filter (coalesce(cells[c + 1], '') = '') as blank from tc group by doc_id, pos")
def gfm_pad_truncate(spark, sf_dir):
    return parse.table_cells(_blocks(spark, sf_dir)).groupBy("doc_id", "pos").agg(F.count("*").alias("n"), F.count_if(F.col("text") == "").alias("blank"))


@query(f"with {C.BLOCKS_SQL} select doc_id, pos, content, content_start from blocks where type = 'textbox'")
def textbox_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).where("type = 'textbox'").select("doc_id", "pos", "content", "content_start")


@query(f"with {C.BLOCKS_SQL} select doc_id, array_to_string(list_filter(string_split(content, chr(10)), lambda s: not starts_with(s, '<!-- textbox') and s <> '<!-- /textbox -->'), chr(10)) as inner_text from blocks where type = 'textbox'")
def textbox_inner(spark, sf_dir):
    return _blocks(spark, sf_dir).where("type = 'textbox'").select("doc_id", T.textbox_inner(F.col("content")).alias("inner_text"))


@query(f"with {C.BLOCKS_SQL}, p as (select doc_id, string_split(content, '<!-- column-break -->') as parts from blocks where contains(content, '<!-- column-break -->')) select doc_id, unnest(list_transform(parts, lambda x: trim(x))) as part, generate_subscripts(parts, 1) - 1 as ord from p")
def column_breaks(spark, sf_dir):
    broken = _blocks(spark, sf_dir).where(F.contains("content", F.lit(T.COLUMN_BREAK)))
    return broken.select("doc_id", F.posexplode(T.column_parts(F.col("content"))).alias("ord", "part"))


_DEFS = "defs as (select doc_id, version, regexp_extract(s, '^\\[\\^(\\d+)\\]:\\s*(.+)$', 1)::bigint as note_id, max_by(regexp_extract(s, '^\\[\\^(\\d+)\\]:\\s*(.+)$', 2), line_no) as note from content_lines where regexp_matches(s, '^\\[\\^\\d+\\]:\\s*.+$') group by all)"
_REFS = "refs as (select doc_id, version, pos, unnest(regexp_extract_all(content, '\\[\\^(\\d+)\\]', 1))::bigint as note_id, generate_subscripts(regexp_extract_all(content, '\\[\\^(\\d+)\\]', 1), 1) - 1 as ord from blocks)"


@query(f"with {C.BLOCKS_SQL}, {_DEFS} select doc_id, note_id, note from defs")
def footnote_defs(spark, sf_dir):
    return parse.footnote_definitions(C.markdown(spark, sf_dir)).select("doc_id", "note_id", F.col("content").alias("note"))


@query(f"with {C.BLOCKS_SQL}, {_DEFS}, {_REFS} select doc_id, pos, ord, note_id, coalesce(note, '') as note from refs left join defs using (doc_id, version, note_id)")
def footnote_refs_join(spark, sf_dir):
    content = C.markdown(spark, sf_dir)
    return parse.footnotes(parse.parse_blocks(content), content).select("doc_id", "pos", "ord", "note_id", F.col("content").alias("note"))


@query(f"with {C.BLOCKS_SQL}, {_REFS} select doc_id, pos, ord, note_id, row_number() over (partition by doc_id, version order by pos, ord) as number from refs")
def footnote_numbering(spark, sf_dir):
    return parse.footnote_numbers(parse.footnote_references(_blocks(spark, sf_dir))).drop("version")


_LINK = "\\[((?:[^\\]\\\\]|\\\\.)*)\\]\\(([^)]+)\\)"


@query(f"with {C.BLOCKS_SQL} select doc_id, pos, unnest(regexp_extract_all(content, '{_LINK}', 1)) as text, unnest(regexp_extract_all(content, '{_LINK}', 2)) as url from blocks where type = 'paragraph'")
def hyperlinks(spark, sf_dir):
    return _blocks(spark, sf_dir).where("type = 'paragraph'").select("doc_id", "pos", F.inline(T.links(F.col("content"))))


_MARKED = "case p_size % 4 when 0 then p_name when 1 then '*' || p_name || '*' when 2 then '**' || p_name || '**' else '***' || p_name || '***' end"


def _marked():
    turn = F.col("p_size") % 4
    return T.wrap_formatting(F.col("p_name"), turn.isin(2, 3), turn.isin(1, 3))


@query(f"select p_partkey, {_MARKED} as marked, p_name as text, p_size % 4 in (2, 3) as bold, p_size % 4 in (1, 3) as italic from part")
def link_format_parse(spark, sf_dir):
    marked = C.table(spark, sf_dir, "part").select("p_partkey", _marked().alias("marked"))
    return marked.select("p_partkey", "marked", T.link_formatting(F.col("marked"))["text"].alias("text"), T.link_formatting(F.col("marked"))["bold"].alias("bold"), T.link_formatting(F.col("marked"))["italic"].alias("italic"))


@query("select p_partkey, '[' || replace(replace(p_name || '[' || p_brand || ']', '[', '\\['), ']', '\\]') || '](https://x/' || p_partkey || '%20%28v%29)' as link, 'https://x/' || p_partkey || ' (v)' as url from part")
def url_encode(spark, sf_dir):
    url = F.concat(F.lit("https://x/"), F.col("p_partkey").cast("string"), F.lit(" (v)"))
    text = F.concat("p_name", F.lit("["), "p_brand", F.lit("]"))
    made = C.table(spark, sf_dir, "part").select("p_partkey", T.link(text, url, F.lit(False), F.lit(False)).alias("link"), T.encode_url(url).alias("encoded"))
    return made.select("p_partkey", "link", T.decode_url(F.col("encoded")).alias("url"))


@query(f"""with {C.CRITIC_SQL} select doc_id, pos, 0::bigint as ord, 'text' as kind, 'row ' as text from critic
union all select doc_id, pos, 1, case l_returnflag when 'A' then 'insertion' else 'deletion' end, l_linestatus from critic
union all select doc_id, pos, 2, 'insertion', pos::varchar from critic where l_returnflag = 'N'
union all select doc_id, pos, case l_returnflag when 'N' then 3 else 2 end, 'text', case l_returnflag when 'R' then ' gone' when 'A' then ' new' else ' end' end from critic""")
def critic_segments(spark, sf_dir):
    rows = C.critic(spark, sf_dir).select("doc_id", "pos", F.posexplode(T.critic_segments(F.col("content"))).alias("ord", "x"))
    return rows.select("doc_id", "pos", "ord", "x.kind", "x.text")


@query(f"with {C.CRITIC_SQL} select doc_id, pos, 'row ' || case l_returnflag when 'R' then ' gone' when 'A' then l_linestatus || ' new' else pos || ' end' end as accepted from critic")
def critic_accept_all(spark, sf_dir):
    return C.critic(spark, sf_dir).select("doc_id", "pos", T.accept_changes(F.col("content")).alias("accepted"))


@query(f"with {C.CRITIC_SQL} select doc_id, pos, 'row ' || case l_returnflag when 'R' then l_linestatus || ' gone' when 'A' then ' new' else l_linestatus || ' end' end as rejected from critic")
def critic_reject_all(spark, sf_dir):
    return C.critic(spark, sf_dir).select("doc_id", "pos", T.reject_changes(F.col("content")).alias("rejected"))


@query(f"with {C.CRITIC_SQL} select doc_id, pos as line, case l_returnflag when 'R' then 'unclosed deletion' when 'A' then 'unclosed insertion' else 'malformed substitution' end as error from critic")
def critic_validate(spark, sf_dir):
    """Each mark is broken first: closing marks lose a brace, substitutions their separator."""
    content = F.col("content")
    broken = F.when(F.col("l_returnflag") == "N", F.replace(content, F.lit("~>"), F.lit("-"))).otherwise(F.regexp_replace(content, r"(--|\+\+)\}", "$1"))
    rows = C.critic(spark, sf_dir).select("doc_id", "pos", broken.alias("raw"))
    return rows.select("doc_id", F.col("pos").alias("line"), F.explode(T.critic_errors(F.col("raw"))).alias("error"))


@query(f"""with {C.BLOCKS_SQL} select render_kind, count(*) as n from (select case when type not in ('heading', 'paragraph') then type
  when type = 'paragraph' and contains(content, '<!-- column-break -->') then 'column-break'
  when regexp_matches(content, '\\{{\\+\\+.+?\\+\\+\\}}|\\{{--.+?--\\}}|\\{{~~.+?~>.+?~~\\}}') then 'critic'
  when regexp_matches(content, '\\[\\^\\d+\\]') then 'footnote' when regexp_matches(content, '{_LINK}') then 'link' else 'plain' end as render_kind from blocks) group by render_kind""")
def render_kind(spark, sf_dir):
    kinds = _blocks(spark, sf_dir).select(T.render_kind(F.col("type"), F.col("content")).alias("render_kind"))
    return kinds.groupBy("render_kind").agg(F.count("*").alias("n"))


@query("select doc_id, sha256(text) as content_hash, substr(sha256(text), 1, 16) as short_hash from documents")
def content_hash(spark, sf_dir):
    h = F.sha2("text", 256)
    return C.table(spark, sf_dir, "documents").select("doc_id", h.alias("content_hash"), F.substring(h, 1, K.HASH_PREFIX_LENGTH).alias("short_hash"))


@query(f"with {C.BLOCKS_SQL} select content_hash, count(*) as n, count(distinct doc_id) as n_docs from blocks group by content_hash having count(*) > 1")
def duplicate_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("content_hash").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).where("n > 1")


@query(f"with {C.MATCHED_SQL} select doc_id, old_pos, new_pos from m")
def match_hash_pass(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return match.match_unchanged(old, new).select("doc_id", "old_pos", "new_pos")


_REST = "r as (select doc_id, pos, block_id, type, content from blocks where (doc_id, pos) not in (select doc_id, old_pos from m)), a as (select doc_id, pos, block_id, type, content from blocks2 where (doc_id, pos) not in (select doc_id, new_pos from m))"


@query(f"with {C.MATCHED_SQL}, {_REST} select doc_id, 'unchanged' as change, count(*) as n from m group by doc_id union all select doc_id, 'removed', count(*) from r group by doc_id union all select doc_id, 'added', count(*) from a group by doc_id")
def diff_summary_compat(spark, sf_dir):
    """As the command line counts: old contents are unknown to it, so every edit is a removal and an addition."""
    old, new = _versions(spark, sf_dir)
    changes = match.diff(old, new, match.match_unchanged(old, new))
    return changes.groupBy("doc_id", "change").agg(F.count("*").alias("n"))


def _diff_rows(spark, sf_dir, change):
    old, new = _versions(spark, sf_dir)
    return match.diff(old, new, match.match_unchanged(old, new)).where(F.col("change") == change).select("doc_id", "pos", "type", T.preview(F.col("content")).alias("preview"))


_PREVIEW = "substr(content, 1, 50) || case when length(content) > 50 then '...' else '' end as preview"


@query(f"with {C.MATCHED_SQL}, {_REST} select doc_id, pos, type, {_PREVIEW} from a")
def diff_added(spark, sf_dir):
    return _diff_rows(spark, sf_dir, "added")


@query(f"with {C.MATCHED_SQL}, {_REST} select doc_id, pos, type, {_PREVIEW} from r")
def diff_removed(spark, sf_dir):
    return _diff_rows(spark, sf_dir, "removed")


@query(f"with {C.MATCHED_SQL} select m.doc_id, new_id as block_id, 'S' || (old_pos % 3) as docx_style from m")
def style_remap(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    styles = old.select("doc_id", "block_id", F.concat(F.lit("S"), (F.col("pos") % 3).cast("string")).alias("docx_style"))
    return match.remap_styles(styles, match.match_unchanged(old, new)).select("doc_id", "block_id", "docx_style")


@query(f"with {C.BOTH_SQL} select b.doc_id, b.pos, b.block_id, a.content_hash as carried from blocks2 b join blocks a on a.doc_id = b.doc_id and a.pos = b.pos")
def positional_zip(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return match.transfer(new.select("doc_id", "pos", "block_id"), old.select("doc_id", "pos", F.col("content_hash").alias("carried")), ["carried"])


@query(f"with {C.BLOCKS_SQL}, ends as (select doc_id, level - 1 as ord, pos as e from blocks where type = 'heading' qualify row_number() over (partition by doc_id order by pos desc) <= 1 or row_number() over (partition by doc_id order by pos) <= 1), s as (select doc_id, row_number() over (partition by doc_id order by e) - 1 as ord, coalesce(lag(e) over (partition by doc_id order by e) + 1, 0) as b, e from ends) select blocks.doc_id, pos, ord from blocks join s on s.doc_id = blocks.doc_id and pos between b and e")
def section_range_join(spark, sf_dir):
    """Sections that end at a document's first and last heading."""
    blocks = _blocks(spark, sf_dir)
    heads = blocks.where("type = 'heading'").groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.array(F.min("pos"), F.max("pos")))).alias("ends"))
    ends = heads.select("doc_id", F.posexplode("ends").alias("ord", "end_block_index"))
    return match.in_sections(blocks, match.section_ranges(ends)).select("doc_id", "pos", "ord")


@query("""with t as (select l_orderkey as doc_id, l_linenumber as i, l_linenumber * 10 as n, l_quantity::bigint as s, l_partkey % 50 as e, case when l_returnflag = 'R' then '' else l_returnflag end as author, case when l_linestatus = 'O' then null else 'd' end as d from lineitem)
select doc_id, 'block-' || i as block_id, w as warning from (select *, unnest([case when e > n then 'end exceeds block' end, case when s > e then 'start after end' end, case when author = '' then 'missing author' end, case when d is null then 'missing date' end]) as w from t) where w is not null""")
def track_change_warnings(spark, sf_dir):
    items = C.table(spark, sf_dir, "lineitem")
    change = F.struct(F.col("l_quantity").cast("int").alias("start"), (F.col("l_partkey") % 50).cast("int").alias("end"), F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag")).alias("author"), F.when(F.col("l_linestatus") != "O", "d").alias("date"))
    blocks = items.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("block-"), F.col("l_linenumber").cast("string")).alias("block_id"), F.lit(0).alias("content_start"), (F.col("l_linenumber") * 10).alias("content_end"), F.array(change).alias("track_changes"))
    return validate.track_changes(blocks).select("doc_id", "block_id", "warning")


@query(f"with {C.BLOCKS_SQL} select doc_id, block_id, unnest(case doc_id % 3 when 0 then ['missing table_formatting'] when 1 then ['row count mismatch', 'merged cell exceeds row bounds', 'no style entry'] else ['column count mismatch', 'merged cell exceeds column bounds', 'no style entry'] end) as warning from blocks where type = 'table'")
def table_warnings(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    third = F.col("doc_id") % 3
    span = F.struct(F.lit(0).alias("start_row"), F.lit(0).alias("start_col"), F.when(third == 1, 3).otherwise(1).cast("int").alias("row_span"), F.when(third == 2, 2).otherwise(1).cast("int").alias("col_span"))
    tables = blocks.where("type = 'table'")
    structure = tables.select("doc_id", "block_id", F.when(third == 1, 2).otherwise(F.col("table_metadata.rows")).alias("rows"), F.when(third == 2, 1).otherwise(F.col("table_metadata.cols")).alias("cols"), F.array(span).alias("merged_cells"))
    styles = tables.where(third == 0).select("doc_id", "block_id", F.lit(None).cast("string").alias("table_formatting"))
    return validate.tables(blocks, structure, styles)


@query("select o_custkey as doc_id, count(*) + 2 as n_lines, case when count(*) + 1 > 15 then 'rows' end as exceeds from orders group by o_custkey")
def dimension_limits(spark, sf_dir):
    """Tables with a row for each order of a customer, against a limit of fifteen rows."""
    rows = C.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.collect_list(F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" |"))).alias("r"))
    content = rows.select("doc_id", F.lit(1).cast("bigint").alias("version"), F.concat(F.lit("| k |\n|---|\n"), F.array_join("r", "\n")).alias("content_md"))
    blocks = parse.parse_blocks(content)
    return blocks.select("doc_id", F.size(F.split("content", "\n", -1)).alias("n_lines"), F.when(F.col("table_metadata.rows") > 15, "rows").alias("exceeds"))


_NAME = "case l_linenumber % 5 when 0 then '/etc/' || l_partkey when 1 then 'assets/' || l_partkey when 2 then 'a/../' || l_partkey when 3 then 'a/../../' || l_partkey else './' || l_partkey end"


@query(f"select l_orderkey, l_linenumber::bigint as l_linenumber, {_NAME} as name, l_linenumber % 5 in (1, 2, 4) as safe from lineitem")
def safe_paths(spark, sf_dir):
    turn, key = F.col("l_linenumber") % 5, F.col("l_partkey").cast("string")
    heads = {0: "/etc/", 1: "assets/", 2: "a/../", 3: "a/../../", 4: "./"}
    name = F.coalesce(*(F.when(turn == k, F.concat(F.lit(h), key)) for k, h in heads.items()))
    return C.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name")).withColumn("safe", T.safe_path(F.col("name")))


@query("select c_custkey as doc_id, case c_nationkey % 3 when 0 then 'manifest.json,structure.json' else case c_nationkey % 3 when 1 then 'styles.json' else 'content.md,manifest.json,structure.json,styles.json' end end as missing from customer")
def required_files(spark, sf_dir):
    third = F.col("c_nationkey") % 3
    files = F.when(third == 0, F.array(*map(F.lit, K.CORE_FILES))).when(third == 1, F.array(F.lit("content.md"))).otherwise(F.array().cast("array<string>"))
    boxes = C.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(third == 1, "directory").otherwise("zip").alias("format"), files.alias("files"))
    return validate.missing_files(boxes).select("doc_id", F.array_join("missing", ",").alias("missing"))


@query("select p_partkey, p_size::bigint as \"row\", case when p_size % 2 = 0 then 'pct5' end as pattern_fill, case when p_size % 3 = 0 then 'double' end as border_style, case when p_size * 3 <= 96 then p_size * 3 end::bigint as border_width, case when p_size % 5 <> 0 then '00aaFF' end as background_color from part where p_size < 40")
def whitelist_filters(spark, sf_dir):
    n = F.col("p_size")
    styles = C.table(spark, sf_dir, "part").select(
        F.concat(n.cast("string"), F.lit(","), F.col("p_partkey").cast("string")).alias("key"), F.when(n % 2 == 0, "pct5").otherwise("solid").alias("pattern_fill"),
        F.when(n % 3 == 0, "double").otherwise("zigzag").alias("border_style"), (n * 3).alias("border_width"), F.when(n % 5 != 0, "00aaFF").otherwise("00aaF").alias("background_color"), F.lit("000000").alias("border_color"),
    )
    return validate.kept_cell_styles(styles, rows=40, cols=1 << 30).select(F.col("col").cast("bigint").alias("p_partkey"), "row", "pattern_fill", "border_style", "border_width", "background_color")


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, round((1 - abs(l_partkey - l_suppkey)::double / greatest(l_partkey, l_suppkey, 1)) * 100, 6) as similarity from lineitem")
def count_similarity(spark, sf_dir):
    return C.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", score.count_similarity(F.col("l_partkey"), F.col("l_suppkey")).alias("similarity"))


_STRUCTURE = """counts as (select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.p, 0) as ap, coalesce(b.p, 0) as bp, coalesce(a.t, 0) as ta, coalesce(b.t, 0) as tb
  from (select doc_id, count(*) filter (type = 'paragraph') as p, count(*) filter (type = 'table') as t from blocks group by doc_id) a
  full join (select doc_id, count(*) filter (type = 'paragraph') as p, count(*) filter (type = 'table') as t from blocks2 group by doc_id) b on a.doc_id = b.doc_id),
h as (select coalesce(a.doc_id, b.doc_id) as doc_id, count(*) filter (a.level is not distinct from b.level) * 100.0::double / count(*) as share
  from (select doc_id, level, row_number() over (partition by doc_id order by pos) as i from blocks where type = 'heading') a
  full join (select doc_id, level, row_number() over (partition by doc_id order by pos) as i from blocks2 where type = 'heading') b on a.doc_id = b.doc_id and a.i = b.i group by 1),
structure as (select doc_id, 0.3::double * coalesce(share, 100) + 0.3::double * (1 - abs(ap - bp)::double / greatest(ap, bp, 1)) * 100 + 0.2::double * 100 + 0.2::double * (1 - abs(ta - tb)::double / greatest(ta, tb, 1)) * 100 as structure from counts left join h using (doc_id))"""


@query(f"with {C.BOTH_SQL}, {_STRUCTURE} select doc_id, round(structure, 6) as structure from structure")
def score_structure(spark, sf_dir):
    return score.score_structure(*_versions(spark, sf_dir))


def _link_rows(blocks: DataFrame) -> DataFrame:
    found = blocks.where("type = 'paragraph'").select("doc_id", F.col("pos").alias("at"), F.posexplode(T.links(F.col("content"))).alias("ord", "x"))
    return score.ranked(found.select("doc_id", F.struct("at", "ord").alias("at"), "x.text", "x.url"), "at")


_LINKS = ", ".join(
    f"links{n} as (select *, row_number() over (partition by doc_id order by pos, i) as k from (select doc_id, pos, unnest(regexp_extract_all(content, '{_LINK}', 1)) as text, unnest(regexp_extract_all(content, '{_LINK}', 2)) as url, generate_subscripts(regexp_extract_all(content, '{_LINK}', 1), 1) as i from blocks{n} where type = 'paragraph'))"
    for n in ("", "2")
)
_LINK_SCORE = "linked as (select coalesce(a.doc_id, b.doc_id) as doc_id, case when count(a.text) > 0 then count(*) filter (a.text is not distinct from b.text and a.url is not distinct from b.url) * 100.0::double / count(*) end as hyperlinks from links a full join links2 b on a.doc_id = b.doc_id and a.k = b.k group by 1)"


@query(f"with {C.BOTH_SQL}, {_LINKS}, {_LINK_SCORE} select doc_id, round(hyperlinks, 6) as hyperlinks from linked")
def score_hyperlinks(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return score.score_links(_link_rows(old), _link_rows(new))


def _changes(spark, sf_dir):
    rows = C.critic(spark, sf_dir).select("doc_id", "pos", F.col("l_linestatus").alias("author"), F.explode(T.critic_segments(F.col("content"))).alias("x"))
    return rows.select("doc_id", "pos", "author", F.col("x.kind").alias("kind")).where("kind <> 'text'")


_CHANGES = """ch as (select doc_id, pos, l_linestatus as author, unnest(case l_returnflag when 'A' then ['insertion'] when 'R' then ['deletion'] else ['deletion', 'insertion'] end) as kind from critic),
ca as (select doc_id, count(*) filter (kind = 'insertion') as i, count(*) filter (kind = 'deletion') as d, list(distinct author) as au from ch group by doc_id),
cb as (select doc_id, count(*) filter (kind = 'insertion') as i, count(*) filter (kind = 'deletion') as d, list(distinct author) as au from ch where pos % 2 = 1 group by doc_id),
tc as (select ca.doc_id, ((1 - abs(ca.i - coalesce(cb.i, 0))::double / greatest(ca.i, coalesce(cb.i, 0), 1)) + (1 - abs(ca.d - coalesce(cb.d, 0))::double / greatest(ca.d, coalesce(cb.d, 0), 1))
  + case when cb.au is null then 0 else len(list_intersect(ca.au, cb.au))::double / len(list_distinct(list_concat(ca.au, cb.au))) end) / 3 * 100 as track_changes from ca left join cb using (doc_id))"""


@query(f"with {C.CRITIC_SQL}, {_CHANGES} select doc_id, round(track_changes, 6) as track_changes from tc")
def score_track_changes(spark, sf_dir):
    """An order's changes against those of its odd lines."""
    changes = _changes(spark, sf_dir)
    return score.score_changes(changes, changes.where("pos % 2 = 1"))


@query(f"with {C.BOTH_SQL}, {_STRUCTURE}, {_LINKS}, {_LINK_SCORE} select doc_id, round(case when hyperlinks is null then structure else (structure + hyperlinks) / 2 end, 6) as total from structure left join linked using (doc_id)")
def score_total(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    both = score.score_structure(old, new).join(score.score_links(_link_rows(old), _link_rows(new)), "doc_id", "left")
    return both.select("doc_id", score.total(F.array("structure", "hyperlinks")).alias("total"))


_TOKENS = "tokens as (select pipeline, avg(prompt_tokens) as prompt, avg(completion_tokens) as completion, avg(prompt_tokens) + avg(completion_tokens) as total from results where coalesce(error, '') = '' group by pipeline)"


@query(f"with {C.RESULTS_SQL}, {_TOKENS} select pipeline, round(prompt, 6) as prompt, round(completion, 6) as completion, round(total, 6) as total from tokens")
def pipeline_tokens(spark, sf_dir):
    return report.pipeline_tokens(C.results(spark, sf_dir))


_DIMS = ["structure", "formatting", "tables", "hyperlinks", "track_changes", "total"]


@query(f"with {C.RESULTS_SQL} select pipeline, " + ", ".join(f"round(avg(case when prompt_tokens % {i + 2} = 0 then completion_tokens % 101 end), 6) as {d}" for i, d in enumerate(_DIMS)) + " from results group by pipeline")
def pipeline_fidelity(spark, sf_dir):
    scores = C.results(spark, sf_dir).select("pipeline", *(F.when(F.col("prompt_tokens") % (i + 2) == 0, F.col("completion_tokens") % 101).alias(d) for i, d in enumerate(_DIMS)))
    return report.pipeline_fidelity(scores)


@query(f"with {C.RESULTS_SQL}, {_TOKENS} select pipeline, round(total, 6) as total from tokens order by tokens.total, pipeline limit 1")
def best_pipeline(spark, sf_dir):
    return report.best_pipeline(report.pipeline_tokens(C.results(spark, sf_dir)))


@query(f"with {C.RESULTS_SQL}, {_TOKENS} select round((b.total - a.total) / b.total * 100, 6) as reduction from tokens a, tokens b where a.pipeline = 'native' and b.pipeline = 'raw_docx'")
def token_reduction(spark, sf_dir):
    return report.reduction(report.pipeline_tokens(C.results(spark, sf_dir)), "native")


@query(f"with {C.RESULTS_SQL} select document, round(sum(prompt_tokens / 1000.0::double * 0.003::double + completion_tokens / 1000.0::double * 0.015::double), 6) as cost, round(count(*) * 0.01::double, 6) as pages_cost from results group by document")
def llm_cost(spark, sf_dir):
    cost = report.llm_cost(F.col("prompt_tokens"), F.col("completion_tokens"))
    return C.results(spark, sf_dir).groupBy("document").agg(F.sum(cost).alias("cost"), report.page_cost(F.count("*")).alias("pages_cost"))


@query(f"""with {C.CONTENT_SQL}, l as (select doc_id, unnest(string_split(content_md, chr(10))) as raw, generate_subscripts(string_split(content_md, chr(10)), 1) - 1 as pos from content)
select doc_id, pos, case when starts_with(raw, '#') then 'heading' when starts_with(raw, '- ') or starts_with(raw, '* ') or (regexp_matches(raw, '^\\d') and contains(substr(raw, 1, 4), '. ')) then 'list' when starts_with(raw, '![') then 'image' else 'paragraph' end as type, length(raw) as n from l""")
def line_block_parser(spark, sf_dir):
    return parse.line_blocks(C.markdown(spark, sf_dir)).select("doc_id", "pos", "type", F.length("content").alias("n"))


@query(f"with {C.BLOCKS_SQL} select doc_id, sha256(string_agg(content, chr(10) order by pos)) as rebuilt from blocks group by doc_id")
def rebuild_markdown(spark, sf_dir):
    return parse.rebuild_markdown(_blocks(spark, sf_dir)).select("doc_id", F.sha2("content_md", 256).alias("rebuilt"))


_STYLES = "st as (select user_id as doc_id, event_id as pos, event_id % 3 <> 0 as item from events)"


@query(f"with {_STYLES}, g as (select *, sum((not item)::int) over (partition by doc_id order by pos) as run from st) select doc_id, pos, case when item then sum(item::int) over (partition by doc_id, run order by pos) end::bigint as number from g")
def list_numbering(spark, sf_dir):
    """A user's events as list items, a third of them as plain paragraphs between."""
    style = F.when(F.col("event_id") % 3 != 0, "List Number").otherwise("Normal")
    rows = C.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.lit(1).cast("bigint").alias("version"), F.col("event_id").alias("pos"), style.alias("type"))
    return parse.list_numbers(rows).select("doc_id", "pos", "number")


@query(f"with {C.BLOCKS_SQL} select doc_id, pos, type || case when coalesce(level, 0) <> 0 then ' (level ' || level || ')' else '' end as description, {_PREVIEW} from blocks")
def preview_text(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    return blocks.select("doc_id", "pos", T.block_description(F.col("type"), F.col("level")).alias("description"), T.preview(F.col("content")).alias("preview"))


@query("select doc_id, p as pipeline, t as task from documents, (select unnest(['native', 'pandoc', 'raw_docx']) as p), (select unnest(['summarize', 'edit_single']) as t)")
def cross_benchmark_grid(spark, sf_dir):
    return report.grid(C.table(spark, sf_dir, "documents").select("doc_id"), ["native", "pandoc", "raw_docx"], ["summarize", "edit_single"])


@query()
def match_similarity_pass(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return match.match_edited(old, new, match.match_unchanged(old, new)).select("doc_id", "old_pos", "new_pos")


@query()
def inline_runs(spark, sf_dir):
    return _blocks(spark, sf_dir).where("type = 'paragraph'").select("doc_id", "pos", F.posexplode(inline.inline_runs(F.col("content"))).alias("ord", "x")).select("doc_id", "pos", "ord", "x.text", "x.bold", "x.italic")


@query()
def token_counts(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("doc_id").agg(F.sum(inline.approximate_tokens(F.col("content"))).alias("tokens"))


@query()
def benchmark_report(spark, sf_dir):
    return report.report(C.results(spark, sf_dir))


@query("select lang, source, count(*) as n, grouping(lang, source)::bigint as level from documents group by cube (lang, source)")
def corpus_rollup(spark, sf_dir):
    """An addition: document counts by language and source with all subtotals."""
    return C.table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
