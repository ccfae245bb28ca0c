"""More registered queries: Word files written and read back, scores of runs and tables, and the smaller functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions import text as T
from blockloom.operators import match, parse, report, score
from blockloom.plans import corpora as C
from blockloom.plans.catalog import _versions, query
from blockloom.sources import docx, docx_writer


def _word(content, author="Ann"):
    """Blocks of Word files that were built from ``content``."""
    made = docx_writer.build(parse.parse_blocks(content), author, "2026-01-01T00:00:00Z", notes=parse.footnote_definitions(content))
    found = docx.elements(made.select(F.col("doc_id").cast("string").alias("path"), F.col("docx").alias("content")))
    return found, docx.blocks(found).withColumn("doc_id", F.col("path").cast("bigint"))


@query(f"with {C.NATIONS_SQL} select doc_id, 0::bigint as pos, 'table' as type, content_md as content, 2::bigint as cols from grid")
def word_tables(spark, sf_dir):
    """Tables written to Word files and read back."""
    return _word(C.nations(spark, sf_dir))[1].select("doc_id", "pos", "type", "content", F.col("table_metadata.cols").alias("cols"))


_NOTE = ["'# ' || n_name", "'plain *it* **bold**'", "'see [site](https://x/' || n_nationkey || '%20b)'", "'change {++new ' || n_name || '++}{--old--}'", "'note[^1]'", "'left' || chr(10) || '<!-- column-break -->' || chr(10) || 'right'", "'[^1]: about ' || n_name"]
_LETTERS = f"letters as (select n_nationkey::bigint as doc_id, unnest([{', '.join(_NOTE)}]) as content, unnest(range(7)) as pos from nation)"


def _letters(spark, sf_dir):
    name, key = F.col("n_name"), F.col("n_nationkey").cast("string")
    lines = [F.concat(F.lit("# "), name), F.lit("plain *it* **bold**"), F.concat(F.lit("see [site](https://x/"), key, F.lit("%20b)")), F.concat(F.lit("change {++new "), name, F.lit("++}{--old--}")), F.lit("note[^1]"), F.lit("left<!-- column-break -->right"), F.concat(F.lit("[^1]: about "), name)]
    return C.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("doc_id"), F.lit(1).cast("bigint").alias("version"), F.concat_ws("\n", *lines).alias("content_md"))


@query(f"with {_LETTERS} select doc_id, pos, case pos when 0 then 'heading' else 'paragraph' end as type, content from letters")
def word_paragraphs(spark, sf_dir):
    """Headings, emphasis, links, changes, notes and column breaks through Word files and back."""
    return _word(_letters(spark, sf_dir))[1].select("doc_id", "pos", "type", "content")


@query("select n_nationkey::bigint as doc_id, kind, author, 7 + case kind when 'deletion' then length(n_name) + 4 else 0 end as \"start\", case kind when 'deletion' then 'old' end as deleted_text from nation, (select unnest(['insertion', 'deletion']) as kind), (select 'Ann' as author)")
def word_track_changes(spark, sf_dir):
    rows = _word(_letters(spark, sf_dir))[1].select("doc_id", F.explode("track_changes").alias("t"))
    return rows.select("doc_id", F.col("t.type").alias("kind"), "t.author", "t.start", "t.deleted_text")


@query("select n_nationkey::bigint as doc_id, n_name || chr(10) || 'plain it bold' || chr(10) || 'see site' || chr(10) || 'change ' || chr(10) || 'note' || chr(10) || 'left' || chr(10) || '<!-- column-break -->' || chr(10) || 'right' as text from nation")
def word_raw_text(spark, sf_dir):
    """The plain-text pipeline over the same files."""
    return docx.raw_text(_word(_letters(spark, sf_dir))[0]).select(F.col("path").cast("bigint").alias("doc_id"), "text")


@query(f"with {_LETTERS} select doc_id, 'block-' || pos as block_id, case pos when 0 then 'Heading 1' else 'Normal' end as docx_style, 'Calibri' as font_name, 11::double as font_size, 'left' as alignment from letters where pos < 6")
def word_styles(spark, sf_dir):
    rows = docx.styles(_word(_letters(spark, sf_dir))[1]).where("block_id <> 'block-6'")
    return rows.select(F.col("path").cast("bigint").alias("doc_id"), "block_id", "docx_style", "font_name", "font_size", "alignment")


@query("select n_nationkey::bigint as doc_id, 1::bigint as column_count, 0::bigint as start_block_index, 5::bigint as end_block_index from nation")
def word_sections(spark, sf_dir):
    return docx.sections(_word(_letters(spark, sf_dir))[0]).select(F.col("path").cast("bigint").alias("doc_id"), "column_count", "start_block_index", "end_block_index")


_RUNS = """a as (select l_orderkey as doc_id, l_linenumber as pos, l_returnflag = 'A' as bold, l_linestatus = 'O' as italic, l_quantity as size from lineitem),
b as (select l_orderkey as doc_id, l_linenumber as pos, l_returnflag = 'A' as bold, l_linestatus = 'O' as italic, case when l_suppkey % 3 = 0 then l_quantity + 1 else l_quantity end as size from lineitem where l_partkey % 5 <> 0)"""


@query(f"with {_RUNS} select coalesce(a.doc_id, b.doc_id) as doc_id, round(count(*) filter (a.bold is not distinct from b.bold and a.italic is not distinct from b.italic and a.size is not distinct from b.size) * 100.0::double / count(*), 6) as formatting from a full join b on a.doc_id = b.doc_id and a.pos = b.pos group by 1")
def score_formatting(spark, sf_dir):
    """An order's lines as runs; some are missing from the rebuilt side and some have another size."""
    none = F.lit(None).cast("string")
    runs = C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), (F.col("l_returnflag") == "A").alias("bold"), (F.col("l_linestatus") == "O").alias("italic"), none.alias("underline"), none.alias("font"), F.col("l_quantity").alias("size"), "l_partkey", "l_suppkey")
    rebuilt = runs.where("l_partkey % 5 <> 0").withColumn("size", F.when(F.col("l_suppkey") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return score.score_formatting(runs, rebuilt)


@query("""with a as (select p_partkey % 50 as doc_id, p_partkey as pos, p_brand as style from part), b as (select p_partkey % 50 as doc_id, p_partkey as pos, case when p_partkey % 7 = 0 then 'other' else p_brand end as style from part where p_partkey % 4 <> 0)
select a.doc_id, round((sum(case when b.pos is null then 0 else 4 + (a.style = b.style)::int end) + (count(a.pos) = count(b.pos))::int) * 100.0::double / (sum(case when b.pos is null then 4 else 5 end) + 1), 6) as tables from a left join b on a.doc_id = b.doc_id and a.pos = b.pos group by 1""")
def score_tables(spark, sf_dir):
    """Parts as tables; a quarter is missing from the rebuilt side and some have another style."""
    part = C.table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("doc_id"), F.col("p_partkey").alias("pos"), F.col("p_size").alias("rows"), F.col("p_size").alias("cols"), (F.col("p_size") % 3).alias("merged_cells"), F.lit("x").alias("cell_backgrounds"), F.col("p_brand").alias("table_style"))
    return score.score_tables(part, part.where("pos % 4 <> 0").withColumn("table_style", F.when(F.col("pos") % 7 == 0, "other").otherwise(F.col("table_style"))))


@query(f"with {C.RESULTS_SQL} select pipeline, document, sum(prompt_tokens)::bigint as prompt_tokens, sum(completion_tokens)::bigint as completion_tokens, count(*) as turns from results where coalesce(error, '') = '' group by pipeline, document")
def multi_turn_tokens(spark, sf_dir):
    return report.multi_turn(C.results(spark, sf_dir))


@query("select p_partkey, replace(replace(p_name || '|' || p_brand || chr(10) || 'x', '|', '\\|'), chr(10), ' ') as cell from part")
def escaped_cells(spark, sf_dir):
    return C.table(spark, sf_dir, "part").select("p_partkey", T.escape_cell(F.concat("p_name", F.lit("|"), "p_brand", F.lit("\nx"))).alias("cell"))


@query("select p_partkey, regexp_replace('word/' || p_name || '~[' || p_brand || '].xml', '[^a-zA-Z0-9/._\\[\\]-]', '_', 'g') as part from part")
def sanitized_parts(spark, sf_dir):
    name = F.concat(F.lit("word/"), "p_name", F.lit("~["), "p_brand", F.lit("].xml"))
    return C.table(spark, sf_dir, "part").select("p_partkey", T.sanitized_part(name).alias("part"))


@query("select p_partkey, case p_size % 5 when 0 then 'plain' when 1 then 'emphasis' when 2 then 'link' when 3 then 'critic' else 'emphasis' end as kind from part")
def cell_kinds(spark, sf_dir):
    cases = {0: F.lit("a ** b"), 1: F.concat(F.lit("**"), "p_name", F.lit("**")), 2: F.concat(F.lit("*x* ["), "p_name", F.lit("](y)")), 3: F.concat(F.lit("{++"), "p_name", F.lit("++}")), 4: F.concat(F.lit("an *"), "p_name", F.lit("*"))}
    text = F.coalesce(*(F.when(F.col("p_size") % 5 == k, v) for k, v in cases.items()))
    return C.table(spark, sf_dir, "part").select("p_partkey", T.cell_kind(text).alias("kind"))


@query("select p_partkey, unnest(['*', '**', '***']) as stars, unnest([p_name, p_brand, 'x']) as text from part")
def emphasis_segments(spark, sf_dir):
    text = F.concat(F.lit("a *"), "p_name", F.lit("* b **"), "p_brand", F.lit("** ***x*** c"))
    return C.table(spark, sf_dir, "part").select("p_partkey", F.inline(T.emphasis(text)))


@query("select p_partkey, case p_size % 6 when 1 then 'is jpeg' when 3 then 'unknown content' end as problem from part")
def image_checks(spark, sf_dir):
    heads = {0: ("89504E470D0A1A0A00", "png"), 1: ("FFD8FF00", "png"), 2: ("0200090000", "wmf"), 3: ("00", "png"), 4: ("47494638", "GIF"), 5: ("4D4D002A", "tif")}
    turn = F.col("p_size") % 6
    of = lambda i: F.coalesce(*(F.when(turn == k, F.lit(v[i])) for k, v in heads.items()))
    return C.table(spark, sf_dir, "part").select("p_partkey", T.image_problem(F.unhex(of(0)), of(1)).alias("problem"))


@query("select p_partkey, 'a.b/' || p_partkey || '.sdoc' as path from part")
def file_extensions(spark, sf_dir):
    suffix = F.when(F.col("p_partkey") % 2 == 0, ".docx").otherwise("")
    return C.table(spark, sf_dir, "part").select("p_partkey", T.with_extension(F.concat(F.lit("a.b/"), F.col("p_partkey").cast("string"), suffix), ".sdoc").alias("path"))


@query("select p_partkey, case when p_size % 2 = 0 then 'N/A' else p_size || '.0' end as score, p_name || ' now' as edited from part")
def score_texts(spark, sf_dir):
    value = F.when(F.col("p_size") % 2 == 1, F.col("p_size").cast("double"))
    return C.table(spark, sf_dir, "part").select("p_partkey", report.score_text(value).alias("score"), report.apply_edit(F.col("p_name"), F.lit(" now")).alias("edited"))


@query(f"with {C.MATCHED_SQL} select doc_id, new_id as block_id, old_id as style_id from m")
def reversed_mapping(spark, sf_dir):
    return match.reverse_mapping(match.match_unchanged(*_versions(spark, sf_dir))).select("doc_id", "block_id", "style_id")


@query(f"with {C.BLOCKS_SQL} select doc_id, block_id, case when pos % 3 = 0 then 'S' || pos end as docx_style from blocks")
def style_lookup(spark, sf_dir):
    blocks = parse.parse_blocks(C.markdown(spark, sf_dir)).select("doc_id", "pos", "block_id")
    styles = blocks.where("pos % 3 = 0").select("doc_id", "block_id", F.concat(F.lit("S"), F.col("pos").cast("string")).alias("docx_style"))
    return match.styles_of(blocks, styles).select("doc_id", "block_id", "docx_style")


@query(f"with {C.RESULTS_SQL} select pipeline, document, task, count(*) as n from results where pipeline in ('native', 'pandoc') group by all")
def rebuildable_runs(spark, sf_dir):
    return report.rebuildable(C.results(spark, sf_dir)).groupBy("pipeline", "document", "task").agg(F.count("*").alias("n"))
