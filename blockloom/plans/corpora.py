"""Markdown corpora made from the base tables, the same in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Parts of a document: literal text, or a column in braces. A pilcrow is a newline.
MARKDOWN = (
    "# Doc {doc_id}¶¶{text}¶¶- {lang}¶1. {source}¶| k | v |¶|:--|--:|¶| id | {doc_id} |¶| a\\|b |¶¶"
    "<!-- textbox -->¶inner {lang} | x¶<!-- /textbox -->¶![pic {doc_id}](assets/p{doc_id}.png)¶![Chart {doc_id}](assets/c.png)¶"
    "See[^1] and [^2], [site](https://x/{doc_id} ) {++new {lang}++}¶left <!-- column-break --> right¶[^1]: note {lang}¶[^2]: second¶## Tail {source}"
)
CRITIC = {"R": "row {--{l_linestatus}--} gone", "A": "row {++{l_linestatus}++} new", "N": "row {~~{l_linestatus}~>{l_linenumber}~~} end"}
LINK = "[{p_name}](https://x/{p_partkey} (v))"


def _parts(template: str) -> list[tuple[str, bool]]:
    """(text, is a column) parts; braces of CriticMarkup aren't column names."""
    import re

    out, at = [], 0
    for m in re.finditer(r"\{([a-z_]+)\}", template):
        out += [(template[at : m.start()], False), (m[1], True)]
        at = m.end()
    return [p for p in [*out, (template[at:], False)] if p[0]]


def column(template: str):
    """The template as a Spark column."""
    return F.concat(*(F.col(p).cast("string") if is_column else F.lit(p.replace("¶", "\n")) for p, is_column in _parts(template)))


def sql(template: str) -> str:
    """The template as DuckDB SQL."""
    quote = lambda p: "replace('" + p.replace("'", "''") + "', '¶', chr(10))" if "¶" in p else "'" + p.replace("'", "''") + "'"
    return "(" + " || ".join(f"{p}::varchar" if is_column else quote(p) for p, is_column in _parts(template)) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, version 1, content_md of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.lit(1).cast("bigint").alias("version"), column(MARKDOWN).alias("content_md"))


def edited(content: DataFrame) -> DataFrame:
    """Version 2: by document and line, a line in seven is dropped, one changed, one doubled."""
    case = F.pmod(F.col("doc_id") * 31, F.lit(7)).cast("int")

    def line(x, i):
        turn = (case + i) % 7
        return F.when(turn == 0, F.array().cast("array<string>")).when(turn == 1, F.array(F.concat(x, F.lit(" edited")))).when(turn == 2, F.array(x, x)).otherwise(F.array(x))

    lines = F.flatten(F.transform(F.split("content_md", "\n", -1), line))
    return content.select("doc_id", F.lit(2).cast("bigint").alias("version"), F.array_join(lines, "\n").alias("content_md"))


CONTENT_SQL = f"content as (select doc_id, 1::bigint as version, {sql(MARKDOWN)} as content_md from documents)"
LINES_SQL = """{n}_lines as (
  select doc_id, version, line_no, raw, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as s from (
    select doc_id, version, unnest(string_split(content_md, chr(10))) as raw, generate_subscripts(string_split(content_md, chr(10)), 1) - 1 as line_no from {n}))"""
CONTENT2_SQL = (
    CONTENT_SQL
    + ", content_l as (select doc_id, unnest(string_split(content_md, chr(10))) as x, generate_subscripts(string_split(content_md, chr(10)), 1) - 1 as i from content)"
    + """, content2 as (
  select doc_id, 2::bigint as version, string_agg(case ((doc_id * 31) % 7 + i) % 7 when 1 then x || ' edited' when 2 then x || chr(10) || x else x end, chr(10) order by i) as content_md
  from content_l where ((doc_id * 31) % 7 + i) % 7 <> 0 group by doc_id)"""
)


def blocks_sql(content: str, out: str) -> str:
    """Common table expressions ``out`` (the blocks) from the table ``content``."""
    p = "partition by doc_id, version order by line_no"
    cells = lambda s: f"list_transform(string_split(substr({s}, 2, greatest(length({s}) - 2, 0)), '|'), lambda c: trim(c))"
    return f"""{LINES_SQL.format(n=content)}, {out}_1 as (
  select *, case when starts_with(s, '<!-- textbox') then 'o' when s = '<!-- /textbox -->' then 'c' end as marker from {content}_lines), {out}_2 as (
  select *, coalesce(last_value(marker ignore nulls) over ({p} rows between unbounded preceding and 1 preceding) = 'o', false) as inside from {out}_1), {out}_3 as (
  select *, coalesce(marker = 'o', false) and not inside as opens, inside or coalesce(marker = 'o', false) as boxed from {out}_2), {out}_4 as (
  select *, not boxed and starts_with(s, '|') and ends_with(s, '|') as is_row,
    len(list_filter({cells('s')}, lambda c: c <> '' and not regexp_matches(c, '^:*-+:*$'))) = 0 as dashes from {out}_3), {out}_5 as (
  select *, is_row and not coalesce(lag(is_row) over ({p}), false) as island from {out}_4), {out}_6 as (
  select *, last_value(case when island then line_no end ignore nulls) over ({p} rows between unbounded preceding and current row) as island_at,
    last_value(case when is_row and not island and dashes then line_no end ignore nulls) over ({p} rows between unbounded preceding and 1 following) as separator_at from {out}_5), {out}_7 as (
  select *, is_row and coalesce(separator_at > island_at, false) as tabled from {out}_6), {out}_8 as (
  select *, tabled and (island or not coalesce(lag(tabled) over ({p}), false)) as table_opens from {out}_7), {out}_9 as (
  select *, opens or table_opens or (not boxed and not tabled and s <> '' and not regexp_matches(s, '^\\[\\^\\d+\\]:\\s*.+$')) as begins from {out}_8), {out}_10 as (
  select *, sum(begins::int) over ({p} rows between unbounded preceding and current row) - 1 as pos from {out}_9 where begins or boxed or tabled), {out}_11 as (
  select doc_id, version, pos::bigint as pos, string_agg(s, chr(10) order by line_no) as content, count(*) as n_lines,
    min_by(case when opens then 'textbox' when table_opens then 'table'
      when starts_with(s, '![') and contains(s, '](') and ends_with(s, ')') then case when substr(s, 3, 5) = 'Chart' then 'chart' else 'image' end
      when starts_with(s, '#') then 'heading' else 'paragraph' end, line_no) as type
  from {out}_10 group by doc_id, version, pos), {out}_12 as (
  select *, coalesce(sum(length(content) + 1) over (partition by doc_id, version order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as content_start from {out}_11), {out} as (
  select *, content_start + length(content) as content_end, 'block-' || pos as block_id, sha256(content) as content_hash,
    case when type = 'heading' then length(regexp_extract(content, '^#+')) end::bigint as level,
    case when type in ('image', 'chart') then substr(content, strpos(content, '](') + 2, length(content) - strpos(content, '](') - 2) end as image_path from {out}_12)"""


BLOCKS_SQL = f"{CONTENT_SQL}, {blocks_sql('content', 'blocks')}"
BOTH_SQL = f"{CONTENT2_SQL}, {blocks_sql('content', 'blocks')}, {blocks_sql('content2', 'blocks2')}"
MATCHED_SQL = (
    BOTH_SQL
    + """, o as (select *, row_number() over (partition by doc_id, content_hash order by pos) as nth from blocks),
n as (select *, row_number() over (partition by doc_id, content_hash order by pos) as nth from blocks2),
m as (select o.doc_id, o.pos as old_pos, n.pos as new_pos, o.block_id as old_id, n.block_id as new_id from o join n using (doc_id, content_hash, nth))"""
)
CRITIC_SQL = "critic as (select l_orderkey as doc_id, l_linenumber::bigint as pos, l_returnflag, l_linestatus, case l_returnflag " + " ".join(f"when '{k}' then {sql(v)}" for k, v in CRITIC.items()) + " end as content from lineitem)"


def critic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, content: a line with one CriticMarkup mark for every line item."""
    items = table(spark, sf_dir, "lineitem")
    content = F.coalesce(*(F.when(F.col("l_returnflag") == k, column(v)) for k, v in CRITIC.items()))
    return items.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("pos"), "l_returnflag", "l_linestatus", content.alias("content"))


NATIONS_SQL = """grid as (select r_regionkey::bigint as doc_id, 1::bigint as version,
  '| name | key |' || chr(10) || '| :---: | ---: |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) order by n_nationkey) as content_md
  from region join nation on n_regionkey = r_regionkey group by r_regionkey)"""


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A markdown table of each region's nations."""
    row = F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |"))
    both = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda x: x["row"])
    made = F.concat(F.lit("| name | key |\n| :---: | ---: |\n"), F.array_join(rows, "\n"))
    return both.groupBy(F.col("r_regionkey").cast("bigint").alias("doc_id")).agg(made.alias("content_md")).select("doc_id", F.lit(1).cast("bigint").alias("version"), "content_md")


RESULTS_SQL = """results as (select case l_linenumber % 4 when 0 then 'native' when 1 then 'pandoc' when 2 then 'raw_docx' else 'ooxml' end as pipeline,
  (l_suppkey % 3)::bigint as task, l_orderkey as document, l_partkey as prompt_tokens, l_suppkey as completion_tokens,
  case when l_returnflag = 'R' then 'failed' when l_returnflag = 'A' then '' end as error from lineitem)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark results with whole-number token counts, one for every line item."""
    turn = F.col("l_linenumber") % 4
    name = F.when(turn == 0, "native").when(turn == 1, "pandoc").when(turn == 2, "raw_docx").otherwise("ooxml")
    error = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "")
    return table(spark, sf_dir, "lineitem").select(name.alias("pipeline"), (F.col("l_suppkey") % 3).alias("task"), F.col("l_orderkey").alias("document"), F.col("l_partkey").alias("prompt_tokens"), F.col("l_suppkey").alias("completion_tokens"), error.alias("error"))
