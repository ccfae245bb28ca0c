import random

from pyspark.sql import functions as F

from blockloom.functions.inline import ratio
from blockloom.operators import match, parse, report, score, sync, validate


def blocks(spark, docs):
    content = spark.createDataFrame([(i, 1, md) for i, md in docs.items()], "doc_id bigint, version int, content_md string")
    return parse.parse_blocks(content)


def greedy(old, new):
    pairs, used = {}, set()
    for i, a in enumerate(old):
        for j, b in enumerate(new):
            if j not in used and a == b:
                pairs[i] = j
                used.add(j)
                break
    for i, a in enumerate(old):
        if i not in pairs and i < len(new) and i not in used and a.startswith("#") == new[i].startswith("#") and ratio(a, new[i]) >= 0.7:
            pairs[i] = i
            used.add(i)
    return pairs


def test_matching_equals_greedy(spark):
    rng = random.Random(5)
    words = ["alpha beta", "alpha beta gamma", "alpha bet", "# head", "# heads", "zeta", "alpha"]
    olds = {i: [rng.choice(words) for _ in range(rng.randrange(1, 7))] for i in range(60)}
    news = {i: [rng.choice(words) for _ in range(rng.randrange(1, 7))] for i in range(60)}
    a, b = (blocks(spark, {i: "\n".join(x) for i, x in d.items()}) for d in (olds, news))
    got = {}
    for r in match.match_blocks(a, b).collect():
        got.setdefault(r["doc_id"], {})[r["old_pos"]] = r["new_pos"]
    assert {i: got.get(i, {}) for i in olds} == {i: greedy(olds[i], news[i]) for i in olds}


def test_diff_and_compat(spark):
    a, b = blocks(spark, {1: "same\nhello world\ngone"}), blocks(spark, {1: "same\nhello there world\n# new"})
    changes = lambda m: sorted((r["change"], r["content"]) for r in match.diff(a, b, m).collect())
    assert changes(match.match_blocks(a, b)) == [("added", "# new"), ("modified", "hello there world"), ("removed", "gone"), ("unchanged", "same")]
    assert changes(match.match_blocks(a, b, cli_compat=True)) == [("added", "# new"), ("added", "hello there world"), ("removed", "gone"), ("removed", "hello world"), ("unchanged", "same")]


def test_sync_moves_styles(spark):
    old = blocks(spark, {1: "a\nb", 2: "x"})
    styles = old.select("doc_id", "block_id", F.col("content").alias("docx_style"))
    content = spark.createDataFrame([(1, 2, "new\nb\na"), (2, 2, "unlike")], "doc_id bigint, version int, content_md string")
    _, kept, _ = sync.sync(old, styles, content)
    assert sorted((r["doc_id"], r["block_id"], r["docx_style"]) for r in kept.collect()) == [(1, "block-1", "b"), (1, "block-2", "a")]
    _, kept, _ = sync.sync(old, styles, content, cli_compat=True)
    assert (2, "block-0", "x") in [(r["doc_id"], r["block_id"], r["docx_style"]) for r in kept.collect()]


def test_track_change_warnings(spark):
    rows = [(1, "b", 0, 5, [(0, 9, "", None), (4, 2, "a", "d")])]
    df = spark.createDataFrame(rows, "doc_id bigint, block_id string, content_start int, content_end int, track_changes array<struct<start:int,end:int,author:string,date:string>>")
    got = [(r["nth"], r["warning"]) for r in validate.track_changes(df).collect()]
    assert sorted(got) == [(1, "end exceeds block"), (1, "missing author"), (1, "missing date"), (2, "start after end")]


def test_cell_styles(spark):
    rows = [("0,1", "FFFFFF", "pct5", "single", 8, "000000"), ("x,1", None, None, None, None, None), ("0,1,2", None, None, None, None, None), ("9,9", "red", "solid", "zig", 97, "#000000")]
    df = spark.createDataFrame(rows, "key string, background_color string, pattern_fill string, border_style string, border_width int, border_color string")
    assert sorted(map(tuple, validate.kept_cell_styles(df).collect())) == [(0, 1, "FFFFFF", "pct5", "single", 8, "000000"), (9, 9, None, None, None, None, None)]


def test_scores(spark):
    tables = lambda *rows: spark.createDataFrame([(1, i, *r, "m", "c", None) for i, r in enumerate(rows)], "doc_id int, pos int, rows int, cols int, merged_cells string, cell_backgrounds string, table_style string")
    assert score.score_tables(tables((2, 2), (3, 3)), tables((2, 9))).first()["tables"] == 4 / 10 * 100
    links = lambda *rows: spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id int, pos int, text string, url string")
    assert score.score_links(links(("a", "b"), ("c", "d")), links(("a", "b"), ("c", "x"), ("e", "f"))).first()["hyperlinks"] == 100 / 3
    assert score.score_links(links(("a", "b")).where("false"), links(("a", "b"))).first()["hyperlinks"] is None
    changes = lambda *rows: spark.createDataFrame([(1, *r) for r in rows], "doc_id int, kind string, author string")
    got = score.score_changes(changes(("insertion", "A"), ("deletion", "B")), changes(("insertion", "A"))).first()["track_changes"]
    assert abs(got - (1 + 0 + 0.5) / 3 * 100) < 1e-9
    assert spark.range(1).select(score.total(F.array(F.lit(50.0), F.lit(None).cast("double"), F.lit(100.0)))).first()[0] == 75.0


def test_formatting_missing_run_equals_all_null(spark):
    kind = "doc_id int, pos int, bold boolean, italic boolean, underline boolean, font string, size double"
    old = spark.createDataFrame([(1, 0, True, None, None, "f", 1.0), (1, 1, None, None, None, None, None)], kind)
    new = spark.createDataFrame([(1, 0, True, None, None, "f", 1.0)], kind)
    assert score.score_formatting(old, new).first()["formatting"] == 100.0


def test_report(spark):
    rows = [("raw_docx", "t", "d", 100, 100, None), ("native", "t", "d", 80, 70, ""), ("native", "t", "d", 0, 0, "boom"), ("ooxml", "t", "d", 1, 1, "x")]
    results = spark.createDataFrame(rows, "pipeline string, task string, document string, prompt_tokens bigint, completion_tokens bigint, error string")
    tokens = report.pipeline_tokens(results)
    assert sorted((r["pipeline"], r["total"]) for r in tokens.collect()) == [("native", 150.0), ("raw_docx", 200.0)]
    assert report.best_pipeline(tokens).first()["pipeline"] == "native"
    assert report.reduction(tokens, "native").first()[0] == 25.0
    assert "| native | 80 | 70 | 150 | $0.0013 |" in report.report(results).first()[0]
