"""Token, cost and fidelity summaries of benchmark results ``(pipeline, task, document, prompt_tokens, completion_tokens, error)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions import constants as K

DIMENSIONS = ["structure", "formatting", "tables", "hyperlinks", "track_changes", "total"]


def pipeline_tokens(results: DataFrame) -> DataFrame:
    """Mean tokens of the runs without an error; pipelines without one are left out."""
    ok = results.where(F.coalesce("error", F.lit("")) == "")
    means = ok.groupBy("pipeline").agg(F.avg("prompt_tokens").alias("prompt"), F.avg("completion_tokens").alias("completion"))
    return means.withColumn("total", F.col("prompt") + F.col("completion"))


def pipeline_fidelity(scores: DataFrame) -> DataFrame:
    """Mean of each dimension over the documents to which it applies."""
    return scores.groupBy("pipeline").agg(*(F.avg(d).alias(d) for d in DIMENSIONS))


def best_pipeline(tokens: DataFrame) -> DataFrame:
    """The pipeline with the least total; the first by name on a tie."""
    return tokens.agg(F.min(F.struct("total", "pipeline")).alias("b")).select("b.pipeline", "b.total")


def reduction(tokens: DataFrame, pipeline: str, baselines: tuple[str, ...] = ("raw_docx", "pandoc")) -> DataFrame:
    """By how many percent a pipeline's total lies under the first baseline there is."""
    value = lambda p: F.max(F.when(F.col("pipeline") == p, F.col("total")))
    sums = tokens.agg(value(pipeline).alias("own"), F.coalesce(*map(value, baselines)).alias("base"))
    return sums.select(F.when(F.col("base") > 0, (F.col("base") - F.col("own")) / F.col("base") * 100).alias("reduction"))


def llm_cost(prompt: Column, completion: Column, input_price: float = K.INPUT_PRICE, output_price: float = K.OUTPUT_PRICE) -> Column:
    return prompt / 1000 * input_price + completion / 1000 * output_price


def page_cost(pages: Column, price: float = K.PAGE_PRICE) -> Column:
    return pages * price


def grid(documents: DataFrame, pipelines: list[str], tasks: list[str]) -> DataFrame:
    """Every document with every pipeline and task; the two lists are short constants, so no table is crossed with another."""
    return documents.withColumn("pipeline", F.explode(F.array(*map(F.lit, pipelines)))).withColumn("task", F.explode(F.array(*map(F.lit, tasks))))


def rebuildable(results: DataFrame) -> DataFrame:
    """Runs of the pipelines that can rebuild a document."""
    return results.where(F.col("pipeline").isin("native", "pandoc"))


def multi_turn(results: DataFrame) -> DataFrame:
    """Tokens of all turns of a document with a pipeline, and their number; failed turns count nothing."""
    good = results.where(F.coalesce("error", F.lit("")) == "")
    return good.groupBy("pipeline", "document").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count("*").alias("turns"))


def apply_edit(content: Column, instruction: Column) -> Column:
    return F.concat(content, instruction)


def score_text(score: Column) -> Column:
    return F.when(score.isNull(), "N/A").otherwise(F.format_string("%.1f", score))


def report(results: DataFrame) -> DataFrame:
    """One text row: a markdown table of tokens and cost, cheapest first."""
    rows = pipeline_tokens(results).withColumn("cost", llm_cost(F.floor("prompt"), F.floor("completion")))
    line = F.concat(F.lit("| "), F.col("pipeline"), F.format_string(" | %.0f | %.0f | %.0f | $%.4f |", "prompt", "completion", "total", "cost"))
    ordered = F.array_sort(F.collect_list(F.struct("total", "pipeline", line.alias("line"))))
    head = F.array(F.lit("| pipeline | prompt | completion | total | cost |"), F.lit("|---|---|---|---|---|"))
    return rows.agg(F.array_join(F.concat(head, F.transform(ordered, lambda x: x["line"])), "\n").alias("report"))
