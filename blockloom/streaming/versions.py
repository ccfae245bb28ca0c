"""Streams of document versions: each batch of new versions is compared with the last version of its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blockloom.operators import match, parse


def latest(content: DataFrame) -> DataFrame:
    """The highest version of each document."""
    w = W.partitionBy("doc_id").orderBy(F.desc("version"))
    return content.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def sync_stream(spark: SparkSession, source: str, state: str, changes: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Follow Parquet files of ``doc_id, version, content_md`` under ``source``.

    Every batch is appended to ``state`` under its batch number, so a repeated batch replaces its own rows and the state stays
    whole; the differences to each document's last version before it go to ``changes`` in the same way.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        new = latest(batch.dropDuplicates(["doc_id", "version"]))
        try:
            old = latest(spark.read.parquet(state).where(F.col("epoch") < epoch).drop("epoch"))
        except Exception as e:  # noqa: BLE001  no state before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            old = spark.createDataFrame([], new.schema)
        touched = old.join(new.select("doc_id"), "doc_id", "left_semi")
        a, b = parse.parse_blocks(touched), parse.parse_blocks(new)
        found = match.diff(a, b, match.match_blocks(a, b))
        found.write.mode("overwrite").parquet(f"{changes}/epoch={epoch}")
        new.write.mode("overwrite").parquet(f"{state}/epoch={epoch}")

    stream = spark.readStream.schema("doc_id bigint, version bigint, content_md string").parquet(source)
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
