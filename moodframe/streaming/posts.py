"""Enrich posts as they arrive.

The enrich plan runs inside ``foreachBatch`` on each micro-batch (a post
arrives whole in one batch), so the stream's output equals the batch plan on
the same rows. Every batch has its own folder, which a repeated batch
replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moodframe.operators.scoring import enrich_posts
from moodframe.session import scratch_dir
from moodframe.streaming.conversations import write_batch


def run_enrich_stream(spark: SparkSession, source_dir: str, schema: str, scorer,
                      key_col: str = "doc_id", text_col: str = "posts",
                      work_dir: str | None = None, files_per_batch: int = 1) -> DataFrame:
    """Stream a folder of post files through the enrich plan
    (``Trigger.AvailableNow``) into a Parquet table and return that table."""
    work_dir = work_dir or scratch_dir(spark, "post-stream")
    out_dir, ckpt = f"{work_dir}/enriched", f"{work_dir}/checkpoint"
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
           .parquet(source_dir))

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(enrich_posts(batch, scorer, key_col, text_col), batch_id, out_dir)

    q = (src.writeStream.foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir).drop("batch_id")
