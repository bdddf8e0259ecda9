"""Linkage of records as they arrive, against a stored keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spanloom.functions.keys import add_keys
from spanloom.plans import blocking as B

S, C = "source1_entity_id", "candidate_entity_id"


def link_stream(arriving: DataFrame, rec: DataFrame, plan: list[B.Rule], out: str, checkpoint: str) -> StreamingQuery:
    """Candidates of every micro-batch of S1 records, appended as Parquet.

    The records' (rule, key) rows are stored once beside the checkpoint, capped
    and in order of key, and every batch joins that table.  Batches don't depend
    on one another, so there is no state and no watermark; a batch that is run
    again overwrites its own folder.
    """
    spark, stored = arriving.sparkSession, f"{checkpoint}/keys"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{stored}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        B.capped(B.keyed(rec, plan, C), plan).sort("rule_idx", "key").write.mode("overwrite").parquet(stored)

    def link(batch: DataFrame, number: int) -> None:
        left = B.keyed(add_keys(batch), plan, S)
        right = batch.sparkSession.read.parquet(stored)
        left.join(right, ["rule_idx", "key"]).select(S, C).distinct().write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(link).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
