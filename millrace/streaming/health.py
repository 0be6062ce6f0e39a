"""Board health as a stream: one small state row for each board."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from millrace.operators.state import MAX_FAILURES, NOT_COUNTED
from millrace.operators.tables import shared_dir

OUT = "board long, consecutive_failures long, last_outcome string, evicted boolean"


def _advance(key, batches, state):
    failures, seq, last = state.get if state.exists else (0, -1, "")
    rows = pd.concat(list(batches)).sort_values("seq")
    for kind, at in zip(rows["kind"], rows["seq"], strict=True):
        seq, last = int(at), kind
        if kind == "ok":
            failures = 0
        elif kind not in NOT_COUNTED:
            failures += 1
    state.update((failures, seq, last))
    yield pd.DataFrame([(key[0], failures, last, failures >= MAX_FAILURES)], columns=["board", "consecutive_failures", "last_outcome", "evicted"])


def board_health_stream(outcomes: DataFrame) -> DataFrame:
    """Updates of (board, consecutive_failures, last_outcome, evicted) from a stream of outcomes.

    Outcomes are (board, seq, kind); within a micro-batch they count in the order of seq.
    """
    return outcomes.groupBy("board").applyInPandasWithState(
        _advance, OUT, "failures long, seq long, last string", "update", GroupStateTimeout.NoTimeout
    )


def streaming_board_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the stream over the events that lie there now and returns each board's last row."""
    import uuid

    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    kind = F.when(F.col("event_type") == "error", "gone").when(F.col("event_type") == "signup", "unavailable").otherwise("ok")
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    stream = stream.select(F.col("user_id").alias("board"), F.col("event_id").alias("seq"), kind.alias("kind"))
    base = f"{shared_dir(spark)}/health-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

    query = board_health_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state")
    query.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    last = rows.groupBy("board").agg(F.max_by(F.struct("consecutive_failures", "last_outcome", "evicted"), "batch").alias("s"))
    return last.select("board", "s.*")
