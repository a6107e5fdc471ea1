"""Live innings state from a stream of balls.

The stream keeps one row of state per over. Running totals and rates are derived from the published
overs of an innings, so a ball that arrives late corrects every over after it.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stumpline.functions.exprs import boundary, ratio, total
from stumpline.schema import INNINGS_BALLS
from stumpline.sources.staging import drop_table, staged

INNINGS = ("match_id", "inning", "batting_team")


def live_innings_state(balls: DataFrame, match_start: str | None = None, keep_for: str = "2 days") -> DataFrame:
    """Totals of every over seen so far: match_id, inning, batting_team, over and what happened in it.

    Works on a stream (output mode "update") and on a table. Super overs are left out, no other over is.
    With ``match_start``, a timestamp that is the same for all balls of a match, the state of old
    matches is dropped.
    """
    keys = [*INNINGS, "over"]
    if match_start:
        balls = balls.withWatermark(match_start, keep_for)
        keys.append(match_start)
    return (
        balls.where(~F.col("is_super_over"))
        .groupBy(*keys)
        .agg(
            F.sum("total_runs").alias("runs_in_over"),
            total(F.col("is_wicket")).alias("wickets_in_over"),
            total(boundary()).alias("boundaries_in_over"),
            total(F.col("is_legal_delivery")).alias("balls_in_over"),
        )
    )


def over_by_over(states: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """One row per over with running totals and rates. A window is one innings.

    ``targets`` (match_id, target) adds the chase columns for second innings.
    """
    so_far = Window.partitionBy(*INNINGS).orderBy("over").rowsBetween(Window.unboundedPreceding, 0)
    out = states.select(
        *INNINGS, "over", "runs_in_over", "wickets_in_over", "boundaries_in_over", "balls_in_over",
        F.sum("runs_in_over").over(so_far).alias("cum_runs"),
        F.sum("wickets_in_over").over(so_far).alias("cum_wickets"),
    ).withColumn("current_rr", ratio("cum_runs", "over", 3))
    if targets is None:
        return out
    chase = F.col("inning") == 2
    left = INNINGS_BALLS - F.col("over") * 6
    out = out.join(targets.select("match_id", "target"), "match_id", "left")
    out = out.withColumns(
        {
            "balls_remaining": F.when(chase, left),
            "runs_required": F.when(chase, F.col("target") - F.col("cum_runs")),
        }
    )
    return out.withColumn("required_rr", ratio("runs_required", F.col("balls_remaining") / 6, 2)).drop("target")


def read_ball_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Ball table as a stream of its Parquet files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_states(states: DataFrame, out_dir: str, checkpoint_dir: str, available_now: bool = False) -> StreamingQuery:
    """Publish changed innings, one folder per micro-batch; a repeated batch overwrites its own folder."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    writer = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint_dir).foreachBatch(publish)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def latest_states(spark: SparkSession, out_dir: str) -> DataFrame:
    """Newest published state of every over."""
    states = spark.read.parquet(out_dir)
    keys = [*INNINGS, "over"]
    fields = [c for c in states.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*fields), "batch_id").alias("s")
    return states.groupBy(*keys).agg(newest).select(*keys, "s.*")


def compact_states(spark: SparkSession, out_dir: str) -> None:
    """Replace the folders of all batches by one with the newest states; for between two runs of the stream."""
    newest = staged(latest_states(spark, out_dir))
    last = spark.read.parquet(out_dir).agg(F.max("batch_id")).first()[0]
    newest.write.mode("overwrite").parquet(f"{out_dir}/batch_id={last}")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out_dir)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("batch_id=") and name != f"batch_id={last}":
            files.delete(status.getPath(), True)
    drop_table(newest)


def live_score(over_rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Predicted final total after every completed over; a stateless step after the state."""
    scored = model.transform(over_rows)
    return scored.select("match_id", "inning", "over", "cum_runs", F.col("prediction").alias("predicted_final_score"))
