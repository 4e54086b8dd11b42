"""Idempotent publication of intents from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.sources.snapshots import _exists

OUTBOX_SCHEMA = "id string, idempotency_key string, project_id string, generation_id string, batch_id long"


def outbox(spark: SparkSession, folder: str) -> DataFrame:
    """Published intents, read from committed batches only."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], OUTBOX_SCHEMA)
    return spark.read.schema(OUTBOX_SCHEMA).parquet(f"{folder}/batch=*")


def conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Refused intents ``(id, idempotency_key, owner, batch_id)``: their key is another intent's."""
    schema = "id string, idempotency_key string, owner string, batch_id long"
    if not _exists(spark, f"{folder}-refused"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}-refused/batch=*")


def plan_publish(batch: DataFrame, published: DataFrame) -> dict[str, DataFrame]:
    """New intents to publish, replays to skip, and keys that belong to another intent."""
    first = batch.groupBy("idempotency_key").agg(
        F.min_by(F.struct("id", "project_id", "generation_id"), "id").alias("i"), F.min("id").alias("low"), F.max("id").alias("high")
    )
    owners = published.select("idempotency_key", F.col("id").alias("owner")).distinct()
    new = first.join(owners, "idempotency_key", "left_anti").select("i.id", "idempotency_key", "i.project_id", "i.generation_id")
    winner = owners.unionByName(new.select("idempotency_key", F.col("id").alias("owner")))
    judged = batch.join(winner, "idempotency_key")
    return {
        "publish": new,
        "conflicts": judged.where(F.col("id") != F.col("owner")).select("id", "idempotency_key", "owner"),
    }


def publish_once(folder: str):
    """A ``foreachBatch`` function that writes each intent once, also when a batch is replayed.

    A batch lands in a folder of its own number, which a replay overwrites; earlier
    batches are what the keys are checked against. Intents whose key belongs to another
    one are written first, to a folder beside the outbox (``conflicts``).
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = outbox(spark, folder).where(F.col("batch_id") < batch_id)
        plan = {k: df.withColumn("batch_id", F.lit(batch_id).cast("long")) for k, df in plan_publish(batch, earlier).items()}
        # before the batch: a replay's plan lists the files that the batch then overwrites
        plan["conflicts"].write.mode("overwrite").parquet(f"{folder}-refused/batch={batch_id}")
        plan["publish"].write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return run
