"""Latest labels kept up to date from a folder to which label files are added: an extension of the batch operator.

Each micro-batch is merged with the table of latest labels by the same rule as in a batch, so replays and late records
change nothing. The table is written as a new version and then named in a pointer file, so readers never see half.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from skein.operators.labels import latest
from skein.sources.sinks import write_report

SCHEMA = "session_id string, aspect string, ts string, value string, note string, source string, runtime string"
KEYS, ORDER = ["session_id", "aspect"], ["ts", "value", "source"]


def current(spark: SparkSession, table: str) -> DataFrame | None:
    file = os.path.join(table, "current.json")
    if not os.path.exists(file):
        return None
    with open(file, encoding="utf-8") as f:
        return spark.read.parquet(os.path.join(table, json.load(f)["version"]))


def merge_batch(batch: DataFrame, epoch: int, table: str) -> None:
    spark = batch.sparkSession
    rows = batch.where("session_id is not null and aspect is not null").fillna("", ["ts"])
    old = current(spark, table)
    new = latest(rows if old is None else old.unionByName(rows), KEYS, ORDER)
    version = f"v{epoch:012d}"
    new.write.mode("overwrite").parquet(os.path.join(table, version))
    write_report(os.path.join(table, "current.json"), {"version": version})


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str):
    """Starts the stream; stop() or awaitTermination() as usual."""
    os.makedirs(table, exist_ok=True)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1000).json(folder)
    return stream.writeStream.foreachBatch(lambda b, e: merge_batch(b, e, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
