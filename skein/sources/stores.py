"""Readers: append-only label stores, JSON lines, bundles, job artifacts. Every schema is explicit."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources import files

GOAL_ROW = "session_id string, runtime string, message string, goal string, goal_source string, gold boolean, reviewed_by string"
TRAINING_ROW = "id string, split_day string, messages array<struct<role:string,content:string>>, metadata string"
PREDICTION = "session_id string, message string, goal string, student string"
VERDICT = "id string, verdict string, reason string"
BUNDLE = "schema_version int, aspect string, labels array<struct<session_id:string,value:string,source:string,ts:string,runtime:string,text:string>>"
BUNDLE_VERSION = 1


def scalar_text(v: Column, t: Column) -> Column:
    """A JSON scalar as text, the way the store's writers show it: true is True, null is None, a missing key is empty."""
    return F.when(t == "boolean", F.initcap(v)).when(t == "null", F.lit("None")).when(t.isNull(), F.lit("")).otherwise(v)


def read_label_store(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, aspect, ts, file, line, runtime, value, note, source of all *.ndjson; bad lines are skipped.

    file and line give the order of the store, for ties of ts. Null, empty and false session ids drop the record; null
    ts is empty; null runtime stays null; a missing folder gives no records.
    """
    if not files.exists(spark, folder):
        return spark.createDataFrame([], "session_id string, aspect string, ts string, file string, line long, runtime string, value string, note string, source string")
    lines = spark.read.option("wholetext", False).text(folder, pathGlobFilter="*.ndjson").select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    # within one block rows keep their order; blocks of a file are ordered by where they start
    lines = lines.withColumn("line", F.shiftleft("block", 24) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    v = F.try_parse_json("value")
    ok = lines.where(F.trim("value") != "").withColumn("v", v).where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))

    def field(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
        kind = F.when(kind == "BOOLEAN", F.lit("boolean")).when(kind == "VOID", F.lit("null")).when(kind.isNull(), F.lit(None)).otherwise(F.lit("text"))
        return scalar_text(F.try_variant_get("v", f"$.{name}", "string"), kind)

    nullable = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    out = ok.select(
        nullable("session_id").alias("session_id"), nullable("aspect").alias("aspect"), F.coalesce(nullable("ts"), F.lit("")).alias("ts"), "file", "line", nullable("runtime").alias("runtime"), field("value").alias("value"), field("note").alias("note"),
        field("source").alias("source"),
    )
    return out.where(F.col("session_id").isNotNull() & ~F.col("session_id").isin("", "0", "false", "[]", "{}"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line ends the read, blank lines don't count."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_bundle(spark: SparkSession, path: str, aspect: str) -> DataFrame:
    """Labels of an exported bundle; its version and aspect must be the ones asked for."""
    b = spark.read.schema(BUNDLE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    head = b.select("schema_version", "aspect").first()
    if head is None or head["schema_version"] != BUNDLE_VERSION or head["aspect"] != aspect:
        raise ValueError(f"bundle holds version and aspect {tuple(head) if head else None}, wanted {(BUNDLE_VERSION, aspect)}")
    return b.select(F.explode("labels").alias("l")).select("l.*")


def run_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame]) -> DataFrame:
    """SQL over the given views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def sessions_view(events: DataFrame) -> DataFrame:
    """runtime, session_id, last_ts, newest first."""
    return events.groupBy("runtime", "session_id").agg(F.max("ts").alias("last_ts")).orderBy(F.desc("last_ts"), "session_id")


def read_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(VERDICT).option("mode", "FAILFAST").json(f"{folder}/*.jsonl")


def artifacts(spark: SparkSession, folder: str) -> list[dict]:
    """Metrics of each artifact below a model's folder, oldest first; the last is the active one."""
    found = []
    for place in [folder, *(f"{folder}/{x}" for x in files.folders(spark, folder))]:
        if files.exists(spark, f"{place}/metrics.json"):
            found.append(json.loads(files.read_text(spark, f"{place}/metrics.json")) | {"folder": place})
    return sorted(found, key=lambda m: m.get("trained_at", ""))
