"""The project's tables as the engine's inputs: label records, events, texts, goals, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import bare_session_id, trim_ws
from skein.runtime import read_table

DECISION = "action string, goal_ref string, lifecycle_evidence string, title string"
ENVELOPE = "text string, candidates array<struct<ref:string,title:string,status:string,score:double,same_session:boolean>>, turn_index long, local_day string"


def label_records(spark: SparkSession, d: str) -> DataFrame:
    """session_id, aspect, ts, file, line, runtime, value, note, source."""
    t = read_table(spark, d, "session_labels")
    return t.select(bare_session_id(F.col("session_id")).alias("session_id"), "aspect", "ts", F.lit("").alias("file"), F.col("label_id").alias("line"), "runtime", "value", "note", "source")


def text_events(spark: SparkSession, d: str) -> DataFrame:
    """session_id, runtime, ord, text, bucket of the transcript exports."""
    t = read_table(spark, d, "session_texts")
    number = F.regexp_replace("text_id", r"\D", "").cast("long")
    return t.select(bare_session_id(F.col("session_id")).alias("session_id"), "runtime", F.col("text_id").alias("ord"), "text", F.floor(number / 1000).alias("bucket"))


def goals(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "goal_rows").withColumn("session_id", bare_session_id(F.col("session_id")))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """id, split_day, runtime, target (decision), envelope, user content of training_rows."""
    t = read_table(spark, d, "training_rows")
    first = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))["content"]
    return t.select(
        "id", "split_day", F.get_json_object("metadata", "$.runtime").alias("runtime"), F.from_json(first("assistant"), DECISION).alias("target"), first("assistant").alias("answer"),
        F.from_json(first("user"), ENVELOPE).alias("envelope"), first("user").alias("content"),
    )


def word_texts(spark: SparkSession, d: str) -> DataFrame:
    """doc, text of all documents with text."""
    return read_table(spark, d, "documents").where(trim_ws(F.col("text")) != "").select(F.col("doc_id").alias("doc"), "text")
