"""The append-only label store: latest records, selections, labelled and unlabelled sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import trim_ws
from skein.functions.timefn import instant_micros


def latest(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest record per key by `order` (ties go on to the next column); combines before the shuffle."""
    rest = [c for c in records.columns if c not in keys and c not in order]
    best = records.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in [*order, *rest]])


def latest_labels(records: DataFrame) -> DataFrame:
    """Newest record per (session_id, aspect): ts as text (null is empty), then file, then line; later wins ties."""
    r = records.where("session_id is not null").withColumn("ts", F.coalesce("ts", F.lit("")))
    return latest(r, ["session_id", "aspect"], ["ts", "file", "line"])


def since_ok(ts: Column, since: str) -> Column:
    """Whether an instant isn't before `since`; unreadable instants are before everything."""
    return F.coalesce(instant_micros(ts) >= instant_micros(F.lit(since)), F.lit(False))


def select_labels(labels: DataFrame, aspect: str, evaluator: str | None = None, runtimes: list[str] | None = None, since: str | None = None, values: list[str] | None = None) -> DataFrame:
    """Filter chain of a job's scope over the latest labels."""
    out = labels.where(F.col("aspect") == aspect)
    if evaluator is not None:
        out = out.where(trim_ws(F.col("source")) == evaluator)
    if runtimes is not None:
        out = out.where(F.col("runtime").isin(*runtimes))
    if since is not None:
        out = out.where(since_ok(F.col("ts"), since))
    if values is not None:
        out = out.where(F.col("value").isin(*values))
    return out


def unlabeled(sessions: DataFrame, labels: DataFrame) -> DataFrame:
    return sessions.join(labels.select("session_id").distinct(), "session_id", "left_anti")


def labeled(sessions: DataFrame, labels: DataFrame) -> DataFrame:
    return sessions.join(labels.select("session_id").distinct(), "session_id", "left_semi")


def with_text(labels: DataFrame, texts: DataFrame, min_chars: int = 0) -> DataFrame:
    """Labels with their session's text and why they can't be used: no_text, too_short or usable."""
    joined = labels.join(texts.select("session_id", "text"), "session_id", "left")
    blank = F.coalesce(trim_ws(F.col("text")), F.lit("")) == ""
    return joined.withColumn("status", F.when(blank, F.lit("no_text")).when(F.length("text") < min_chars, F.lit("too_short")).otherwise(F.lit("usable")))


def bundle(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Left join of labels with texts; the label's runtime before the text's."""
    t = texts.select("session_id", "text", F.col("runtime").alias("_rt"))
    return labels.join(t, "session_id", "left").withColumn("runtime", F.coalesce("runtime", "_rt")).drop("_rt")


def class_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def enough(counts: dict[str, int], minimum: int = 8, classes: int = 2) -> bool:
    """Whether a selection has the least number of labels and classes to train on."""
    return sum(counts.values()) >= minimum and len(counts) >= classes
