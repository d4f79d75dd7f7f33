"""Session text: ordered concatenation with a cap, and session listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import trim_ws
from skein.runtime import prefix_sums

TEXT_CAP = 12_000


def session_texts(events: DataFrame, cap: int = TEXT_CAP, bucket: str | None = None) -> DataFrame:
    """session_id, runtime (of the first event), text: the events' texts in order, joined by line ends, up to cap characters.

    events: session_id, runtime, ord, text. Only events that begin within the cap are gathered, so a session of any
    size gives one task at most cap + 1 texts; where `bucket` names an integer column that never decreases along ord,
    the running length is summed in two levels and no task sorts a whole session.
    """
    e = events.where("session_id is not null and text is not null")
    e = e.withColumn("_len", F.length("text") + 1)
    e = e.withColumn("_bucket", F.col(bucket) if bucket else F.lit(0))
    placed = prefix_sums(e.select("session_id", "runtime", "ord", "text", "_len", "_bucket"), ["session_id"], ["ord"], "_len", "_bucket", "_at")
    near = placed.where(F.col("_at") <= cap).withColumn("text", F.expr(f"substring(text, 1, {cap})"))
    parts = near.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("p"), F.min(F.struct("ord", "runtime"))["runtime"].alias("runtime"))
    return parts.select("session_id", "runtime", F.expr(f"substring(array_join(transform(p, x -> x.text), '\n'), 1, {cap})").alias("text"))


def sessions_listing(events: DataFrame) -> DataFrame:
    """session_id, last_ts, events."""
    return events.groupBy("session_id").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"))


def usable_text(texts: DataFrame, min_chars: int) -> DataFrame:
    return texts.where((trim_ws(F.col("text")) != "") & (F.length("text") >= min_chars))
