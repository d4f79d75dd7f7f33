"""Writers: ordered JSON lines, atomic reports, append with resume, write-once splits, manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources import files


def write_jsonl(df: DataFrame, path: str, order: list[str], partitions: int | None = None) -> None:
    """JSON lines in a given order: one file for small results, ranges of the order for large ones."""
    out = df.orderBy(*order).coalesce(1) if partitions is None else df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    out.write.mode("overwrite").json(path)


def write_report(path: str, report: dict) -> None:
    """Whole or not at all, on whatever file system the path names."""
    files.write_text(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), path, json.dumps(report, sort_keys=True, ensure_ascii=False))


def append_new(df: DataFrame, path: str, ident: str) -> int:
    """Appends the rows whose id isn't there yet and returns their number; a second run adds none."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).select(ident)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    new = df if there is None else df.join(there, ident, "left_anti")
    new = new.dropDuplicates([ident]).persist()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def freeze_split(path: str, fraction: float, seed: int, created_at: str, held: DataFrame, minimums_met: bool = True) -> tuple[dict, DataFrame]:
    """(head, session ids) of the split at path: written once, after the minimums are met, and from then on read, whatever
    is asked for. The ids lie in a table beside the head, so their number isn't bounded by one file or the driver."""
    spark = held.sparkSession
    ids = f"{path}.ids"
    if not files.exists(spark, path):
        if not minimums_met:
            raise ValueError("too few rows or classes to freeze a split")
        held.select("session_id").distinct().write.mode("overwrite").parquet(ids)
        files.write_text(spark, path, json.dumps({"fraction": fraction, "seed": seed, "created_at": created_at, "sessions": spark.read.parquet(ids).count()}), once=True)
    return json.loads(files.read_text(spark, path)), spark.read.parquet(ids)


#: A bundle is one document; a larger selection is written as JSON lines.
BUNDLE_ROWS = 50_000


def export_bundle(labels: DataFrame, aspect: str, path: str) -> None:
    """Selected labels with their texts as one document; more than BUNDLE_ROWS of them are refused."""
    n = labels.count()
    if n > BUNDLE_ROWS:
        raise ValueError(f"{n} labels are too many for a bundle (at most {BUNDLE_ROWS}): write them as JSON lines")
    rows = [r.asDict() for r in labels.select("session_id", "value", "source", "ts", "runtime", "text").orderBy("session_id").toLocalIterator()]
    write_report(path, {"schema_version": 1, "aspect": aspect, "labels": rows})


def content_name(data: bytes, spec: bytes) -> str:
    return hashlib.sha256(data + spec).hexdigest()


def append_labels(labels: DataFrame, known_sessions: DataFrame, path: str) -> None:
    """Appends labels of known sessions to a store of JSON lines."""
    labels.join(known_sessions.select("session_id").distinct(), "session_id", "left_semi").write.mode("append").json(path)


def manifest(df_or_spark, folder: str) -> DataFrame:
    """path, bytes, sha256 of each file in a folder, in order."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    f = spark.read.format("binaryFile").load(folder)
    return f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def verify_parts(parts: list[tuple[str, int, str]]) -> None:
    """Each part (file, bytes, sha256), in order, must be what the manifest says."""
    for file, size, digest in parts:
        with open(file, "rb") as f:
            data = f.read()
        if len(data) != size or hashlib.sha256(data).hexdigest() != digest:
            raise ValueError(f"{file} isn't the file of the manifest")


def write_batches(df: DataFrame, size: int, order: list[str], path: str) -> None:
    """Reviewer files of `size` rows each, one folder a batch."""
    from skein.operators.splits import batches

    batches(df, size, order).write.mode("overwrite").partitionBy("batch").json(path)
