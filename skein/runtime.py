"""Session-level helpers shared by every operator: lineage cuts and skew-safe physical building blocks."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key that holds at least 1/HOT_SHARE of the rows is hot, so there are never more than HOT_SHARE hot keys.
HOT_SHARE = 1000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the one the cluster names in spark.checkpoint.dir.

    Only a local session, as in tests, gets a folder of its own where none is named: on a cluster the folder must be shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a shared folder in spark.checkpoint.dir")
    own = tempfile.mkdtemp(prefix="skein-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the checkpoint folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys with at least 1/share of the non-null rows of df; at most `share` rows by counting."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    total = counts.agg(F.sum("count").alias("_all"))
    return counts.join(F.broadcast(total), F.col("count") * share >= F.col("_all")).select(key)


def skew_lookup(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None = None, how: str = "left") -> DataFrame:
    """Join left with right (unique by key) where some keys may hold a large share of left.

    Rows of hot keys meet a broadcast of the few matching rows of right (at most HOT_SHARE), all others shuffle.
    `how` is left or inner; null keys match nothing.
    """
    hot = hot_keys(left, key) if hot is None else hot
    mark = hot.select(key, F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(mark), key, "left")
    cold, warm = marked.where(F.col("_hot").isNull()).drop("_hot"), marked.where("_hot").drop("_hot")
    few = right.join(F.broadcast(hot), key, "left_semi")
    return cold.join(right, key, how).unionByName(warm.join(F.broadcast(few), key, how))


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, bucket: str, out: str) -> DataFrame:
    """Running sum of value before each row by order within group, without a task that sorts a whole group.

    `bucket` is an integer column that never decreases along `order`; sums run within (group, bucket) and a second
    window over the bucket totals carries them on.
    """
    keys = list(group)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # null-safe: a group key may be null
    b = base.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(bucket).alias("_kb"), "_base")
    on = (F.col(bucket) == F.col("_kb"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(b, on)
        .withColumn(out, F.col("_in") + F.col("_base"))
        .drop("_in", "_base", "_kb", *[f"_k{i}" for i in range(len(keys))])
    )


def row_numbers(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Adds the place of each row (from 0) in an order over all rows; no task sorts more than a range of the order."""
    ranges = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1)))
    return prefix_sums(ranges, ["_all"], order, "_one", "_range", out).drop("_all", "_one", "_range")


def ship(spark: SparkSession, model):
    """Broadcast of a fitted model (of bounded size) with its code; the function that is returned loads it once a worker."""
    import secrets

    raw = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    name = secrets.token_hex(8)

    def load():
        import pickle
        import sys

        kept = sys.__dict__.setdefault("_kept_models", {})
        if name not in kept:
            kept.clear()
            kept[name] = pickle.loads(raw.value)
        return kept[name]

    return load
