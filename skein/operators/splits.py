"""Holdouts, folds, hash splits and oversampling, all keyed by hashes and therefore repeatable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.numbers import shuffle_key
from skein.runtime import row_numbers


def ranked(df: DataFrame, group: str, ident: str, seed: int) -> DataFrame:
    """Adds rank (from 1) in a class's shuffled order and the class's size n.

    The order is that of a hash; its first two digits are ranked on their own and carried on, so a class of any size
    is spread over 256 tasks.
    """
    d = df.withColumn("_key", shuffle_key(seed, F.col(group), F.col(ident))).withColumn("_part", F.substring("_key", 1, 2))
    sizes = d.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_c"))
    by = Window.partitionBy(group).orderBy("_part")
    base = sizes.select(
        F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_c").over(Window.partitionBy(group)).alias("n")
    )
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy("_key", ident))
    return d.withColumn("_in", inside).join(base, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).withColumn("rank", F.col("_in") + F.col("_base")).drop("_key", "_part", "_in", "_g", "_p", "_base")


def stratified_holdout(labels: DataFrame, fraction: float, seed: int, group: str = "value", ident: str = "session_id") -> DataFrame:
    """Adds side (holdout or train): least(n-1, greatest(1, floor(n*fraction))) of each class of two or more."""
    r = ranked(labels, group, ident, seed)
    k = F.least(F.col("n") - 1, F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(fraction))))
    return r.withColumn("side", F.when((F.col("n") >= 2) & (F.col("rank") <= k), F.lit("holdout")).otherwise(F.lit("train"))).drop("rank", "n")


def folds(labels: DataFrame, seed: int, most: int = 5, group: str = "value", ident: str = "session_id") -> DataFrame:
    """Adds fold: position in the class's shuffled order modulo most."""
    return ranked(labels, group, ident, seed).withColumn("fold", ((F.col("rank") - 1) % most).cast("int")).drop("rank", "n")


def frozen_sides(labels: DataFrame, frozen_ids: DataFrame) -> DataFrame:
    """Adds side by the frozen ids: what was held out once stays out, later sessions can only join the training side."""
    mark = frozen_ids.select("session_id").distinct().withColumn("_f", F.lit(True))
    return labels.join(mark, "session_id", "left").withColumn("side", F.when(F.col("_f"), F.lit("holdout")).otherwise(F.lit("train"))).drop("_f")


def oversample(df: DataFrame, bucket: str, floors: dict[str, int], ident: str) -> DataFrame:
    """Adds copy (0: the row itself): rows of a bucket below its floor are repeated in turn until it is reached."""
    floor = F.element_at(F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(v))]), F.col(bucket)) if floors else F.lit(None)
    n = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    small = n.withColumn("_floor", floor).where(F.col("_n") < F.col("_floor"))
    # a bucket below its floor has fewer rows than that, so ranking it in one task is bounded
    rows = df.join(F.broadcast(small), bucket).withColumn("_i", F.row_number().over(Window.partitionBy(bucket).orderBy(ident)) - 1)
    need = F.col("_floor") - F.col("_n")
    times = F.floor((need - F.col("_i") + F.col("_n") - 1) / F.col("_n"))
    extra = rows.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("_n", "_floor", "_i")
    return df.withColumn("copy", F.lit(0)).unionByName(extra)


def batches(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Adds batch: consecutive groups of `size` rows in the given order."""
    return row_numbers(df, order, "_at").withColumn("batch", F.floor(F.col("_at") / size)).drop("_at")


def slice_sizes(counts: dict[str, int], n_test: int) -> dict[str, int]:
    """Rows that each class gives to a slice of n_test: its share, rounded half up, at least one and never all; then single
    rows move, from the largest class that can give or take one (the last of equals), until the sum is right."""
    total = sum(counts.values())
    take = {c: min(max(int(n * n_test / max(1, total) + 0.5), 1), max(n - 1, 1)) for c, n in sorted(counts.items())}
    while (have := sum(take.values())) != n_test:
        step = 1 if have < n_test else -1
        able = [c for c in take if (take[c] + 1 < counts[c] if step > 0 else take[c] > 1)]
        if not able:
            break
        take[max(able, key=lambda c: (counts[c], c))] += step
    return take


def stratified_slice(labels: DataFrame, n_test: int, seed: int, group: str = "value", ident: str = "session_id") -> DataFrame:
    """Adds side (validation or train) with n_test rows of all classes together where the classes allow it."""
    counts = {r[group]: r["count"] for r in labels.groupBy(group).count().collect()}  # a handful of classes
    take = slice_sizes(counts, n_test)
    k = F.element_at(F.create_map(*[x for c, n in take.items() for x in (F.lit(c), F.lit(n))]), F.col(group)) if take else F.lit(0)
    return ranked(labels, group, ident, seed).withColumn("side", F.when(F.col("rank") <= k, F.lit("validation")).otherwise(F.lit("train"))).drop("rank", "n")


def hash_first(df: DataFrame, text: str, n: int = 256) -> DataFrame:
    """The first n rows in the order of their text's SHA-256."""
    return df.withColumn("_h", F.sha2(text, 256)).orderBy("_h", *df.columns).limit(n).drop("_h")


def round_robin(sources: DataFrame, families: dict[str, list[str]], per_family: int, seed: int, ident: str) -> DataFrame:
    """number, family, template and the source each generated row is made from: sources in shuffled order, in turn.

    Only as many sources as there are rows to generate can be used, so no more are ranked.
    """
    names = list(families)
    total = per_family * len(names)
    key = shuffle_key(seed, F.col(ident))
    few = sources.withColumn("_k", key).orderBy("_k", ident).limit(total).drop("_k")
    ordered = few.withColumn("_place", F.row_number().over(Window.orderBy(shuffle_key(seed, F.col(ident)), ident)) - 1)
    n = few.agg(F.count(F.lit(1)).alias("_n"))
    spark = sources.sparkSession
    slots = spark.range(total).select(F.col("id").alias("number")).join(F.broadcast(n), F.lit(True)).where("_n > 0").withColumn("_place", (F.col("number") % F.col("_n")).cast("int"))
    family = F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(F.col("number") / per_family) + 1).cast("int"))
    index = F.col("number") % per_family
    template = F.lit(None).cast("string")
    for name, texts in families.items():
        template = F.when(family == name, F.element_at(F.array(*[F.lit(t) for t in texts]), (index % len(texts) + 1).cast("int"))).otherwise(template)
    return slots.withColumn("family", family).withColumn("template", template).join(ordered, "_place").drop("_place", "_n")
