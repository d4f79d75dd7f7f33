"""Reproducible samples that keep their members as the data grow.

A session id is a number below 2**56. A keyed Feistel network permutes that fixed domain; an id is selected when its
permuted value lies under fraction x 2**56. The choice depends on nothing but id, seed and fraction, so it is the same
in each run and partitioning, and no new record can remove an id. The permutation is free of collisions and can be
inverted, so permuted values also serve as exact keys.

Defined cases: ids that aren't 14 hex digits once blanks, capitals and a runtime in front are removed lie outside the
domain and are left out; a null seed or fraction selects nothing; a fraction of 1 or more selects all; repeated ids give
one row; null arrays hold no ids; an unreadable created_at counts as the earliest time and equal times go by frozen_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import bare_session_id
from skein.functions.timefn import instant_micros

HEX_DIGITS = 14
HALF_BITS = 28
MASK = (1 << HALF_BITS) - 1
DOMAIN = 1 << (2 * HALF_BITS)
ROUNDS = 6
SALTS = 64


def domain_id(bare: Column) -> Column:
    """Number of a bare session id; null outside the domain."""
    return F.when(bare.rlike(f"^[0-9a-f]{{{HEX_DIGITS}}}$"), F.conv(bare, 16, 10).cast("long"))


def _network(x: Column, seed: Column, rounds: Column) -> Column:
    """The rounds as one fold, so that the expression stays small whatever x is."""
    start = F.transform(F.array(x), lambda v: F.struct(F.shiftright(v, HALF_BITS).alias("l"), v.bitwiseAND(F.lit(MASK)).alias("r")))[0]

    def step(s: Column, k: Column) -> Column:
        return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(F.xxhash64(s["r"], seed, k).bitwiseAND(F.lit(MASK))).alias("r"))

    return F.aggregate(rounds, start, step, lambda s: F.shiftleft(s["l"], HALF_BITS).bitwiseOR(s["r"]))


def _swap(x: Column) -> Column:
    return F.transform(F.array(x), lambda v: F.shiftleft(v.bitwiseAND(F.lit(MASK)), HALF_BITS).bitwiseOR(F.shiftright(v, HALF_BITS)))[0]


def permute(x: Column, seed: Column) -> Column:
    return _network(x, seed, F.array(*[F.lit(k) for k in range(ROUNDS)]))


def invert(y: Column, seed: Column) -> Column:
    """The same network backwards with its halves swapped."""
    return _swap(_network(_swap(y), seed, F.array(*[F.lit(k) for k in reversed(range(ROUNDS))])))


def hex_id(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), HEX_DIGITS, "0"))


def selected(x: Column, seed: Column, fraction: Column) -> Column:
    """Whether the id number x belongs to the sample; null arguments give false."""
    return F.coalesce(permute(x, seed) < (fraction * F.lit(float(DOMAIN))), F.lit(False))


def job_specs(frozen: DataFrame) -> DataFrame:
    """Each job with each seed and fraction its records name; a job is named after its aspect with numbers behind a dash."""
    return frozen.select(F.regexp_extract("job", r"^(.*?)(?:-\d+)*$", 1).alias("aspect"), "job", "seed", "fraction").distinct()


def sample(labels: DataFrame, specs: DataFrame) -> DataFrame:
    """aspect, job, seed, fraction, session_id: the labelled sessions of its aspect that each spec selects.

    An aspect can hold a large share of the sessions, so they meet the specs in SALTS parts of each aspect.
    """
    have = labels.select("aspect", domain_id(bare_session_id(F.col("session_id"))).alias("x")).where("x is not null").distinct()
    spread = specs.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    got = have.withColumn("_part", F.pmod("x", F.lit(SALTS)).cast("int")).join(spread, ["aspect", "_part"]).where(selected(F.col("x"), F.col("seed"), F.col("fraction")))
    return got.select("aspect", "job", "seed", "fraction", hex_id(F.col("x")).alias("session_id"))


def previous_records(frozen: DataFrame) -> DataFrame:
    """frozen_id and prev_id, the record before it by time with the same job, seed and fraction.

    Months are summarised first, so that no task sorts all records of one job.
    """
    made = F.coalesce(instant_micros(F.col("created_at")), F.lit(-(2**62)))
    r = frozen.where("frozen_id is not null").select("job", "seed", "fraction", "frozen_id", made.alias("t")).distinct()
    r = r.withColumn("month", F.when(F.col("t") > -(2**62), F.date_format(F.timestamp_micros("t"), "yyyyMM").cast("int")).otherwise(F.lit(0)))
    key = ["job", "seed", "fraction"]
    last = r.groupBy(*key, "month").agg(F.max(F.struct("t", "frozen_id"))["frozen_id"].alias("_last"))
    carried = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*key).orderBy("month")))
    inside = r.withColumn("_prev", F.lag("frozen_id").over(Window.partitionBy(*key, "month").orderBy("t", "frozen_id")))
    c = carried.select(*[F.col(k).alias(f"_{k}") for k in [*key, "month"]], "_before")
    on = F.col("month") == F.col("_month")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return inside.join(c, on).select("frozen_id", "job", "seed", F.coalesce("_prev", "_before").alias("prev_id")).where("prev_id is not null")


def broken_records(frozen: DataFrame, labels: DataFrame) -> DataFrame:
    """frozen_id, session_id that the record before holds, this one doesn't, and the label store has a label for.

    Ids are compared by their permuted values, which are exact keys (one permutation for all records, so that labels are
    permuted once), and inverted for the result; nothing is drawn here.
    """
    seed = F.coalesce(F.col("seed"), F.lit(0)).cast("long")
    codes = F.array_distinct(F.filter(F.transform(F.coalesce("session_ids", F.array()), lambda s: permute(domain_id(bare_session_id(s)), F.lit(0).cast("long"))), lambda v: v.isNotNull()))
    ids = frozen.where("frozen_id is not null").groupBy("frozen_id").agg(F.first("seed").alias("seed"), F.flatten(F.collect_list("session_ids")).alias("session_ids"))
    ids = ids.select("frozen_id", seed.alias("seed"), codes.alias("codes"))
    pairs = previous_records(frozen).select("frozen_id", "prev_id")
    now = ids.select("frozen_id", F.col("codes").alias("now"))
    before = ids.select(F.col("frozen_id").alias("prev_id"), F.col("codes").alias("before"))
    lost = pairs.join(now, "frozen_id").join(before, "prev_id").select("frozen_id", F.explode(F.array_except("before", "now")).alias("code"))
    stored = labels.select(permute(domain_id(bare_session_id(F.col("session_id"))), F.lit(0).cast("long")).alias("code")).where("code is not null").distinct()
    return lost.join(stored, "code", "left_semi").select("frozen_id", hex_id(invert(F.col("code"), F.lit(0).cast("long"))).alias("session_id"))
