"""Best representative of each duplicate group: skyline selection with field-wise filling.

A group is one bare session id and one aspect. Each record has three dimensions: which of its fields are filled
(completeness, compared as a set), the trust of its source kind and its instant (recency). A record is dominated when
another fills at least the same fields with at least its trust and recency and is better in one of them; the larger
label_id decides between equals. The records that nothing dominates form layer 1. The lexicographic policy (trust,
instant, label_id) picks the best record of a layer; fields it leaves blank come from the best filler of the same layer
and then of the next ones.

The skyline of a union is the skyline of the skylines, and for one completeness set and one trust level only the latest
record can survive. So records are first reduced by a hash aggregate per (session, aspect, filled set, trust): at most
8 x (levels of trust) candidates a group reach the second step, whatever the size of the group, and both steps combine
before their shuffle.

Defined cases: null or blank session ids and null aspects are left out; unreadable or null ts is the earliest instant;
unknown or null source kinds have the lowest trust; a field that no record fills gives -1; repeated rows with one
label_id count as one record; columns beyond those used are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import bare_session_id, is_blank_value, trim_ws
from skein.functions.timefn import instant_micros

FIELDS = ("value", "note", "runtime")
#: ts (microseconds, moved to be positive) and label_id are packed into one DECIMAL(38,0), which hash aggregates can hold.
_SHIFT_TS, _SHIFT_ID, _STEP = 2**62, 2**63, "18446744073709551616"
NO_TRUST = -(2**31)


def _dec(c: Column | str) -> Column:
    return (F.lit(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def records(labels: DataFrame, trust: DataFrame) -> DataFrame:
    """Labels as (session_id, aspect, mask, trust, rank, record): rank orders by instant, then label_id."""
    kinds = trust.select(F.lower(trim_ws(F.col("source_kind"))).alias("_kind"), F.col("trust").cast("long").alias("_trust"))
    kinds = kinds.groupBy("_kind").agg(F.max("_trust").alias("_trust"))
    mask = sum((F.when(is_blank_value(F.col(f)), F.lit(0)).otherwise(F.lit(1 << i)) for i, f in enumerate(FIELDS)), F.lit(0))
    micros = F.coalesce(instant_micros(F.col("ts")), F.lit(-_SHIFT_TS))
    rank = ((_dec(micros) + _dec(str(_SHIFT_TS))).cast("decimal(19,0)") * F.lit(_STEP).cast("decimal(20,0)")).cast("decimal(38,0)") + (_dec(F.col("label_id")) + _dec(str(_SHIFT_ID))).cast("decimal(38,0)")
    return (
        labels.select(
            bare_session_id(F.col("session_id")).alias("session_id"), "aspect", F.col("label_id").cast("long").alias("label_id"),
            F.lower(trim_ws(F.substring_index(F.col("source"), ":", 1))).alias("_kind"), mask.alias("mask"), rank.cast("decimal(38,0)").alias("rank"),
        )
        .where(F.col("session_id").isNotNull() & F.col("aspect").isNotNull() & F.col("label_id").isNotNull())
        # source_trust lists the kinds of sources and doesn't grow with the data
        .join(F.broadcast(kinds), "_kind", "left")
        .withColumn("trust", F.coalesce("_trust", F.lit(NO_TRUST)))
        .drop("_kind", "_trust")
    )


def skyline(labels: DataFrame, trust: DataFrame) -> DataFrame:
    """One row per session and aspect: n records and `layers`, the candidates with their layer number, best first."""
    per = records(labels, trust).groupBy("session_id", "aspect", "mask", "trust").agg(
        F.max("rank").alias("rank"), F.count("label_id").alias("n"), F.min("label_id").alias("lo"), F.max("label_id").alias("hi")
    )
    groups = per.groupBy("session_id", "aspect").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.collect_list(F.struct("trust", "rank", "mask")).alias("c"),
    )
    beats = lambda a, b: (
        (a["mask"].bitwiseAND(b["mask"]) == b["mask"]) & (a["trust"] >= b["trust"]) & (a["rank"] >= b["rank"])
        & ((a["mask"] != b["mask"]) | (a["trust"] > b["trust"]) | (a["rank"] > b["rank"]))
    )
    # candidates come best first by the policy, so all that dominate one stand before it: one pass gives every layer
    best_first = F.sort_array("c", asc=False)
    layer_of = lambda acc, x: F.concat(
        acc,
        F.array(F.struct(
            (F.coalesce(F.array_max(F.transform(F.filter(acc, lambda a: beats(a, x)), lambda a: a["layer"])), F.lit(0)) + 1).alias("layer"),
            x["trust"].alias("trust"), x["rank"].alias("rank"), x["mask"].alias("mask"),
        )),
    )
    zero = F.expr("cast(array() as array<struct<layer:int,trust:bigint,rank:decimal(38,0),mask:int>>)")
    return groups.select("session_id", "aspect", "n", "lo", "hi", F.aggregate(best_first, zero, layer_of).alias("layers"))


def _label_id(rank: Column) -> Column:
    return ((rank % F.lit(_STEP).cast("decimal(38,0)")).cast("decimal(20,0)") - _dec(str(_SHIFT_ID))).cast("long")


def survivors(labels: DataFrame, trust: DataFrame) -> DataFrame:
    """session_id, aspect, n, best_label and for each field the label_id that gives its value (-1: none)."""
    sky = skyline(labels, trust)

    def source(bit: int) -> Column:
        fills = F.filter("layers", lambda x: x["mask"].bitwiseAND(F.lit(bit)) != 0)
        first = F.array_min(F.transform(fills, lambda x: x["layer"]))
        # within the first layer that fills the field, the policy's best comes first
        return F.coalesce(_label_id(F.get(F.filter(fills, lambda x: x["layer"] == first), F.lit(0))["rank"]), F.lit(-1).cast("long"))

    best = F.get(F.filter("layers", lambda x: x["layer"] == 1), F.lit(0))["rank"]
    return sky.select(
        "session_id", "aspect", "n", "lo", "hi", _label_id(best).alias("best_label"), *[source(1 << i).alias(f"{f}_from") for i, f in enumerate(FIELDS)]
    )


def found(labels: DataFrame, trust: DataFrame) -> DataFrame:
    """Groups of two or more records (different label_ids)."""
    return survivors(labels, trust).where((F.col("n") > 1) & (F.col("lo") < F.col("hi"))).select("session_id", "aspect", *[f"{f}_from" for f in FIELDS])


def merged(labels: DataFrame, trust: DataFrame) -> DataFrame:
    """One built record per session and aspect with its surviving values."""
    s = survivors(labels, trust).select("session_id", "aspect", "n", "best_label", *[f"{f}_from" for f in FIELDS])
    picks = s.select("session_id", "aspect", "n", "best_label", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_from").alias("label_id")) for f in FIELDS])).alias("p"))
    picks = picks.select("session_id", "aspect", "n", "best_label", "p.field", "p.label_id")
    rows = labels.groupBy(F.col("label_id").cast("long").alias("label_id")).agg(*[F.max(f).alias(f) for f in FIELDS]).withColumn("_s", F.lit(0))
    # a field that no record fills meets nothing; such picks, which can be most, are spread by their group
    picks = picks.withColumn("_s", F.when(F.col("label_id") == -1, F.pmod(F.xxhash64("session_id", "aspect"), F.lit(4096)).cast("int") + 1).otherwise(F.lit(0)))
    got = picks.join(rows, ["label_id", "_s"], "left")
    return got.groupBy("session_id", "aspect", "n", "best_label").agg(*[F.max(F.when(F.col("field") == f, F.col(f))).alias(f) for f in FIELDS])
