"""Evaluation reports and quality gates over prediction and verdict tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.numbers import share, trigrams


def holdout_report(preds: DataFrame) -> DataFrame:
    """value, n, correct, accuracy of preds (gold, pred); classes without a hit are listed too."""
    hit = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    return preds.groupBy(F.col("gold").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("correct")).withColumn("accuracy", share(F.col("correct"), F.col("n")))


def confusion(preds: DataFrame) -> DataFrame:
    return preds.where("gold is distinct from pred").groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def counted_with_zeros(rows: DataFrame, column: str, domain: tuple[str, ...], other: str) -> DataFrame:
    """column, n for every value of the domain and `other` for all the rest, zeros included."""
    d = rows.sparkSession.createDataFrame([(v,) for v in (*domain, other)], f"{column} string")
    c = rows.select(F.when(F.col(column).isin(*domain), F.col(column)).otherwise(F.lit(other)).alias(column)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return d.join(c, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def judge_aggregate(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """judged, acceptable, unacceptable, failed, agreement_rate of verdicts (null or other: failed)."""
    ok, bad = F.col("verdict") == "acceptable", F.col("verdict") == "unacceptable"
    g = verdicts.groupBy(*by).agg(F.count_if(ok | bad).alias("judged"), F.count_if(ok).alias("acceptable"), F.count_if(bad).alias("unacceptable"), F.count_if(~F.coalesce(ok | bad, F.lit(False))).alias("failed"))
    return g.withColumn("agreement_rate", share(F.col("acceptable"), F.col("judged")))


def second_review(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping buckets: a label counts as nonsensical by itself or together with the other side."""
    v = F.col("verdict")
    return verdicts.groupBy(*by).agg(
        F.count_if(v == "both-sensible").alias("sensible"), F.count_if(v.isin("label-nonsensical", "both-nonsensical")).alias("label_nonsensical"),
        F.count_if(v.isin("student-nonsensical", "both-nonsensical")).alias("student_nonsensical"), F.bool_and(F.coalesce(v == "both-sensible", F.lit(False))).alias("passed"),
    )


def audit(rows: DataFrame, by: list[str], allowed: int = 50) -> DataFrame:
    """Counts of verdicts and whether at most one in `allowed` is wrong and none unjudged or dangerous (columns verdict, dangerous)."""
    v = F.col("verdict")
    a = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v == "wrong").alias("wrong"), F.count_if(~F.coalesce(v.isin("right", "wrong"), F.lit(False))).alias("unjudgeable"), F.count_if((v == "wrong") & F.col("dangerous")).alias("dangerous")
    )
    return a.withColumn("wrong_rate", share(F.col("wrong"), F.col("n"))).withColumn("passed", (F.col("wrong") <= F.floor(F.col("n") / allowed)) & (F.col("unjudgeable") == 0) & (F.col("dangerous") == 0))


def decision_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Accuracies of a predicted against a target decision (structs `target`, `prediction`, `valid`); an invalid prediction
    is right in nothing. exact_json compares all fields, the target with an empty title."""
    t, p = F.col("target"), F.col("prediction")
    same = lambda k: F.coalesce(F.col("valid") & (t[k] == p[k]), F.lit(False))
    joint = same("action") & same("goal_ref") & same("lifecycle_evidence")
    exact = joint & (F.coalesce(p["title"], F.lit("")) == "")
    mean = lambda c: F.bround(F.avg(c.cast("double")), 4)
    finish = F.coalesce(F.col("valid") & (p["action"] == "finishGoal"), F.lit(False))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), mean(F.col("valid")).alias("valid_json"), mean(same("action")).alias("action_accuracy"), mean(same("goal_ref")).alias("goal_ref_accuracy"), mean(same("lifecycle_evidence")).alias("evidence_accuracy"),
        mean(joint).alias("joint_accuracy"), mean(exact).alias("exact_json"), share(F.count_if(finish & (t["action"] == "finishGoal")), F.count_if(finish)).alias("finish_precision"),
    )


def error_dimensions(fields: list[str]) -> Column:
    """Names of the fields in which target and prediction differ, joined by +."""
    differs = [F.when(~F.col("target")[f].eqNullSafe(F.col("prediction")[f]), F.lit(f)) for f in fields]
    return F.array_join(F.array_compact(F.array(*differs)), "+")


def percentiles(df: DataFrame, group: str, value: str, cuts: dict[str, int]) -> DataFrame:
    """Positional percentiles sorted[n*q//100] (no interpolation) and the maximum per group.

    Equal values are counted first, so what is ordered per group are its different values.
    """
    from pyspark.sql.window import Window

    c = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group)
    run = c.withColumn("_upto", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    pick = lambda q: F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * q / 100), F.col(value)))
    return run.groupBy(group).agg(F.max("_n").alias("n"), *[pick(q).alias(k) for k, q in cuts.items()], F.max(value).alias("max"))


def chrf_scores(pairs: DataFrame, ident: str, reference: str, candidate: str) -> DataFrame:
    """ident, chrf: F1 of the character triples of two texts as multisets, counted by a combining aggregate."""
    a, b = trigrams(F.col(reference)), trigrams(F.col(candidate))
    side = lambda g, k: F.transform(g, lambda x: F.struct(x.alias("g"), F.lit(k).alias("s")))
    p = pairs.where(F.col(reference).isNotNull() & F.col(candidate).isNotNull()).select(ident, F.explode(F.concat(side(a, 1), side(b, 2))).alias("x"))
    per = p.groupBy(ident, F.col("x.g").alias("g")).agg(F.count_if(F.col("x.s") == 1).alias("na"), F.count_if(F.col("x.s") == 2).alias("nb"))
    total = per.groupBy(ident).agg(F.sum(F.least("na", "nb")).alias("both"), F.sum("na").alias("a"), F.sum("nb").alias("b"))
    return total.select(ident, (2 * F.col("both") / (F.col("a") + F.col("b"))).alias("chrf"))


def style_audit(verdicts: DataFrame) -> DataFrame:
    """Means of each candidate, the student's gain and delta, and whether all gates hold, in one row.

    verdicts: id, candidate (base or student), semantic_fidelity, voice_match, ai_boilerplate, passed.
    """
    mean = lambda who, c: F.avg(F.when(F.col("candidate") == who, F.col(c).cast("double"))).alias(f"{who}_{c}")
    m = verdicts.agg(*[mean(who, c) for who in ("base", "student") for c in ("semantic_fidelity", "voice_match", "ai_boilerplate", "passed")])
    m = m.withColumn("voice_gain", F.col("student_voice_match") - F.col("base_voice_match")).withColumn("semantic_delta", F.col("student_semantic_fidelity") - F.col("base_semantic_fidelity"))
    named = {"semantic_fidelity": "student_semantic_fidelity", "voice_match": "student_voice_match", "pass_rate": "student_passed", "boilerplate": "student_ai_boilerplate", "voice_gain": "voice_gain", "semantic_delta": "semantic_delta"}
    ok = F.lit(True)
    for rule, (op, limit) in STYLE_GATES.items():
        c = F.col(named[rule])
        ok = ok & F.coalesce(c >= limit if op == ">=" else c <= limit, F.lit(False))
    return m.select(*[F.bround(c, 4).alias(c) for c in m.columns], ok.alias("gates_hold"))


def similarity_gain(pairs: DataFrame, ident: str, reference: str, base: str, student: str) -> DataFrame:
    """base, student, gain: mean similarity to a reference text of two candidates, over the rows that have all three."""
    whole = pairs.where(F.col(reference).isNotNull() & F.col(base).isNotNull() & F.col(student).isNotNull())
    mean = lambda c: chrf_scores(whole, ident, reference, c).agg(F.avg("chrf").alias(c))
    both = mean(base).join(mean(student), how="cross")  # one row each
    b, s = F.col(base), F.col(student)
    return both.select(F.bround(b, 4).alias("base"), F.bround(s, 4).alias("student"), F.bround(s - b, 4).alias("gain"))


def gates(values: dict[str, float], rules: dict[str, tuple[str, float]]) -> list[str]:
    """Names of the rules (name: operator, limit) that the values break."""
    tests = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b}
    return [k for k, (op, limit) in rules.items() if k not in values or not tests[op](values[k], limit)]


#: Gates of the three model families.
DECISION_GATES = {"valid_json": (">=", 0.99), "action_accuracy": (">=", 0.90), "joint_accuracy": (">=", 0.88), "finish_precision": ("==", 1.0)}
STYLE_GATES = {"semantic_fidelity": (">=", 0.95), "voice_match": (">=", 0.80), "pass_rate": (">=", 0.90), "boilerplate": ("<=", 0.08), "voice_gain": (">=", 0.15), "semantic_delta": (">=", -0.02)}
