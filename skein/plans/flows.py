"""The flows behind the commands: run, evaluate, infer, label, curate, audit. Data in, data out; reviewers are injected."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import predicates as pred
from skein.functions.text import RUNTIMES, bare_session_id
from skein.operators import classify, curate, evaluate, labels, splits, teacher
from skein.plans.jobs import Job, SpecError, backend
from skein.runtime import cut
from skein.sources import files, sinks, stores


class NotEnoughData(ValueError):
    """Too few labels or classes; commands end with code 2."""


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def selection(job: Job, records: DataFrame, texts: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Usable labels with text, and how many were left out for what."""
    s = job.scope
    chosen = labels.select_labels(labels.latest_labels(records), s.aspect, job.evaluator, s.runtimes, s.since, s.values).where("value is not null")
    joined = cut(labels.with_text(chosen, texts, s.min_text_chars))
    counts = {r["status"]: r["count"] for r in joined.groupBy("status").count().collect()}
    usable = joined.where("status = 'usable'").drop("status")
    classes = {r["value"]: r["count"] for r in usable.groupBy("value").count().collect()}
    if not labels.enough(classes):
        raise NotEnoughData(f"{sum(classes.values())} usable labels in {len(classes)} classes")
    return usable, counts


def resolve_split(job: Job, usable: DataFrame, folder: str, created_at: str) -> tuple[DataFrame, dict]:
    """usable with side; the frozen split wins over the spec and is only written when both sides have enough."""
    if job.split is None:
        return usable.withColumn("side", F.lit("train")), {"enabled": False}
    fraction, seed = job.split
    file = f"{folder}/eval-split.json"
    if files.exists(usable.sparkSession, file):
        frozen, ids = sinks.freeze_split(file, fraction, seed, created_at, usable)
        missing = ids.join(usable, "session_id", "left_anti").count()
        return splits.frozen_sides(usable, ids), {"enabled": True, "fraction": frozen["fraction"], "seed": frozen["seed"], "missing_from_selection": missing, "differs_from_spec": (frozen["fraction"], frozen["seed"]) != (fraction, seed)}
    sided = cut(splits.stratified_holdout(usable, fraction, seed))
    train = {r["value"]: r["count"] for r in sided.where("side = 'train'").groupBy("value").count().collect()}
    held = sided.where("side = 'holdout'")
    sinks.freeze_split(file, fraction, seed, created_at, held, labels.enough(train) and bool(held.take(1)))
    return sided, {"enabled": True, "fraction": fraction, "seed": seed, "missing_from_selection": 0, "differs_from_spec": False}


def frozen_holdout(ids: DataFrame, labelled: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session_id, value, text of the frozen sessions that can be scored; frozen, missing_ground_truth, skipped_no_text,
    usable in one row): which frozen sessions still carry a label and have text."""
    f = ids.select("session_id").distinct()
    j = f.join(labelled.select("session_id", "value"), "session_id", "left").join(texts.select("session_id", "text"), "session_id", "left")
    truth, text = F.col("value").isNotNull(), F.coalesce(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), F.lit("")) != ""
    counts = j.agg(F.count(F.lit(1)).alias("frozen"), F.count_if(~truth).alias("missing_ground_truth"), F.count_if(truth & ~text).alias("skipped_no_text"), F.count_if(truth & text).alias("usable"))
    return j.where(truth & text), counts


def run(job: Job, records: DataFrame, texts: DataFrame, root: str, created_at: str | None = None, max_iter: int = classify.MAX_ITER, cv: bool = False) -> dict:
    """Select, split, fit, score the held-out side, write model, metrics and spec. Returns the metrics."""
    kind = backend(job.model)  # before anything is read
    created_at = created_at or now()
    folder = f"{root}/models/{job.name}"
    usable, counts = selection(job, records, texts)
    sided, split = resolve_split(job, usable, folder, created_at)
    docs = cut(sided.select(F.col("session_id").alias("doc"), "text", F.col("value").alias("label"), "side"))
    train = docs.where("side = 'train'").drop("side")
    model = classify.TextClassifier.fit(train, max_iter)
    metrics = {"backend": kind, "trained_at": created_at, "job": job.raw, "left_out": counts, "eval_split": split, "n_sessions": train.count(), "counts": {r["label"]: r["count"] for r in train.groupBy("label").count().orderBy("label").collect()}}
    if cv:
        metrics["cv_accuracy"] = round(classify.cross_validate(train, (job.split or (0, 1))[1], max_iter=max_iter), 4)
    held = docs.where("side = 'holdout'")
    if held.take(1):
        preds = model.predict(held.select("doc", "text")).join(held.select("doc", F.col("label").alias("gold")), "doc").withColumnRenamed("predicted", "pred")
        metrics["holdout_evaluation"] = [r.asDict() for r in evaluate.holdout_report(cut(preds)).orderBy("value").collect()]
    model.save(folder, metrics)
    sinks.write_report(f"{folder}/job.json", job.raw)
    return metrics


def evaluate_job(spark: SparkSession, job: Job, records: DataFrame, texts: DataFrame, root: str, judge: teacher.Teacher | None = None, best: teacher.Teacher | None = None) -> dict:
    """Score the newest artifact on the frozen split; a judge adds verdicts on its predictions, a second reviewer (best) says
    whether labels and predictions make sense."""
    folder = f"{root}/models/{job.name}"
    found = stores.artifacts(spark, folder)
    if not found:
        raise NotEnoughData(f"no artifact of {job.name}")
    if not files.exists(spark, f"{folder}/eval-split.json"):
        raise NotEnoughData(f"{job.name} has no frozen split")
    head, ids = sinks.freeze_split(f"{folder}/eval-split.json", 0.0, 0, now(), records)
    chosen = labels.select_labels(labels.latest_labels(records), job.scope.aspect, job.evaluator, job.scope.runtimes, job.scope.since, job.scope.values).where("value is not null")
    usable, counts = frozen_holdout(ids, chosen, texts)
    report: dict = {"split": head} | counts.first().asDict()
    if not report["usable"]:
        raise NotEnoughData(f"none of the {report['frozen']} frozen sessions can be scored")
    held = cut(usable.select(F.col("session_id").alias("doc"), "text", F.col("value").alias("gold")))
    preds = cut(classify.TextClassifier.load(spark, found[-1]["folder"]).predict(held.select("doc", "text")).join(held, "doc").withColumnRenamed("predicted", "pred"))
    report |= {"classes": [r.asDict() for r in evaluate.holdout_report(preds).orderBy("value").collect()], "confusion": [r.asDict() for r in evaluate.confusion(preds).orderBy(F.desc("n"), "gold", "pred").collect()]}
    if judge is not None:
        asked = teacher.ask(preds.select(F.col("doc").alias("session_id"), teacher.judge_prompt(F.col("text"), F.col("pred")).alias("prompt")), "session_id", "prompt", judge)
        v = cut(teacher.verdicts(asked, "session_id", ["acceptable", "unacceptable"]).withColumnRenamed("value", "verdict"))
        total = evaluate.judge_aggregate(v, []).first().asDict()
        if not total["judged"]:
            raise RuntimeError("no prediction could be judged")
        report["judge"] = total
        if best is not None:
            sense = lambda c: teacher.verdicts(teacher.ask(preds.join(v.select(F.col("session_id").alias("doc"), "verdict"), "doc").select(F.col("doc").alias("session_id"), teacher.review_prompt(F.col("text"), F.col(c), F.coalesce("verdict", F.lit("unjudged"))).alias("prompt")), "session_id", "prompt", best), "session_id", ["nonsensical", "sensible"]).select("session_id", (F.col("value") == "sensible").alias(c))
            both = sense("gold").join(sense("pred"), "session_id")
            verdict = F.when(F.col("gold") & F.col("pred"), F.lit("both-sensible")).when(F.col("pred"), F.lit("label-nonsensical")).when(F.col("gold"), F.lit("student-nonsensical")).otherwise(F.lit("both-nonsensical"))
            report["second_review"] = evaluate.second_review(both.select(verdict.alias("verdict")), []).first().asDict()
        sinks.write_report(f"{folder}/judge.json", report)
    return report


def infer(spark: SparkSession, job_name: str, aspect: str, records: DataFrame, texts: DataFrame, root: str, limit: int | None = None, session: str | None = None) -> DataFrame:
    """Suggested labels by the newest artifact: of one session, labelled or not, or of unlabelled sessions."""
    found = stores.artifacts(spark, f"{root}/models/{job_name}")
    if not found:
        raise NotEnoughData(f"no artifact of {job_name}")
    backend(found[-1].get("backend", "tfidf-logreg"))
    if session is not None:
        todo = texts.where(F.col("session_id") == bare_session_id(F.lit(session)))
    else:
        todo = labels.unlabeled(texts, labels.latest_labels(records).where(F.col("aspect") == aspect)).where(F.trim("text") != "")
        if limit is not None:
            todo = todo.orderBy("session_id").limit(max(limit, 0))
    p = classify.TextClassifier.load(spark, found[-1]["folder"]).predict(todo.select(F.col("session_id").alias("doc"), "text"))
    return p.select(F.col("doc").alias("session_id"), F.lit(aspect).alias("aspect"), F.col("predicted").alias("value"), F.format_string("confidence=%.2f", F.col("probability")).alias("note"), F.lit("model").alias("source"))


def goal_dataset(goals: DataFrame, limit: int, ask_goal: teacher.Teacher, review: teacher.Teacher, budget: int = 32) -> DataFrame:
    """Curated goal rows (session_id, message, goal, goal_source, gold): labelled rows first, then others with goals by a
    teacher that two reviews find sensible. goals: goal_id, session_id, runtime, message, goal, gold."""
    ok = goals.where(pred.obvious_no_task(F.col("message")) | pred.task_message(F.col("message"))).withColumn("digest", curate.digest(F.col("message")))
    ok = ok.withColumn("goal_source", F.when(pred.obvious_no_task(F.col("message")), F.lit("contract:no-task-v1")).otherwise(F.lit(None)))
    gold = ok.where(F.col("gold") & F.col("goal").isNotNull())
    rest = curate.first_n(ok.where(~F.coalesce("gold", F.lit(False))), ["runtime", "session_id"], ["goal_id"], 10).drop("rank").orderBy("goal_id").limit(limit * 20)
    union = cut(curate.priority_union(gold, rest, ["goal_id"], F.col("goal_source").isNotNull()))
    todo = union.where("not gold and goal_source is null")
    asked = teacher.ask(todo.select("goal_id", F.col("message").alias("prompt")), "goal_id", "prompt", ask_goal).where("error is null")
    parsed = asked.select("goal_id", pred.parse_goal(F.col("answer")).alias("p")).where((F.col("p.kind") == "task") & ~pred.generic_goal(F.col("p.goal"))).select("goal_id", F.col("p.goal").alias("proposed"))
    for _ in range(2):
        checks = parsed.join(todo.select("goal_id", "message"), "goal_id").select("goal_id", teacher.audit_prompt(F.col("message"), F.col("proposed"), F.lit("")).alias("prompt"))
        sensible = teacher.verdicts(teacher.ask(checks, "goal_id", "prompt", review), "goal_id", ["sensible", "nonsensical"]).where("value = 'sensible'")
        parsed = cut(parsed.join(sensible.select("goal_id"), "goal_id", "left_semi"))
    labelled = union.join(parsed, "goal_id", "left").withColumn("goal", F.coalesce("goal", "proposed")).drop("proposed")
    keep = labelled.where(F.col("gold") | F.col("goal").isNotNull() | F.col("goal_source").isNotNull())
    return curate.holdout_budget(keep.select("goal_id", "session_id", "runtime", "message", "goal", "goal_source", "gold"), ["goal_id"], budget)


def goal_audit(predictions: DataFrame, reviewer: teacher.Teacher, done: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(verdict counts with zeros, passed): passed when every row was judged both-sensible. done (pred_id, verdict) holds
    verdicts of an earlier run, which aren't asked for again."""
    todo = predictions if done is None else predictions.join(done.select("pred_id"), "pred_id", "left_anti")
    asked = teacher.ask(todo.select("pred_id", teacher.audit_prompt(F.col("message"), F.col("goal"), F.col("student")).alias("prompt")), "pred_id", "prompt", reviewer, workers=4)
    domain = ("both-sensible", "label-nonsensical", "student-nonsensical", "both-nonsensical")
    v = teacher.verdicts(asked, "pred_id", list(domain)).select("pred_id", F.col("value").alias("verdict"))
    if done is not None:
        v = v.unionByName(done.select(F.col("pred_id").cast("string").alias("pred_id"), "verdict"))
    v = cut(v)
    total, good = v.count(), v.where("verdict = 'both-sensible'").count()
    return evaluate.counted_with_zeros(v, "verdict", domain, "unparseable"), total > 0 and total == good


#: Name of the contract that reviewed rows state.
CONTRACT = "goal-lifecycle-v1"


def check_review(route: str, split: str, refused: tuple[str, ...] = ()) -> None:
    """Reviewed labels are ground truth: a route that isn't meant for judging and an unknown split are refused."""
    if split not in ("train", "eval"):
        raise SpecError("the split of a review is train or eval")
    if any(route.startswith(f"{r}/") for r in refused):
        raise SpecError(f"{route} isn't a route of reviewers")


def lifecycle_review(rows: DataFrame, reviewer: teacher.Teacher, done: DataFrame | None = None, split: str = "train", route: str = "reviewer", reviewed_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(reviewed rows, failures): rows already reviewed by id aren't asked again; answers must obey the contract.

    rows: id, messages (role, content), metadata. Reviewed rows state their split and in metadata by whom, when and under
    which contract they were reviewed; other keys of metadata stay.
    """
    check_review(route, split)
    todo = rows if done is None else rows.join(done.select("id"), "id", "left_anti")
    user = pred.one_message(F.col("messages"), "user")
    asked = teacher.ask(todo.select("id", user.alias("prompt")).where("prompt is not null"), "id", "prompt", reviewer, workers=16)
    d = F.from_json(pred.first_json_object(F.col("answer")), "action string, goal_ref string, lifecycle_evidence string, title string")
    refs = F.transform(F.from_json(user, "candidates array<struct<ref:string>>")["candidates"], lambda c: c["ref"])
    j = cut(todo.join(asked.select("id", d.alias("d"), "error"), "id", "left").withColumn("ok", pred.decision_ok(F.col("d"), F.coalesce(refs, F.array().cast("array<string>")))))
    answer = F.to_json(F.struct(F.col("d.action").alias("action"), F.col("d.goal_ref").alias("goal_ref"), F.col("d.lifecycle_evidence").alias("lifecycle_evidence"), F.lit("").alias("title")))
    kept = F.filter("messages", lambda m: m["role"] != "assistant")
    provenance = {"reviewedBy": route, "reviewedAt": reviewed_at or now(), "contract": CONTRACT}
    old = F.map_filter(F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*provenance))
    metadata = F.to_json(F.map_concat(old, F.create_map(*[F.lit(x) for kv in provenance.items() for x in kv])))
    good = j.where("ok").select("id", F.concat(kept, F.array(F.struct(F.lit("assistant").alias("role"), answer.alias("content")))).alias("messages"), metadata.alias("metadata"), F.lit(split).alias("split"))
    why = F.when(user.isNull(), F.lit("a row needs exactly one user message")).otherwise(F.coalesce("error", F.lit("the answer breaks the contract")))
    return good, j.where("not ok").select("id", why.alias("error"))


def lifecycle_metrics(rows: DataFrame, predictions: DataFrame) -> dict:
    """Metrics of predicted decisions against reviewed rows, by all and by action, and the gates they break.

    rows: id, messages; predictions: id, answer (text). A row without a prediction counts as an invalid one; a row needs
    exactly one assistant message that obeys the contract.
    """
    kind = "struct<action:string,goal_ref:string,lifecycle_evidence:string,title:string>"
    target = pred.one_message(F.col("messages"), "assistant")
    t = rows.select("id", target.alias("t"))
    bad = t.where(~pred.strict_decision_ok(F.col("t"), legacy_title=True)).select("id").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['id']} has no valid target")
    p = predictions.groupBy("id").agg(F.max("answer").alias("answer"))
    parse = lambda c: F.from_json(pred.first_json_object(F.col(c)), kind)
    j = cut(t.join(p, "id", "left").select("id", parse("t").alias("target"), parse("answer").alias("prediction"), pred.strict_decision_ok(F.col("answer")).alias("valid")))
    m = evaluate.decision_metrics(j, []).first().asDict()
    by = evaluate.decision_metrics(j.withColumn("action", F.col("target.action")), ["action"]).orderBy("action").collect()
    return m | {"by_action": {r["action"]: {"rows": r["n"], "action_accuracy": r["action_accuracy"], "joint_accuracy": r["joint_accuracy"]} for r in by}, "broken_gates": evaluate.gates(m, evaluate.DECISION_GATES)}


def lifecycle_audit(predictions: DataFrame, reviewer: teacher.Teacher) -> dict:
    """Audit of predicted decisions (id, prompt, dangerous) against the thresholds; a request that fails ends it."""
    v = cut(teacher.verdicts(teacher.ask(predictions.select("id", "prompt"), "id", "prompt", reviewer, workers=2), "id", ["right", "wrong"]).withColumnRenamed("value", "verdict"))
    failed = v.where("status = 'failed'").agg(F.count(F.lit(1)).alias("n"), F.min("error").alias("error")).first()
    if failed["n"]:
        raise RuntimeError(f"the audit was ended: {failed['n']} requests failed ({failed['error']})")
    return evaluate.audit(v.join(predictions.select("id", "dangerous"), "id"), []).first().asDict()


def humanizer_export(goals: DataFrame, limit: int, per_session: int = 6) -> DataFrame:
    """goal_id, session_id, runtime, target: messages that people seem to have written, capped per session, of the first
    limit x 12 messages of a fitting length by hash."""
    g = goals.where(F.col("session_id").isNotNull() & F.col("runtime").isin(*RUNTIMES) & F.length("message").between(20, 2000))
    g = g.select("goal_id", "session_id", "runtime", F.col("message").alias("target"), F.sha2(F.concat_ws(":", "session_id", "message"), 256).alias("hash_key"))
    few = g.orderBy("hash_key", "goal_id").limit(limit * 12).where(pred.likely_authored(F.col("target"))).withColumn("digest", curate.digest(F.col("target")))
    return curate.capped_export(few, ["session_id"], limit, per_session).select("goal_id", "session_id", "runtime", "target")


def info(spark: SparkSession, root: str) -> dict:
    models = f"{root}/models"
    return {name: [{"trained_at": m.get("trained_at"), "backend": m.get("backend"), "n_sessions": m.get("n_sessions")} for m in stores.artifacts(spark, f"{models}/{name}")] for name in files.folders(spark, models)}


def dumps(x) -> str:
    return json.dumps(x, sort_keys=True, ensure_ascii=False, default=str)
