import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import runtime
from skein.operators import classify, curate, evaluate, features, labels, sessions, splits, teacher
from skein.plans import flows, jobs
from skein.sources import sinks, stores
from skein.streaming import label_stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_prefix_sums_and_lookup(spark):
    random.seed(2)
    data = [(random.choice("ab"), i, random.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(data, "g string, o int, v int").withColumn("b", F.floor(F.col("o") / 50))
    got = {(r["g"], r["o"]): r["at"] for r in runtime.prefix_sums(df, ["g"], ["o"], "v", "b", "at").collect()}
    run = {"a": 0, "b": 0}
    for g, o, v in sorted(data, key=lambda x: x[1]):
        assert got[g, o] == run[g]
        run[g] += v
    left = spark.createDataFrame([("h", i) for i in range(900)] + [(f"k{i}", i) for i in range(300)] + [(None, 1)], "k string, i int")
    right = spark.createDataFrame([("h", 1), ("k5", 2)], "k string, w int")
    assert runtime.skew_lookup(left, right, "k").count() == 1201
    assert runtime.skew_lookup(left, right, "k", how="inner").count() == 901


def store(spark, data):
    return spark.createDataFrame(data, "session_id string, aspect string, ts string, file string, line long, runtime string, value string, note string, source string")


def test_latest_labels_ties(spark):
    s = store(spark, [("s", "a", "t1", "f1", 5, None, "old", None, "human"), ("s", "a", "t1", "f2", 1, None, "file", None, "human"), ("s", "b", None, "f", 1, None, "x", None, "h"), ("s", "b", "", "f", 2, None, "y", None, "h"), (None, "b", "t", "f", 1, None, "z", None, "h")])
    assert {(r["aspect"], r["value"]) for r in labels.latest_labels(s).collect()} == {("a", "file"), ("b", "y")}
    assert labels.latest_labels(s.limit(0)).count() == 0


def test_select_labels(spark):
    s = store(spark, [("1", "a", "2026-01-02", "f", 1, "omp", "x", None, " human "), ("2", "a", "bad", "f", 1, "omp", "x", None, "human"), ("3", "a", "2026-02-01T00:30:00+01:00", "f", 1, None, "x", None, "human"), ("4", "a", "2026-03-01", "f", 1, "omp", "y", None, "model")])
    pick = lambda **kw: {r["session_id"] for r in labels.select_labels(s, "a", **kw).collect()}
    assert pick(evaluator="human") == {"1", "2", "3"}
    assert pick(runtimes=["omp"]) == {"1", "2", "4"}
    assert pick(since="2026-02-01T00:00:00+00:00") == {"4"} and pick(since="2026-01-31") == {"3", "4"}
    assert pick(values=["y"]) == {"4"}


def test_session_texts_order_cap_and_empty(spark):
    e = spark.createDataFrame([("s", "omp", 2, "b"), ("s", None, 1, "a"), ("s", "x", 3, None), ("t", "omp", 1, "y" * 13000), ("t", "omp", 2, "z"), (None, "omp", 1, "q"), ("u", "omp", 1, "")], "session_id string, runtime string, ord int, text string")
    got = {r["session_id"]: r for r in sessions.session_texts(e).collect()}
    assert got["s"]["text"] == "a\nb" and got["s"]["runtime"] is None
    assert got["t"]["text"] == "y" * 12000 and got["u"]["text"] == "" and len(got) == 3
    assert sessions.session_texts(e.limit(0)).count() == 0
    long = spark.createDataFrame([("h", "r", i, "ab") for i in range(9000)], "session_id string, runtime string, ord int, text string").withColumn("b", F.floor(F.col("ord") / 100))
    assert sessions.session_texts(long, bucket="b").first()["text"] == ("ab\n" * 9000)[:12000]


def test_stratified_holdout_sizes(spark):
    data = [(f"{v}{i}", v) for v, n in (("a", 1), ("b", 2), ("c", 3), ("d", 10)) for i in range(n)]
    df = spark.createDataFrame(data, "session_id string, value string")
    side = splits.stratified_holdout(df, 0.2, 7)
    assert {r["value"]: r["n"] for r in side.where("side = 'holdout'").groupBy("value").agg(F.count("*").alias("n")).collect()} == {"b": 1, "c": 1, "d": 2}
    assert rows(side) == rows(splits.stratified_holdout(df.repartition(3), 0.2, 7))
    f = splits.folds(df, 7)
    assert {r["fold"]: r["n"] for r in f.where("value = 'd'").groupBy("fold").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(5), 2)


def test_oversample(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id int, k string")
    got = splits.oversample(df, "k", {"a": 5, "b": 1, "z": 9}, "id")
    assert {r["id"]: r["n"] for r in got.groupBy("id").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: 2, 3: 1, 4: 1}


def test_percentiles(spark):
    for n in (1, 2, 10, 101):
        v = list(range(n))
        r = evaluate.percentiles(spark.createDataFrame([("g", x) for x in v] + [("g", None)], "g string, v int"), "g", "v", {"p50": 50, "p90": 90, "p99": 99}).first()
        assert (r["n"], r["p50"], r["p90"], r["p99"], r["max"]) == (n, v[n * 50 // 100], v[n * 90 // 100], v[n * 99 // 100], n - 1)


def test_reports_and_gates(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None), ("b", "a")], "gold string, pred string")
    assert rows(evaluate.holdout_report(p).select("value", "n", "correct", "accuracy")) == [("a", 2, 1, 0.5), ("b", 2, 0, 0.0)]
    assert {(r["gold"], r["pred"]): r["n"] for r in evaluate.confusion(p).collect()} == {("a", "b"): 1, ("b", None): 1, ("b", "a"): 1}
    v = spark.createDataFrame([("right", False)] * 98 + [("wrong", False)] * 2, "verdict string, dangerous boolean")
    assert evaluate.audit(v, []).first()["passed"] is True
    for extra in (("wrong", False), (None, False)):
        assert evaluate.audit(v.unionByName(spark.createDataFrame([extra], v.schema)), []).first()["passed"] is False
    assert evaluate.audit(v.limit(97).unionByName(spark.createDataFrame([("wrong", True)], v.schema)), []).first()["passed"] is False
    assert evaluate.gates({"valid_json": 1.0, "action_accuracy": 0.9, "joint_accuracy": 0.87}, evaluate.DECISION_GATES) == ["joint_accuracy", "finish_precision"]


def test_curation(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a B"), (3, "c"), (4, None)], "id int, text string")
    assert curate.first_by(df.withColumn("d", curate.digest(F.col("text"))), ["d"], ["id"]).count() == 3
    first = spark.createDataFrame([(5, "x", None)], "id int, digest string, goal_source string")
    second = spark.createDataFrame([(1, "x", None), (2, "y", None), (3, "y", None), (6, "x", "ack"), (7, "x", "ack")], first.schema)
    assert {r["id"] for r in curate.priority_union(first, second, ["id"], F.col("goal_source") == "ack").collect()} == {5, 2, 6, 7}
    g = spark.createDataFrame([(i, "g" if i % 2 else None, False) for i in range(100)] + [(200, None, True)], "id int, goal string, gold boolean")
    got = {r["id"]: r["gold"] for r in curate.holdout_budget(g, ["id"], 3).collect()}
    assert {i for i, x in got.items() if x} == {0, 2, 4, 1, 3, 5, 200} and len(got) == 50 + 3 + 1
    assert rows(curate.conflicts(spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "id int, v string"), "id", ["v"])) == [(2, 2)]
    p = spark.createDataFrame([("x", 1, "v1"), ("x", 2, "v2"), ("x", 3, "v1"), ("y", 4, None)], "name string, ord long, value string")
    assert [(r["name"], r["support"], r["vals"]) for r in curate.merge_proposals(p).collect()] == [("x", 3, ["v1", "v2"]), ("y", 1, None)]


def test_tfidf_by_hand(spark):
    import math

    docs = spark.createDataFrame([("1", "aa bb aa"), ("2", "bb cc"), ("3", "")], "doc string, text string")
    got = {(r["doc"], r["term"]): r["weight"] for r in features.fit_transform(docs, 1).collect()}
    idf = {t: math.log(4 / (1 + d)) + 1 for t, d in (("aa", 1), ("bb", 2), ("cc", 1))}
    a, b = (1 + math.log(2)) * idf["aa"], idf["bb"]
    assert got["1", "aa"] == pytest.approx(a / math.hypot(a, b)) and ("3", "aa") not in got
    assert {r["term"]: r["index"] for r in features.vocabulary(features.term_counts(docs)).collect()} == {"aa": 0, "aa bb": 1, "bb": 2, "bb aa": 3, "bb cc": 4, "cc": 5}


def test_flow_from_job_to_prediction(spark, tmp_path):
    random.seed(1)
    words = {"good": "fine great nice".split(), "bad": "broken slow ugly".split()}
    data = [(f"s{i:03d}", v, " ".join(random.choices(words[v] + ["the", "form"], k=12))) for i, v in enumerate(["good", "bad"] * 15)]
    recs = store(spark, [(s, "topic", "2026-01-01", "f", i, "omp", v, None, "human") for i, (s, v, _) in enumerate(data)])
    texts = spark.createDataFrame([(s, "omp", t) for s, _, t in data] + [("new", "omp", "fine nice great great form"), ("void", "omp", " ")], "session_id string, runtime string, text string")
    job = jobs.job_from({"name": "topic-v1", "task": "t", "evaluator": "human", "model": "tfidf-logreg", "scope": {"aspect": "topic"}})
    m = flows.run(job, recs, texts, str(tmp_path), "2026-01-01T00:00:00Z", max_iter=10)
    assert m["eval_split"]["enabled"] and sum(r["n"] for r in m["holdout_evaluation"]) == 6
    more = recs.unionByName(store(spark, [("new", "topic", "2026-01-01", "f", 99, "omp", "good", None, "human")]))
    sided, note = flows.resolve_split(job, flows.selection(job, more, texts)[0], f"{tmp_path}/models/topic-v1", "later")
    assert sided.where("session_id = 'new'").first()["side"] == "train" and note["missing_from_selection"] == 0
    report = flows.evaluate_job(spark, job, recs.where("session_id != 's000'"), texts.withColumn("text", F.expr("if(session_id = 's001', ' ', text)")), str(tmp_path), teacher.Stub(["acceptable"]), teacher.Stub(["sensible"]))
    assert report["judge"]["agreement_rate"] == 1.0 and report["second_review"]["passed"] and report["frozen"] == report["usable"] + report["missing_ground_truth"] + report["skipped_no_text"] == 6
    assert [r["session_id"] for r in flows.infer(spark, "topic-v1", "topic", recs, texts, str(tmp_path), session="S003 ").collect()] in ([], ["s003"])
    with pytest.raises(jobs.SpecError):
        flows.run(jobs.job_from({"name": "x", "task": "t", "evaluator": "human", "model": "distilbert", "scope": {"aspect": "topic"}}), recs, texts, str(tmp_path))
    got = flows.infer(spark, "topic-v1", "topic", recs, texts, str(tmp_path)).collect()
    assert [(r["session_id"], r["value"]) for r in got] == [("new", "good")] and got[0]["note"].startswith("confidence=0.")
    with pytest.raises(flows.NotEnoughData):
        flows.selection(job, recs.limit(3), texts)
    assert classify.cross_validate(spark.createDataFrame(data, "doc string, label string, text string"), 1, most=2, max_iter=5) > 0.8
    assert list(flows.info(spark, str(tmp_path))) == ["topic-v1"]


def test_job_specs():
    base = {"name": "a", "task": "t", "evaluator": "model:x/y", "model": "m", "scope": {"aspect": "q", "since": "2026-07-01"}}
    j = jobs.job_from(base)
    assert j.scope.since == "2026-07-01T00:00:00+00:00" and j.split == (0.2, 20260808) and j.judge == "default"
    for change in ({"name": "A"}, {"extra": 1}, {"evaluator": "me"}, {"scope": {"aspect": ""}}, {"scope": {"aspect": "q", "values": []}}, {"eval_split": {"fraction": 0.6}}, {"eval_split": {"seed": -1}}, {"judge": {"who": 1}}, {"scope": {"aspect": "q", "since": "soon"}}):
        with pytest.raises(jobs.SpecError):
            jobs.job_from(base | change)


def test_teacher_failures_stay_apart(spark):
    class Flaky:
        def __call__(self, prompt):
            if "x" in prompt:
                raise OSError("down")
            return "I'd say yes"

    df = spark.createDataFrame([("1", "ask"), ("2", "x"), ("3", "ask")], "id string, prompt string")
    v = teacher.verdicts(teacher.ask(df, "id", "prompt", Flaky(), 2, 2, 0.0), "id", ["yes", "no"])
    assert {(r["id"], r["status"], r["value"]) for r in v.collect()} == {("1", "ok", "yes"), ("2", "failed", None), ("3", "ok", "yes")}
    ex = spark.createDataFrame([(i, f"t{i}") for i in range(12)], "ord long, text string")
    assert [(r["name"], r["vals"]) for r in teacher.discover(ex, teacher.Stub(["Topic Kind: a, b"])).collect()] == [("topic-kind", ["a", "b"])]


def test_stores_and_sinks(spark, tmp_path):
    d = tmp_path / "store"
    d.mkdir()
    (d / "b.ndjson").write_text('{"session_id":"s","aspect":"a","ts":"t","value":"late","source":"h"}\n')
    (d / "a.ndjson").write_text('{"session_id":"s","aspect":"a","ts":"t","value":true,"source":null}\n\nnot json\n{"session_id":"","aspect":"a","value":"x"}\n{"session_id":"z","aspect":"a","value":null}\n')
    got = stores.read_label_store(spark, str(d))
    assert {(r["session_id"], r["value"], r["source"]) for r in got.collect()} == {("s", "late", "h"), ("s", "True", "None"), ("z", "None", "")}
    assert labels.latest_labels(got).where("session_id = 's'").first()["value"] == "late"
    assert stores.read_label_store(spark, str(tmp_path / "none")).count() == 0
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sinks.append_new(df, str(tmp_path / "t"), "id") == 2 and sinks.append_new(df.unionByName(spark.createDataFrame([(3, "c")], df.schema)), str(tmp_path / "t"), "id") == 1
    ids = spark.createDataFrame([("b",), ("a",), ("a",)], "session_id string")
    with pytest.raises(ValueError):
        sinks.freeze_split(str(tmp_path / "s.json"), 0.2, 1, "now", ids, False)
    first, held = sinks.freeze_split(str(tmp_path / "s.json"), 0.2, 1, "now", ids)
    again, same = sinks.freeze_split(str(tmp_path / "s.json"), 0.5, 9, "later", ids.limit(0))
    assert again == first and first["sessions"] == 2 and rows(held) == rows(same) == [("a",), ("b",)]
    (d / "many").mkdir()
    for k in range(6):  # several small files in one partition keep their order
        (d / "many" / f"{k}.ndjson").write_text("".join(f'{{"session_id":"s{k}","aspect":"a","ts":"t","value":"{i}"}}\n' for i in range(50)))
    several = stores.read_label_store(spark, str(d / "many")).coalesce(1)
    assert {r["value"] for r in labels.latest_labels(several).collect()} == {"49"}
    sinks.write_jsonl(df, str(tmp_path / "j"), ["id"])
    m = sinks.manifest(spark, f"{tmp_path}/j/*.json").collect()
    sinks.verify_parts([(f"{tmp_path}/j/{r['path']}", r["bytes"], r["sha256"]) for r in m])
    with pytest.raises(ValueError):
        sinks.verify_parts([(f"{tmp_path}/j/{m[0]['path']}", 1, "x")])
    lab = spark.createDataFrame([("s", "v", "h", "t", "omp", "text")], "session_id string, value string, source string, ts string, runtime string, text string")
    sinks.export_bundle(lab, "a", str(tmp_path / "b.json"))
    with pytest.raises(ValueError):
        sinks.export_bundle(spark.range(sinks.BUNDLE_ROWS + 1), "a", str(tmp_path / "big.json"))
    assert stores.read_bundle(spark, str(tmp_path / "b.json"), "a").count() == 1
    with pytest.raises(ValueError):
        stores.read_bundle(spark, str(tmp_path / "b.json"), "other")


def test_label_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name, ts, v in (("1", "t1", "a"), ("2", "t3", "c"), ("3", "t2", "b")):
        (src / f"{name}.json").write_text(f'{{"session_id":"s","aspect":"x","ts":"{ts}","value":"{v}"}}\n')
        label_stream.follow(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["value"] for r in label_stream.current(spark, str(tmp_path / "out")).collect()] == ["c"]


def test_goal_and_review_flows(spark):
    g = spark.createDataFrame([(f"g{i:02d}", f"s{i}", "omp", f"please fix the form number {i}" if i % 3 else "thanks", "Fix the form" if i < 5 else None, i < 5) for i in range(20)], "goal_id string, session_id string, runtime string, message string, goal string, gold boolean")
    out = {r["goal_id"]: r for r in flows.goal_dataset(g, 50, teacher.Stub(["<goal>Fix that web form</goal>"]), teacher.Stub(["sensible"])).collect()}
    assert out["g07"]["goal"] == "Fix that web form" and out["g06"]["goal"] is None and out["g06"]["gold"]
    counts, passed = flows.goal_audit(spark.createDataFrame([(1, "m", "g", "s")], "pred_id long, message string, goal string, student string"), teacher.Stub(["both-sensible"]))
    assert passed and {r["verdict"]: r["n"] for r in counts.collect()}["unparseable"] == 0
    msg = [("user", '{"text": "x", "candidates": [{"ref": "g1"}]}'), ("assistant", "old")]
    t = spark.createDataFrame([("1", msg, "{}"), ("2", msg, "{}")], "id string, messages array<struct<role:string,content:string>>, metadata string")
    good, bad = flows.lifecycle_review(t.withColumn("metadata", F.lit('{"author": "x", "reviewedBy": "y"}')), teacher.Stub(['so {"action":"ignore","goal_ref":"g1","lifecycle_evidence":"none"}']), t.limit(0), "eval", "best", "now")
    assert good.count() == 2 and bad.count() == 0
    assert json.loads(good.first()["metadata"]) == {"author": "x", "reviewedBy": "best", "reviewedAt": "now", "contract": flows.CONTRACT} and good.first()["split"] == "eval"
    assert flows.lifecycle_review(t, teacher.Stub(['{"action":"ignore","goal_ref":"g7","lifecycle_evidence":"none"}']))[1].count() == 2
    two = t.limit(1).withColumn("messages", F.concat("messages", "messages"))
    assert [r["error"] for r in flows.lifecycle_review(two, teacher.Stub(["{}"]))[1].collect()] == ["a row needs exactly one user message"]
    for route, split in (("r", "test"), ("product/x", "train")):
        with pytest.raises(jobs.SpecError):
            flows.check_review(route, split, ("product",))
    done = spark.createDataFrame([(1, "both-nonsensical")], "pred_id long, verdict string")
    two = spark.createDataFrame([(1, "m", "g", "s"), (2, "m", "g", "s")], "pred_id long, message string, goal string, student string")
    counts, passed = flows.goal_audit(two, teacher.Stub(["both-sensible"]), done)
    assert not passed and {r["verdict"]: r["n"] for r in counts.collect()}["both-nonsensical"] == 1


def test_decisions_are_measured_against_targets(spark):
    ask = lambda a, r="g1", e="none", t="": json.dumps({"action": a, "goal_ref": r, "lifecycle_evidence": e, "title": t})
    row = lambda i, target: (i, [("user", "{}"), ("assistant", target)])
    kind = "id string, messages array<struct<role:string,content:string>>"
    data = spark.createDataFrame([row("1", ask("ignore")), row("2", ask("finishGoal", e="explicit_completion")), row("3", ask("startGoal", "NEW_GOAL", t="Fix the form")), row("4", ask("ignore"))], kind)
    p = spark.createDataFrame([("1", ask("ignore")), ("2", "so " + ask("finishGoal", "g2", "explicit_completion")), ("3", ask("startGoal", "NEW_GOAL")), ("9", ask("ignore"))], "id string, answer string")
    m = flows.lifecycle_metrics(data, p)
    assert (m["n"], m["valid_json"], m["action_accuracy"], m["joint_accuracy"], m["exact_json"], m["finish_precision"]) == (4, 0.75, 0.75, 0.5, 0.5, 1.0)
    assert m["by_action"]["ignore"] == {"rows": 2, "action_accuracy": 0.5, "joint_accuracy": 0.5} and "valid_json" in m["broken_gates"]
    with pytest.raises(ValueError):
        flows.lifecycle_metrics(spark.createDataFrame([row("1", "{}")], kind), p)

    def down(prompt):
        raise OSError("down")

    monkey = teacher.ask
    try:
        flows.teacher.ask = lambda *a, **k: monkey(*a, **k | {"attempts": 1})
        with pytest.raises(RuntimeError, match="2 requests failed"):
            flows.lifecycle_audit(spark.createDataFrame([("1", "p", True), ("2", "p", False)], "id string, prompt string, dangerous boolean"), down)
    finally:
        flows.teacher.ask = monkey


def test_slices_reach_their_size(spark):
    rng = random.Random(5)
    for _ in range(200):
        counts = {f"c{i}": rng.randint(2, 30) for i in range(rng.randint(1, 6))}
        n = rng.randint(1, sum(counts.values()))
        take = splits.slice_sizes(counts, n)
        low, high = len(counts), sum(c - 1 for c in counts.values())
        assert sum(take.values()) == min(max(n, low), high) and all(1 <= take[c] < counts[c] for c in counts)
    df = spark.createDataFrame([(f"s{i}", "ab"[i % 3 == 0]) for i in range(90)], "session_id string, value string")
    got = splits.stratified_slice(df, 10, 1)
    assert got.where("side = 'validation'").count() == 10 and got.count() == 90
    assert rows(got) == rows(splits.stratified_slice(df.repartition(3), 10, 1))


def test_one_key_holds_half_of_the_rows(spark):
    docs = spark.createDataFrame([(str(i), "the " + ("form " if i % 2 else "") + f"word{i}") for i in range(400)], "doc string, text string")
    got = features.fit_transform(docs, 1)
    assert got.where("term = 'the'").count() == 400 and got.count() == 400 * 2 + 200
    norms = got.groupBy("doc").agg(F.sum(F.col("weight") ** 2).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert norms[0] == pytest.approx(1) and norms[1] == pytest.approx(1)
    v = features.vectors(got, features.vocabulary(got), docs.select("doc").unionByName(spark.createDataFrame([("none",)], "doc string")))
    by = {r["doc"]: r["features"] for r in v.collect()}
    assert len(by) == 401 and by["none"].numNonzeros() == 0 and by["1"].numNonzeros() == 3 and by["1"].size == 402
    b = splits.batches(spark.range(1000).select(F.lit("same").alias("k"), "id"), 30, ["k", "id"])
    assert rows(b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo")).where("batch < 33").select(F.expr("lo = batch * 30 and n = 30")).distinct()) == [(True,)]


def test_candidates_literals_and_gains(spark):
    c = "array<struct<ref:string,score:double,same_session:boolean>>"
    df = spark.createDataFrame([("1", [("NEW_GOAL", 9.0, None), ("a", None, False), ("b", 0.5, None), ("d", 0.5, None)]), ("2", [("a", 0.9, False), ("b", 0.1, True)]), ("3", [("NEW_GOAL", 1.0, True)]), ("4", []), ("5", None)], f"id string, c {c}")
    assert {r["id"]: r["r"] for r in df.select("id", curate.best_candidate(F.col("c"))["ref"].alias("r")).collect()} == {"1": "b", "2": "b", "3": None, "4": None, "5": None}
    assert rows(curate.with_literals(spark.createDataFrame([(1, "a")], "id int, v string"), [(2, "b")])) == [(1, "a"), (2, "b")]
    p = spark.createDataFrame([("x", 1, "v", "e1", " "), ("x", 2, "w", "e1", "second"), ("x", 3, "v", "e2", "third")], "name string, ord long, value string, evidence string, description string")
    assert [(r["vals"], r["evidence"], r["description"]) for r in curate.merge_proposals(p).collect()] == [(["v", "w"], ["e1", "e2"], "second")]
    g = evaluate.similarity_gain(spark.createDataFrame([(1, "abcd", "xxxx", "abcd"), (2, "abcd", None, "abcd")], "id int, r string, b string, s string"), "id", "r", "b", "s").first()
    assert (g["base"], g["student"], g["gain"]) == (0.0, 1.0, 1.0)
    v = spark.createDataFrame([(1, "base", 0.97, 0.5, False, True), (1, "student", 0.96, 0.9, False, True)], "id int, candidate string, semantic_fidelity double, voice_match double, ai_boilerplate boolean, passed boolean")
    r = evaluate.style_audit(v).first()
    assert r["gates_hold"] and r["voice_gain"] == 0.4 and r["semantic_delta"] == -0.01 and not evaluate.style_audit(v.limit(0)).first()["gates_hold"]


def test_learning_queries_run_the_whole_job(spark, data, monkeypatch):
    from skein.plans import queries

    asked = []
    fit = classify.TextClassifier.fit.__func__
    monkeypatch.setattr(classify.TextClassifier, "fit", classmethod(lambda cls, docs, max_iter=classify.MAX_ITER: asked.append(max_iter) or fit(cls, docs, 1)))
    folds = []
    whole = classify.folds
    monkeypatch.setattr(classify, "folds", lambda docs, seed, k, *names: folds.append((k, min(r["count"] for r in docs.groupBy("label").count().collect()))) or whole(docs, seed, k, *names))
    queries.lr_holdout_predictions(spark, data)
    queries.cv_accuracy(spark, data)
    assert set(asked) == {100} and all(k == min(5, least) for k, least in folds)


def _labelled(spark, n, own):
    """n documents of three classes: a word of the class, shared words and `own` words that stand nowhere else."""
    rows = [(f"d{i}", "abc"[i % 3], " ".join([f"tell{i % 3}"] * (i % 5 > 0) + [f"word{i * k % 17}" for k in range(1, 6)] + [f"own{i}x{k}" for k in range(own)])) for i in range(n)]
    return spark.createDataFrame(rows, "doc string, label string, text string")


def test_fit_is_the_optimum_and_keeps_no_vocabulary_on_the_driver(spark, monkeypatch):
    import pyspark.ml.classification as ml

    docs = _labelled(spark, 60, 3)
    counts = features.term_counts(docs)
    weighted = features.weights(counts, features.inverse_frequency(counts, docs)).join(docs.select("doc", "label"), "doc").collect()
    place = {t: k for k, t in enumerate(sorted({r["term"] for r in weighted}))}
    ids = {r["doc"]: k for k, r in enumerate(docs.orderBy("doc").collect())}
    x, y = np.zeros((60, len(place))), np.zeros((60, 3))
    for r in weighted:
        x[ids[r["doc"]], place[r["term"]]] = r["weight"]
        y[ids[r["doc"]], "abc".index(r["label"])] = 1
    monkeypatch.setattr(ml, "LogisticRegression", None)  # holds coefficients and their history for the whole vocabulary on the driver
    monkeypatch.setattr(classify, "TOL", 1e-12)
    model = classify.TextClassifier.fit(docs, 500)
    terms = {r["term"]: r["w"] for r in model.terms.collect()}
    assert terms.keys() == place.keys()
    w = np.array([terms[t] for t in place])
    z = x @ w + np.array(model.intercepts)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    assert np.abs(x.T @ (p - y) + w).max() < 1e-4 and np.abs((p - y).sum(axis=0)).max() < 1e-4  # summed loss and half of the squared weights
    got = {r["doc"]: (r["predicted"], r["probability"]) for r in model.predict(docs.select("doc", "text")).collect()}
    assert all(got[d] == ("abc"[p[k].argmax()], pytest.approx(p[k].max(), abs=1e-9)) for d, k in ids.items())
    none = model.predict(spark.createDataFrame([("n", "unheard")], "doc string, text string")).first()
    assert none["probability"] == pytest.approx(1 / 3, abs=0.05)
