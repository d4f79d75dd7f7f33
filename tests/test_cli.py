"""All commands through main(), on the small tables, with stand-ins for reviewers."""

import json
import sys
import types

import pytest

from pyspark.sql import functions as F

from skein import cli
from skein.functions import predicates as pred


@pytest.fixture(scope="module")
def reviewers():
    m = types.ModuleType("stand_ins")
    m.ok = lambda prompt: "acceptable sensible"
    m.judge = lambda prompt: "acceptable"
    m.best = lambda prompt: "sensible"
    m.label = lambda prompt: "solved"
    m.topics = lambda prompt: "Form Work: login, upload | what is done to forms"
    m.goal = lambda prompt: "sensible" if prompt.startswith("Message:") else "<goal>Fix that web form</goal>"
    m.audit = lambda prompt: "both-sensible"
    m.decide = lambda prompt: '{"action": "startGoal", "goal_ref": "NEW_GOAL", "lifecycle_evidence": "none", "title": ""}'
    m.right = lambda prompt: "right"
    sys.modules["stand_ins"] = m
    yield m
    del sys.modules["stand_ins"]


def run(data, tmp, *args):
    return cli.main(["--tables", data, "--root", str(tmp), *args])


def test_commands_of_a_model(spark, data, tmp_path, reviewers, capsys):
    job = tmp_path / "job.yaml"
    job.write_text("name: outcome-v1\ntask: t\nevaluator: human\nmodel: tfidf-logreg\nscope:\n  aspect: outcome\n")
    assert run("/root/testdata/sf0.01", tmp_path, "run", str(job)) == 0
    assert json.loads(capsys.readouterr().out)["backend"] == "tfidf-logreg"
    assert run("/root/testdata/sf0.01", tmp_path, "--reviewer", "stand_ins:judge", "--best-reviewer", "stand_ins:best", "evaluate", "outcome-v1", "--json", "--best") == 0
    report = json.loads(capsys.readouterr().out)
    assert report["second_review"]["passed"] and report["usable"] > 0
    assert run("/root/testdata/sf0.01", tmp_path, "evaluate", "outcome-v1", "--no-judge") == 0 and "usable: " in capsys.readouterr().out
    assert run("/root/testdata/sf0.01", tmp_path, "infer", "outcome-v1", "--aspect", "outcome", "--limit", "3") == 0
    got = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(got) == 3 and run("/root/testdata/sf0.01", tmp_path, "infer", "outcome-v1", "--aspect", "outcome", "--session", got[0]["session_id"].upper()) == 0
    assert json.loads(capsys.readouterr().out)["session_id"] == got[0]["session_id"]
    assert run(data, tmp_path, "info", "--json") == 0 and list(json.loads(capsys.readouterr().out)) == ["outcome-v1"]
    assert run(data, tmp_path, "info") == 0


def test_usage(data, tmp_path, capsys):
    assert run(data, tmp_path, "train") == 2 and run(data, tmp_path, "train", "--aspect", "none-such") == 2 and run(data, tmp_path, "train", "--aspect", "outcome", "--model", "distilbert") == 2
    assert run(data, tmp_path, "evaluate", "nothing") == 2 and run(data, tmp_path, "infer", "x", "--aspect", "a", "--limit", "1", "--session", "s") == 2
    assert run(data, tmp_path, "lifecycle-review", "--split", "test", "--output", str(tmp_path / "o")) == 2 and run(data, tmp_path, "goal-audit", "--output", str(tmp_path / "o")) == 2


def test_commands_of_reviewers(spark, data, tmp_path, reviewers, capsys):
    at = lambda name: ("--reviewer", f"stand_ins:{name}")
    assert run(data, tmp_path, *at("label"), "autolabel", "--aspect", "made", "--values", "solved", "partial", "--limit", "2", "--runtime", "codex") == 0
    assert {json.loads(x)["source"] for x in capsys.readouterr().out.splitlines()} <= {"model:auto"}
    assert run(data, tmp_path, "--best-reviewer", "stand_ins:label", "autolabel", "--aspect", "made", "--values", "solved", "--best", "--limit", "2", "--output", str(tmp_path / "labels")) == 0
    assert spark.read.json(str(tmp_path / "labels")).count() == 2
    capsys.readouterr()
    assert run(data, tmp_path, *at("topics"), "aspect-discover", "--limit", "7", "--max-aspects", "3") == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"name": "form-work", "support": 4, "vals": ["login", "upload"], "evidence": ["chunk 0", "chunk 1"], "description": "what is done to forms"}
    assert run(data, tmp_path, *at("goal"), "goal-model", "--limit", "20", "--output", str(tmp_path / "goals")) == 0 and spark.read.json(str(tmp_path / "goals")).count() > 0
    assert run(data, tmp_path, *at("audit"), "goal-audit", "--output", str(tmp_path / "audit.json")) == 0 and json.loads((tmp_path / "audit.json").read_text())["passed"]
    for _ in range(2):  # the second run resumes
        assert run(data, tmp_path, *at("decide"), "lifecycle-review", "--split", "train", "--limit", "4", "--output", str(tmp_path / "reviewed")) in (0, 1)
    assert spark.read.parquet(str(tmp_path / "reviewed")).count() <= 4
    t = spark.read.parquet(f"{data}/training_rows.parquet")
    answer = t.selectExpr("id", "filter(messages, m -> m.role = 'assistant')[0].content answer").where(pred.strict_decision_ok(F.col("answer"))).orderBy("id").limit(20)
    answer.write.json(str(tmp_path / "answers"))
    assert run(data, tmp_path, "lifecycle-model", str(tmp_path / "answers"), "--json") in (0, 1)
    m = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert m["n"] == 20 and m["action_accuracy"] == m["valid_json"]
    wrong = answer.selectExpr("id", "'no answer' answer")
    wrong.write.json(str(tmp_path / "wrong"))
    assert run(data, tmp_path, "lifecycle-model", str(tmp_path / "wrong")) == 1 and "valid_json: 0.0" in capsys.readouterr().out
    assert run(data, tmp_path, *at("right"), "lifecycle-audit", str(tmp_path / "answers"), "--output", str(tmp_path / "la.json")) == 0 and json.loads((tmp_path / "la.json").read_text())["n"] == 20
    assert run(data, tmp_path, "humanizer-model", "--limit", "5", "--output", str(tmp_path / "h")) == 0
