"""Command line: python -m skein.cli COMMAND. Exit code 0 done, 1 failed, 2 usage or not enough data."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from skein.plans import flows, jobs


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein")
    p.add_argument("--tables", required=True, help="folder of the project's Parquet tables")
    p.add_argument("--root", default=".", help="folder of models and reports")
    p.add_argument("--reviewer", help="module:name of a callable(prompt) -> answer")
    p.add_argument("--best-reviewer", help="the reviewer that --best asks")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for flags, kw in options:
            c.add_argument(*([flags] if isinstance(flags, str) else flags), **kw)
        return c

    flag = {"action": "store_true"}
    aspect, limit, output = ("--aspect", {"required": True}), ("--limit", {"type": int}), ("--output", {"required": True})
    best, runtime = ("--best", flag), ("--runtime", {"help": "only sessions of this runtime"})
    command("train", aspect, ("--model", {"default": jobs.BACKENDS[0]}), ("--evaluator", {"default": "human"}), ("--eval-split-fraction", {"type": float, "default": jobs.EVAL_FRACTION}), ("--eval-split-seed", {"type": int, "default": jobs.EVAL_SEED}), ("--no-eval-split", flag))
    command("run", ("job_file", {}))
    command("evaluate", ("name", {"help": "name of a trained job, or a job file"}), ("--no-judge", flag), ("--json", flag), best)
    one = command("infer", ("name", {}), aspect).add_mutually_exclusive_group()
    one.add_argument("--session")
    one.add_argument("--limit", type=int)
    command("info", ("--json", flag))
    command("autolabel", aspect, ("--values", {"required": True, "nargs": "+"}), limit, best, runtime, ("--source", {"default": "model:auto"}), ("--output", {"help": "label store to append to"}))
    command("aspect-discover", ("--limit", {"type": int, "default": 60}), ("--max-aspects", {"type": int, "default": 8}), best, runtime)
    command("goal-model", ("--limit", {"type": int, "default": 1500}), output)
    command("goal-audit", ("predictions", {"nargs": "?", "help": "JSON lines of pred_id, message, goal, student"}), output, best)
    command("lifecycle-review", ("input", {"nargs": "?", "help": "JSON lines of id, messages, metadata"}), output, ("--split", {"required": True}), limit, best)
    command("lifecycle-model", ("predictions", {"help": "JSON lines of id, answer"}), ("--json", flag))
    command("lifecycle-audit", ("predictions", {"help": "JSON lines of id, answer"}), output, best)
    command("humanizer-model", ("--limit", {"type": int, "default": 1500}), output)
    return p


def _reviewer(a: argparse.Namespace):
    name = a.best_reviewer if getattr(a, "best", False) else a.reviewer
    if not name:
        raise jobs.SpecError(f"this command needs --{'best-' if getattr(a, 'best', False) else ''}reviewer")
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _table(report: dict) -> str:
    """A report for reading: one line a value, classes as rows."""
    lines = []
    for k, v in report.items():
        if isinstance(v, list):
            lines += [k, *("  " + "  ".join(f"{x}={y}" for x, y in r.items()) if isinstance(r, dict) else f"  {r}" for r in v)]
        else:
            lines.append(f"{k}: {json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, dict) else v}")
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from skein.operators import labels, sessions, teacher
    from skein.runtime import read_table, row_numbers
    from skein.sources import files, sinks, stores, tables

    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = SparkSession.builder.appName(f"skein-{a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    records = lambda: tables.label_records(spark, a.tables)

    def texts():
        t = sessions.session_texts(tables.text_events(spark, a.tables), bucket="bucket")
        return t.where(F.col("runtime") == a.runtime) if getattr(a, "runtime", None) else t

    def answers():
        """id, answer of the predictions that are named; each must belong to a row."""
        p = stores.read_jsonl(spark, a.predictions, "id string, answer string")
        if not p.take(1):
            raise flows.NotEnoughData("there are no predictions")
        return p

    show = lambda report: print(flows.dumps(report) if a.json else _table(report))
    try:
        if a.command in ("train", "run"):
            if a.command == "train":
                split = False if a.no_eval_split else {"fraction": a.eval_split_fraction, "seed": a.eval_split_seed}
                job = jobs.job_from({"name": a.aspect, "task": a.aspect, "evaluator": a.evaluator, "model": a.model, "scope": {"aspect": a.aspect}, "eval_split": split})
            else:
                job = jobs.load(a.job_file)
            print(flows.dumps(flows.run(job, records(), texts(), a.root)))
        elif a.command == "evaluate":
            spec = f"{a.root}/models/{a.name}/job.json"
            job = jobs.load(a.name) if a.name.endswith((".yaml", ".yml")) else None
            if job is None and not files.exists(spark, spec):
                raise flows.NotEnoughData(f"no artifact of {a.name}")
            job = job or jobs.job_from(json.loads(files.read_text(spark, spec)))
            judge = None if a.no_judge or job.judge is None else _reviewer(argparse.Namespace(**vars(a) | {"best": False}))
            show(flows.evaluate_job(spark, job, records(), texts(), a.root, judge, _reviewer(a) if a.best and judge else None))
        elif a.command == "infer":
            for r in flows.infer(spark, a.name, a.aspect, records(), texts(), a.root, a.limit, a.session).toLocalIterator():
                print(flows.dumps(r.asDict()))
        elif a.command == "info":
            show(flows.info(spark, a.root))
        elif a.command == "autolabel":
            todo = labels.unlabeled(texts(), labels.latest_labels(records()).where(F.col("aspect") == a.aspect))
            todo = todo if a.limit is None else todo.orderBy("session_id").limit(max(a.limit, 0))
            made = teacher.autolabel(todo, a.values, _reviewer(a), aspect=a.aspect, source=a.source)
            if a.output:
                sinks.append_labels(made.withColumn("ts", F.lit(flows.now())), texts(), a.output)
            else:
                for r in made.toLocalIterator():
                    print(flows.dumps(r.asDict()))
        elif a.command == "aspect-discover":
            newest = texts().orderBy(F.desc("session_id")).limit(a.limit)  # a few dozen
            for r in teacher.discover(row_numbers(newest, ["session_id"], "ord").select("ord", "text"), _reviewer(a), top=a.max_aspects).collect():
                print(flows.dumps(r.asDict()))
        elif a.command == "goal-model":
            ask = _reviewer(a)
            sinks.write_jsonl(flows.goal_dataset(tables.goals(spark, a.tables), a.limit, ask, ask), a.output, ["goal_id"])
        elif a.command == "goal-audit":
            rows = stores.read_jsonl(spark, a.predictions, f"pred_id long, {stores.PREDICTION}") if a.predictions else read_table(spark, a.tables, "predictions")
            counts, passed = flows.goal_audit(rows, _reviewer(a))
            sinks.write_report(a.output, {"counts": {r["verdict"]: r["n"] for r in counts.collect()}, "passed": passed})
            return int(not passed)
        elif a.command == "lifecycle-review":
            flows.check_review(a.best_reviewer if a.best else a.reviewer or "", a.split)
            rows = stores.read_jsonl(spark, a.input, stores.TRAINING_ROW) if a.input else read_table(spark, a.tables, "training_rows")
            rows = rows if a.limit is None else rows.orderBy("id").limit(max(a.limit, 0))
            done = spark.read.parquet(a.output).select("id") if files.exists(spark, a.output) else None
            good, bad = flows.lifecycle_review(rows, _reviewer(a), done, a.split, a.best_reviewer if a.best else a.reviewer)
            sinks.append_new(good, a.output, "id")
            return int(bad.take(1) != [])
        elif a.command == "lifecycle-model":
            p = answers()
            rows = read_table(spark, a.tables, "training_rows").join(p.select("id").distinct(), "id", "left_semi")
            report = flows.lifecycle_metrics(rows, p)
            show(report)
            return int(bool(report["broken_gates"]))
        elif a.command == "lifecycle-audit":
            rows = tables.decisions(spark, a.tables).select("id", "content").join(answers(), "id")
            d = rows.select("id", F.concat_ws("\n", "content", "answer").alias("prompt"), F.coalesce(F.get_json_object("answer", "$.action") == "finishGoal", F.lit(False)).alias("dangerous"))
            report = flows.lifecycle_audit(d, _reviewer(a))
            sinks.write_report(a.output, report)
            return int(not report["passed"])
        else:
            sinks.write_jsonl(flows.humanizer_export(tables.goals(spark, a.tables), a.limit).drop("goal_id"), a.output, ["session_id", "target"])
    except (flows.NotEnoughData, jobs.SpecError) as e:
        print(e, file=sys.stderr)
        return 2
    except (RuntimeError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
