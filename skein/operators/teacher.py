"""External reviewers as a row-wise function: retries, isolated failures, a deterministic stand-in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.predicates import parse_answer
from skein.operators.curate import merge_proposals


class Teacher(Protocol):
    def __call__(self, prompt: str) -> str: ...


class Stub:
    """Answers by a hash of the prompt from fixed values; no network."""

    def __init__(self, answers: list[str]):
        self.answers = answers

    def __call__(self, prompt: str) -> str:
        import hashlib

        return self.answers[int(hashlib.sha256(prompt.encode()).hexdigest()[:8], 16) % len(self.answers)]


def with_retry(teacher: Callable[[str], str], prompt: str, attempts: int = 3, pause: float = 1.0) -> tuple[str | None, str | None]:
    """(answer, error): waits pause, 2*pause, ... between attempts; no answer is invented."""
    error = ""
    for i in range(attempts):
        try:
            return teacher(prompt), None
        except Exception as e:  # noqa: BLE001  (a failed row must not fail the others)
            error = f"{type(e).__name__}: {e}"
            if i + 1 < attempts:
                time.sleep(pause * 2**i)
    return None, error


def ask(df: DataFrame, ident: str, prompt: str, teacher: Teacher, workers: int = 24, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """ident, answer, error: every prompt asked once; the number of partitions bounds the calls at a time."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [with_retry(teacher, p, attempts, pause) for p in b[prompt]]
            yield pd.DataFrame({ident: b[ident], "answer": [a for a, _ in got], "error": [e for _, e in got]})

    return df.select(F.col(ident).cast("string").alias(ident), prompt).repartition(workers, ident).mapInPandas(call, f"{ident} string, answer string, error string")


def label_prompt(text: Column, values: list[str]) -> Column:
    return F.concat(F.lit(f"Choose one of: {', '.join(values)}.\nTranscript:\n"), F.substring(text, 1, 12_000))


def judge_prompt(text: Column, value: Column) -> Column:
    return F.concat(F.lit("Label: "), value, F.lit("\nIs it acceptable or unacceptable for this transcript?\n"), F.substring(text, 1, 12_000))


def audit_prompt(message: Column, goal: Column, student: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Message: "), message), F.concat(F.lit("Label: "), goal), F.concat(F.lit("Student: "), student))


def review_prompt(text: Column, value: Column, verdict: Column) -> Column:
    return F.concat(F.lit("Label: "), value, F.lit("\nA first reviewer found it "), verdict, F.lit(". Is the label sensible, and the transcript clear enough? Answer sensible or nonsensical.\n"), F.substring(text, 1, 12_000))


def verdicts(answers: DataFrame, ident: str, values: list[str]) -> DataFrame:
    """ident, status (ok, rejected, failed), value, error."""
    v = parse_answer(F.col("answer"), values)["value"]
    status = F.when(F.col("error").isNotNull(), F.lit("failed")).when(v.isNull(), F.lit("rejected")).otherwise(F.lit("ok"))
    return answers.select(ident, status.alias("status"), v.alias("value"), "error")


def autolabel(sessions: DataFrame, values: list[str], teacher: Teacher, reviewer: Teacher | None = None, *, aspect: str, source: str, **kw) -> DataFrame:
    """Labels proposed for unlabelled sessions (session_id, text); with a reviewer only those it accepts."""
    asked = ask(sessions.select("session_id", label_prompt(F.col("text"), values).alias("prompt")), "session_id", "prompt", teacher, **kw)
    got = verdicts(asked, "session_id", values).where("status = 'ok'")
    if reviewer is not None:
        again = got.join(sessions.select("session_id", "text"), "session_id").select("session_id", judge_prompt(F.col("text"), F.col("value")).alias("prompt"))
        good = verdicts(ask(again, "session_id", "prompt", reviewer, **kw), "session_id", ["acceptable", "unacceptable"]).where("value = 'acceptable'")
        got = got.join(good.select("session_id"), "session_id", "left_semi")
    return got.select("session_id", F.lit(aspect).alias("aspect"), "value", F.lit(source).alias("source"))


def discover(excerpts: DataFrame, teacher: Teacher, chunk: int = 5, top: int = 8, **kw) -> DataFrame:
    """Aspect proposals over chunks of excerpts (ord, text), merged and ranked; answers are `name: value, value` lines."""
    parts = excerpts.groupBy(F.floor(F.col("ord") / chunk).alias("c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.substring("text", 1, 4000).alias("t")))), lambda x: x["t"]), "\n---\n").alias("prompt"))
    answers = ask(parts.select(F.col("c").cast("string").alias("c"), "prompt"), "c", "prompt", teacher, **kw).where("error is null")
    # a line reads name: value, value | description
    lines = answers.select(F.col("c").cast("long").alias("c"), F.posexplode(F.split("answer", "\n")).alias("i", "line")).where(F.contains("line", F.lit(":")))
    values = lines.select(F.trim(F.substring_index("line", ":", 1)).alias("name"), "c", "i", F.posexplode(F.split(F.expr("substring(line, instr(line, ':') + 1)"), ",")).alias("j", "value"))
    from skein.functions.predicates import kebab

    ord_ = F.col("c") * 1_000_000 + F.col("i") * 1000 + F.col("j")
    told = F.get(F.split("value", r"\|"), F.lit(1))
    return merge_proposals(values.select(kebab(F.col("name")).alias("name"), ord_.alias("ord"), F.trim(F.substring_index("value", "|", 1)).alias("value"), F.concat(F.lit("chunk "), F.col("c").cast("string")).alias("evidence"), F.trim(told).alias("description")), top=top)
