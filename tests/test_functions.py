import datetime as dt

import pytest
from pyspark.sql import functions as F

from skein.functions import numbers as num
from skein.functions import predicates as pred
from skein.functions import text, timefn


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_bare_session_id(spark):
    got = column(spark, ["AB12cd34EF5678", " omp/ab12cd34ef5678\n", "kimi#ab12cd34ef5678", "\tcodex:AB12CD34EF5678", "", "  ", None], text.bare_session_id)
    assert got == ["ab12cd34ef5678"] * 4 + [None] * 3


def test_blank_values(spark):
    assert column(spark, [None, "", "  ", "None", " None ", "none", "x"], text.is_blank_value) == [True] * 5 + [False] * 2


def test_instants_without_session_zone(spark):
    at = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    got = column(spark, ["2026-05-01T10:00:00Z", "2026-05-01T12:00:00+02:00", "2026-05-01 10:00:00", "2026-05-01T10:00", "2026-05-01", "10:00:00", "2026", "yesterday", "n/a", "", None, "2026-13-01"], timefn.instant_micros)
    assert got == [at(2026, 5, 1, 10)] * 4 + [at(2026, 5, 1)] + [None] * 7


def test_days(spark):
    assert column(spark, ["2026-05-01", " 2026-05-01", "20260501", "2026/05/01", "2026-05-01T06:30:00Z", "undated", "", None, "2026-05/01", "2026-02-31"], timefn.day_of) == ["2026-05-01"] * 5 + [None] * 5


@pytest.mark.parametrize("value, want", [("OK!", True), (" okej,  kontynuuj ", False), ("dzięki.", True), ("continue please", False), ("Go   ahead...", True), ("", False)])
def test_no_task(spark, value, want):
    assert column(spark, [value], pred.obvious_no_task) == [want]


def test_safe_and_task_messages(spark):
    for m in pred.SECRET_MARKERS:
        assert column(spark, [f"please look at {m.upper()} now"], pred.safe_message) == [False]
    for p in pred.SYNTHETIC_PREFIXES:
        assert column(spark, [f"{p.title()} and more", f"not {p}"], pred.task_message) == [False, True]
    assert column(spark, ["You are somebody's prompt-to-goal classifier.", "x API Validation Error: y"], pred.task_message) == [False, False]
    assert column(spark, ["ab", "abc", "ż" * 4000, "ż" * 4001, "/run this", "token sale"], pred.safe_message) == [False, True, True, False, False, True]


def test_authored(spark):
    ok = "could you look at the login form once more"
    bad = ["x" * 19, "one two thr 33 44 55 66 77 88", "%% {{ }} ## !! :: ;; ab cd ef gh", "a b\n" * 9 + "some more words here", "/do this for the whole team please", "<system note for the whole team please"]
    assert column(spark, [ok, *bad], pred.likely_authored) == [True] + [False] * len(bad)
    for f in pred.UNAUTHORED_FRAGMENTS:
        assert column(spark, [f"{ok} {f.upper()} and so on"], pred.likely_authored) == [False]


def test_parse_goal(spark):
    got = column(spark, ["<goal/>", "<goal></goal>", "<goal>Fix it</goal>", "<goal>Fix the  form ...</goal>", "<goal>a b c d e f g</goal>", "<goal>a b c d e f g h</goal>", "<goal>Fix the form", "x <goal>a <b> c</goal> y", f"<goal>{'x' * 99} y z</goal>", None], pred.parse_goal)
    assert [g["kind"] for g in got] == ["no_task", "no_task", "rejected", "task", "task", "rejected", "rejected", "task", "rejected", "rejected"]
    assert got[3]["goal"].strip() == "Fix the form"


def test_parse_answer(spark):
    values = ["acceptable", "unacceptable", "sensible", "nonsensical"]
    got = column(spark, ["acceptable", '"Acceptable."', "It is unacceptable", "unacceptable", "It is nonsensical", "sensible or nonsensical", ""], lambda c: pred.parse_answer(c, values))
    assert [g["value"] for g in got] == ["acceptable", "acceptable", None, "unacceptable", "nonsensical", None, None]


def test_anchors_and_ratio(spark):
    df = spark.createDataFrame([("see https://x.example/a and a.b@c.de by 12", "by 12 see https://x.example/a or a.b@c.de"), ("see 12", "see 13"), ("a" * 100, "b" * 65), ("a" * 100, "b" * 64), ("ab", "cdefg"), ("ab", "cdefgh"), ("same", " same ")], "t string, s string")
    assert [r[0] for r in df.select(pred.valid_source(F.col("t"), F.col("s"))).collect()] == [True, False, True, False, True, False, False]


def test_decision_contract(spark):
    rows = [("startGoal", "NEW_GOAL", "none"), ("startGoal", "g1", "none"), ("ignore", "NEW_GOAL", "none"), ("finishGoal", "g1", "none"), ("finishGoal", "g1", "explicit_completion"), ("ignore", "g1", "explicit_completion"), ("jump", "g1", "none"), ("ignore", "g9", "none"), (None, None, None)]
    df = spark.createDataFrame(rows, "action string, goal_ref string, lifecycle_evidence string")
    d = F.struct("action", "goal_ref", "lifecycle_evidence")
    assert [tuple(r) for r in df.select(pred.decision_ok(d), pred.decision_ok(d, F.array(F.lit("g1")))).collect()] == [
        (True, True), (False, False), (False, False), (False, False), (True, True), (False, False), (False, False), (True, False), (False, False)
    ]


def test_numbers(spark):
    assert column(spark, [0.12345, 0.12355], lambda c: num.share(c, F.lit(1.0)), "double") == [0.1234, 0.1236]
    df = spark.createDataFrame([("abc", "abc"), ("abcd", "bcde"), ("ab", "ab"), ("ab", "cd"), ("aaaa", "aaa")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(num.chrf(F.col("a"), F.col("b"))).collect()] == [1.0, 0.5, 1.0, 0.0, 0.6667]
    assert column(spark, ["a", "b"], lambda c: num.hash_bucket(c)) == [int(__import__("hashlib").sha256(x).hexdigest()[:8], 16) % 10 for x in (b"a", b"b")]
