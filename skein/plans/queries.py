"""Registered queries of the core operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import numbers as num
from skein.functions import predicates as pred
from skein.functions.text import collapse_ws, normal_form, tokens, trim_ws
from skein.functions.timefn import day_of
from skein.operators import classify, curate, evaluate, features, labels, sessions, splits
from skein.runtime import cut, read_table
from skein.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
SEED, FRACTION = 20260808, 0.2
ASPECT, SINCE = "outcome", "2026-03-01T00:00:00+01:00"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- SQL pieces -------------------------------------------------------------------------------------------------------
def _bare(c: str) -> str:
    return rf"nullif(regexp_replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '^(omp|claude|codex|droid|kimi)[^0-9a-z]+', ''), '')"


def _micros(c: str) -> str:
    return rf"(case when regexp_matches({c}, '^\d{{4}}-\d\d-\d\d([T ].*)?$') then case when regexp_matches({c}, '(Z|[+-]\d\d:\d\d)$') then epoch_us(try_cast({c} as timestamptz)) else epoch_us(try_cast({c} as timestamp)) end end)"


# \s of the SQL engine knows ASCII only
_WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _collapse(c: str) -> str:
    return _trim(f"regexp_replace({c}, '{_WS}+', ' ', 'g')")


def _normal(c: str) -> str:
    return f"lower({_collapse(c)})"


def _bucket(c: str, n: int = 10) -> str:
    return f"(('0x' || substr(sha256({c}), 1, 8))::bigint % {n})"


def _has(c: str, words) -> str:
    return "(" + " or ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _starts(c: str, words) -> str:
    return "(" + " or ".join(f"starts_with({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_LATEST = f"""(select * exclude rn from (select *, row_number() over (partition by session_id, aspect order by ts desc, line desc) rn
    from (select {_bare("session_id")} session_id, aspect, coalesce(ts, '') ts, label_id line, runtime, value, source from session_labels) where session_id is not null) where rn = 1)"""
_TEXTS = f"""(select session_id, first(runtime order by ord) runtime, left(string_agg(text, chr(10) order by ord), 12000) as text
    from (select {_bare("session_id")} session_id, runtime, text_id ord, text from session_texts) where session_id is not null and text is not null group by session_id)"""
_DEC = """(select id, split_day, json_extract_string(case when json_valid(metadata) then metadata end, '$.runtime') runtime, a answer, u content, json_extract_string(a, '$.action') action, json_extract_string(a, '$.goal_ref') goal_ref,
    json_extract_string(a, '$.lifecycle_evidence') evidence, case when json_valid(u) then u end env from (select id, split_day, metadata, list_filter(messages, lambda m: m.role = 'assistant')[1].content a, list_filter(messages, lambda m: m.role = 'user')[1].content u from training_rows))"""
_GOALS = f"(select * replace ({_bare('session_id')} as session_id) from goal_rows)"
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


# --- labels -----------------------------------------------------------------------------------------------------------
def _latest(spark: SparkSession, d: str) -> DataFrame:
    return labels.latest_labels(tables.label_records(spark, d))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return sessions.session_texts(tables.text_events(spark, d), bucket="bucket")


@query(f"select session_id, aspect, ts, line, runtime, value, source from {_LATEST}")
def latest_labels(spark, d):
    return _latest(spark, d).select("session_id", "aspect", "ts", "line", "runtime", "value", "source")


@query("select user_id, event_type, max(ts) ts, arg_max(json_extract(props, '$.k')::bigint, (ts, event_id)) k from events group by all")
def latest_event_values(spark, d):
    e = read_table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return labels.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "ts", "k")


@query(f"select session_id, value, ts, runtime from {_LATEST} where aspect = 'outcome' and {_trim('source')} = 'human' and runtime in ('omp', 'claude', 'codex') and {_micros('ts')} >= epoch_us(timestamptz '{SINCE}') and value in ('solved', 'partial', 'abandoned')")
def select_labels(spark, d):
    return labels.select_labels(_latest(spark, d), ASPECT, "human", ["omp", "claude", "codex"], SINCE, ["solved", "partial", "abandoned"]).select("session_id", "value", "ts", "runtime")


@query(f"select label_id from session_labels where {_micros('ts')} >= epoch_us(timestamptz '{SINCE}')")
def since_filter(spark, d):
    return read_table(spark, d, "session_labels").where(labels.since_ok(F.col("ts"), SINCE)).select("label_id")


@query(f"select aspect, value, count(*) n from {_LATEST} group by all")
def class_counts(spark, d):
    return _latest(spark, d).groupBy("aspect", "value").agg(F.count(F.lit(1)).alias("n"))


@query(f"select case when t.text is null or {_trim('t.text')} = '' then 'no_text' when length(t.text) < 200 then 'too_short' else 'usable' end status, count(*) n from (select * from {_LATEST} where aspect = 'outcome') l left join {_TEXTS} t using (session_id) group by all")
def label_text_status(spark, d):
    return labels.with_text(labels.select_labels(_latest(spark, d), ASPECT), _texts(spark, d), 200).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"select distinct session_id from {_TEXTS} where session_id not in (select session_id from {_LATEST} where aspect = 'outcome')")
def unlabeled_sessions(spark, d):
    return labels.unlabeled(_texts(spark, d).select("session_id"), labels.select_labels(_latest(spark, d), ASPECT))


@query(f"select count(*) skipped from {_TEXTS} where session_id in (select session_id from {_LATEST} where aspect = 'outcome')")
def skipped_labeled(spark, d):
    return labels.labeled(_texts(spark, d).select("session_id"), labels.select_labels(_latest(spark, d), ASPECT)).agg(F.count(F.lit(1)).alias("skipped"))


@query(f"select l.session_id, value, source, ts, coalesce(l.runtime, t.runtime) runtime, text from (select * from {_LATEST} where aspect = 'outcome') l left join {_TEXTS} t using (session_id)")
def bundle_export(spark, d):
    return labels.bundle(labels.select_labels(_latest(spark, d), ASPECT), _texts(spark, d)).select("session_id", "value", "source", "ts", "runtime", "text")


@query("select user_id session_id, max(ts) last_ts, count(*) events from events group by 1")
def sessions_newest(spark, d):
    return sessions.sessions_listing(read_table(spark, d, "events").withColumnRenamed("user_id", "session_id")).orderBy(F.desc("last_ts"), "session_id")


# --- session texts ----------------------------------------------------------------------------------------------------
@query(f"select session_id, runtime, text from {_TEXTS}")
def session_texts(spark, d):
    return _texts(spark, d)


@query(f"select session_id, left(string_agg(text, chr(10) order by doc_id), 12000) as text from (select {_bare('session_id')} session_id, doc_id, text from documents) where session_id is not null and text is not null group by 1")
def session_documents_capped(spark, d):
    from skein.functions.text import bare_session_id

    t = read_table(spark, d, "documents").select(bare_session_id(F.col("session_id")).alias("session_id"), F.lit(None).cast("string").alias("runtime"), F.col("doc_id").alias("ord"), "text", F.floor(F.col("doc_id") / 1000).alias("bucket"))
    return sessions.session_texts(t, bucket="bucket").select("session_id", "text")


@query(f"select session_id from {_TEXTS} where {_trim('text')} <> '' and length(text) >= 500")
def min_text_filter(spark, d):
    return sessions.usable_text(_texts(spark, d), 500).select("session_id")


# --- splits -----------------------------------------------------------------------------------------------------------
_RANK = f"(select *, row_number() over (partition by value order by sha256('{SEED}:' || value || ':' || session_id), session_id) rk, count(*) over (partition by value) n from {{}})"
_USABLE = f"(select l.session_id, value from (select * from {_LATEST} where aspect = 'outcome' and value is not null) l join {_TEXTS} t using (session_id) where {_trim('t.text')} <> '')"
_SIDE = f"case when n >= 2 and rk <= least(n - 1, greatest(1, floor(n * {FRACTION}::double))) then 'holdout' else 'train' end"


def _usable(spark: SparkSession, d: str) -> DataFrame:
    chosen = labels.select_labels(_latest(spark, d), ASPECT).where("value is not null")
    return labels.with_text(chosen, _texts(spark, d)).where("status = 'usable'").select("session_id", "value", "text")


@query(f"select side, value, count(*) n from (select value, {_SIDE} side from {_RANK.format(_USABLE)}) group by all")
def split_summary(spark, d):
    """The flagship: latest labels of an aspect, joined with session texts, split by class, counted."""
    return splits.stratified_holdout(_usable(spark, d), FRACTION, SEED).groupBy("side", "value").agg(F.count(F.lit(1)).alias("n"))


_ALL = f"(select session_id || '/' || aspect session_id, value from {_LATEST} where value is not null)"


def _every(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).where("value is not null").select(F.concat_ws("/", "session_id", "aspect").alias("session_id"), "value")


@query(f"select session_id, value, {_SIDE} side from {_RANK.format(_ALL)}")
def stratified_holdout(spark, d):
    return splits.stratified_holdout(_every(spark, d), FRACTION, SEED)


@query(f"select session_id, value, ((rk - 1) % 5)::int fold from {_RANK.format(_ALL)}")
def cv_folds(spark, d):
    return splits.folds(_every(spark, d), SEED)


@query(f"""with f as (select distinct {_bare('s')} session_id from (select unnest(session_ids) s from frozen_splits where starts_with(job, 'outcome-'))), l as (select * from {_LATEST} where aspect = 'outcome')
    select case when f.session_id is null then 'train' when l.session_id is null then 'missing' else 'holdout' end side, count(*) n from l full join f using (session_id) group by all""")
def frozen_sides(spark, d):
    from skein.functions.text import bare_session_id

    ids = read_table(spark, d, "frozen_splits").where(F.startswith("job", F.lit("outcome-"))).select(F.explode("session_ids").alias("s")).select(bare_session_id(F.col("s")).alias("session_id")).distinct()
    have = labels.select_labels(_latest(spark, d), ASPECT)
    sides = splits.frozen_sides(have, ids).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    return sides.unionByName(ids.join(have, "session_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing").alias("side"), "n").where("n > 0"))


@query(f"select doc_id, case {_bucket('doc_id::varchar')} when 0 then 'test' when 1 then 'validation' else 'train' end split from documents")
def hash_bucket_split(spark, d):
    return read_table(spark, d, "documents").select("doc_id", num.bucket_split(F.col("doc_id").cast("string")).alias("split"))


@query(f"""with a as (select id, action, row_number() over (partition by action order by id) - 1 i, count(*) over (partition by action) n from {_DEC}), f as (select * from (values ('finishGoal', 900), ('ignore', 500), ('startGoal', 700)) t(action, fl))
    select id, action, copy::int copy from (select id, action, 0 copy from a union all select id, action, unnest(range(1, 1 + greatest(0, ((fl - n - i + n - 1) // n)))) copy from a join f using (action) where n < fl)""")
def oversample_cyclic(spark, d):
    t = tables.decisions(spark, d).select("id", F.col("target.action").alias("action"))
    return splits.oversample(t, "action", {"finishGoal": 900, "ignore": 500, "startGoal": 700}, "id")


@query("select frozen_id, (row_number() over (order by frozen_id) - 1) // 6 batch from frozen_splits")
def batching(spark, d):
    return splits.batches(read_table(spark, d, "frozen_splits"), 6, ["frozen_id"]).select("frozen_id", "batch")


# --- features ---------------------------------------------------------------------------------------------------------
_DOCS = f"(select doc_id doc, text from documents where {_trim('text')} <> '')"
_COUNTS = "(select doc, term, count(*) n from (select doc, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) term from (select doc, {tok} w from {docs})) group by all)"
_TF = _COUNTS.format(tok=_TOK, docs=_DOCS)


@query(f"select doc_id, len({_TOK})::int n_tokens, len(list_distinct({_TOK}))::int n_distinct, md5(array_to_string({_TOK}, ' ')) digest from documents where text is not null")
def tokens_per_doc(spark, d):
    w = tokens(F.col("text"))
    t = read_table(spark, d, "documents").where("text is not null").select("doc_id", w.alias("w"))
    return t.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(f"select term, count(*) df from {_TF} group by term")
def doc_frequency(spark, d):
    return features.document_frequency(features.term_counts(tables.word_texts(spark, d)))


def _tfidf_sql(counts: str, fitted: str, docs: str) -> str:
    return f"""with c as {counts}, f as {fitted}, i as (select term, ln((1 + (select count(*) from {docs})) / (1 + count(*))::double) + 1 idf from f group by term),
      r as (select doc, term, (1 + ln(n)) * idf w from c join i using (term)) select doc, term, round(w / sqrt(sum(w * w) over (partition by doc)), 6) weight from r"""


@query(_tfidf_sql(_TF, _TF, _DOCS))
def tfidf_weights(spark, d):
    return features.fit_transform(tables.word_texts(spark, d)).withColumn("weight", F.round("weight", 6))


_NOTES, _PLANS = (f"(select doc_id doc, text from documents where {_trim('text')} <> '' and doc_kind = '{k}')" for k in ("note", "plan"))


@query(_tfidf_sql(_COUNTS.format(tok=_TOK, docs=_PLANS), _COUNTS.format(tok=_TOK, docs=_NOTES), _NOTES))
def tfidf_transform_oov(spark, d):
    t = read_table(spark, d, "documents").where(trim_ws(F.col("text")) != "")
    of = lambda k: t.where(F.col("doc_kind") == k).select(F.col("doc_id").alias("doc"), "text")
    return features.transform(of("note"), of("plan")).withColumn("weight", F.round("weight", 6))


# --- evaluation -------------------------------------------------------------------------------------------------------
_KIND = "lower(regexp_replace(split_part(source, ':', 1), '^\\s+|\\s+$', '', 'g'))"
_BY_KIND = f"""(select session_id, aspect, kind, value from (select *, row_number() over (partition by session_id, aspect, kind order by ts desc, line desc) rn from
    (select {_bare("session_id")} session_id, aspect, {_KIND} kind, coalesce(ts, '') ts, label_id line, value from session_labels) where session_id is not null) where rn = 1)"""
_PREDS = f"(select g.value gold, p.value pred from {_BY_KIND} g join {_BY_KIND} p using (session_id, aspect) where g.kind = 'human' and p.kind = 'model' and g.value is not null)"


def _preds(spark: SparkSession, d: str) -> DataFrame:
    """gold (people's labels) against pred (models' labels) of the same session and aspect."""
    r = tables.label_records(spark, d).where("session_id is not null").withColumn("ts", F.coalesce("ts", F.lit(""))).withColumn("kind", F.lower(trim_ws(F.substring_index("source", ":", 1))))
    l = labels.latest(r.select("session_id", "aspect", "kind", "ts", "line", "value"), ["session_id", "aspect", "kind"], ["ts", "line"])
    of = lambda k, name: l.where(F.col("kind") == k).select("session_id", "aspect", F.col("value").alias(name))
    return of("human", "gold").where("gold is not null").join(of("model", "pred"), ["session_id", "aspect"]).select("gold", "pred")


@query(f"select gold \"value\", count(*) n, count(*) filter (gold = pred) correct, round_even(count(*) filter (gold = pred) / count(*)::double, 4) accuracy from {_PREDS} group by all")
def holdout_report(spark, d):
    return evaluate.holdout_report(_preds(spark, d))


@query(f"select gold, pred, count(*) n from {_PREDS} where gold is distinct from pred group by all")
def confusion_pairs(spark, d):
    return evaluate.confusion(_preds(spark, d)).orderBy(F.desc("n"), "gold", "pred")


_VERDICT = f"case {_bucket('goal_id')} when 0 then 'unacceptable' when 1 then 'unacceptable' when 2 then null else 'acceptable' end"


@query(f"""select runtime, count(*) filter (v in ('acceptable', 'unacceptable')) judged, count(*) filter (v = 'acceptable') acceptable, count(*) filter (v = 'unacceptable') unacceptable, count(*) filter (v is null) failed,
    round_even(coalesce(count(*) filter (v = 'acceptable') / nullif(count(*) filter (v in ('acceptable', 'unacceptable')), 0)::double, 0), 4) agreement_rate from (select runtime, {_VERDICT} v from goal_rows) group by all""")
def judge_aggregate(spark, d):
    b = num.hash_bucket(F.col("goal_id"))
    v = F.when(b < 2, F.lit("unacceptable")).when(b == 2, F.lit(None)).otherwise(F.lit("acceptable"))
    return evaluate.judge_aggregate(read_table(spark, d, "goal_rows").select("runtime", v.alias("verdict")), ["runtime"])


_SENSE = ("both-sensible", "label-nonsensical", "student-nonsensical", "both-nonsensical")
_SENSE_SQL = "case when g and s then 'both-sensible' when s then 'label-nonsensical' when g then 'student-nonsensical' else 'both-nonsensical' end"
_SHAPE = r"(regexp_matches({c}, '^\s*(<goal>)?[^<>]+(</goal>)?\s*$') and len(string_split(regexp_replace(trim(regexp_replace(regexp_replace({c}, '</?goal/?>', '', 'g'), '\s+', ' ', 'g')), '\.+$', ''), ' ')) between 3 and 7)"
_REVIEWS = f"(select pred_id, coalesce({_SHAPE.format(c='goal')}, false) g, coalesce({_SHAPE.format(c='student')}, false) s from predictions)"


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    """pred_id, verdict by whether label and student have the shape of a goal."""

    def shape(c: str) -> Column:
        words = F.split(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(c, "</?goal/?>", ""), r"\s+", " ")), r"\.+$", ""), " ")
        return F.coalesce(F.col(c).rlike(r"^\s*(<goal>)?[^<>]+(</goal>)?\s*$") & F.size(words).between(3, 7), F.lit(False))

    v = F.when(F.col("g") & F.col("s"), F.lit(_SENSE[0])).when(F.col("s"), F.lit(_SENSE[1])).when(F.col("g"), F.lit(_SENSE[2])).otherwise(F.lit(_SENSE[3]))
    return read_table(spark, d, "predictions").select("pred_id", shape("goal").alias("g"), shape("student").alias("s")).select("pred_id", v.alias("verdict"))


@query(f"""select (pred_id % 7)::bigint shard, count(*) filter (v = 'both-sensible') sensible, count(*) filter (v in ('label-nonsensical', 'both-nonsensical')) label_nonsensical,
    count(*) filter (v in ('student-nonsensical', 'both-nonsensical')) student_nonsensical, bool_and(v = 'both-sensible') passed from (select pred_id, {_SENSE_SQL} v from {_REVIEWS}) group by all""")
def second_review(spark, d):
    return evaluate.second_review(_reviews(spark, d).withColumn("shard", F.col("pred_id") % 7), ["shard"])


@query(f"select verdict, count(v) n from (select unnest(['both-sensible', 'label-nonsensical', 'student-nonsensical', 'both-nonsensical', 'unparseable']) verdict) left join (select {_SENSE_SQL} v from {_REVIEWS}) on v = verdict group by all")
def audit_counts_with_zeros(spark, d):
    return evaluate.counted_with_zeros(_reviews(spark, d), "verdict", _SENSE, "unparseable")


_AUDIT = f"(select id, runtime, case {_bucket('id', 60)} when 0 then 'wrong' when 1 then null else 'right' end verdict, action = 'finishGoal' dangerous, action from {_DEC})"


def _audit(spark: SparkSession, d: str) -> DataFrame:
    b = num.hash_bucket(F.col("id"), 60)
    v = F.when(b == 0, F.lit("wrong")).when(b == 1, F.lit(None)).otherwise(F.lit("right"))
    return tables.decisions(spark, d).select("id", "runtime", v.alias("verdict"), (F.col("target.action") == "finishGoal").alias("dangerous"), F.col("target.action").alias("action"))


@query(f"""select *, round_even(wrong / n::double, 4) wrong_rate, wrong <= n // 50 and unjudgeable = 0 and dangerous = 0 passed from (select runtime, count(*) n, count(*) filter (verdict = 'wrong') wrong,
    count(*) filter (verdict is null) unjudgeable, count(*) filter (verdict = 'wrong' and dangerous) dangerous from {_AUDIT} group by all)""")
def audit_thresholds(spark, d):
    return evaluate.audit(_audit(spark, d), ["runtime"])


@query(f"select action, count(*) n from {_AUDIT} where verdict = 'wrong' group by all")
def wrong_by_action(spark, d):
    return _audit(spark, d).where("verdict = 'wrong'").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


_PAIR = f"""(select id, split_day, runtime, action, goal_ref, evidence, case when {_bucket('id')} < 8 then action else 'ignore' end p_action, case when {_bucket("id || 'r'")} < 9 then goal_ref else 'NEW_GOAL' end p_ref,
    case when {_bucket("id || 'e'")} < 9 then evidence else 'none' end p_evidence, case when {_bucket("id || 't'")} < 9 then '' else 'New title' end p_title, {_bucket("id || 'v'")} > 0 valid from {_DEC})"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Targets with a prediction that differs from them by a hash of the id."""
    t, i = F.col("target"), F.col("id")
    b = lambda s: num.hash_bucket(F.concat(i, F.lit(s)))
    p = F.struct(
        F.when(b("") < 8, t["action"]).otherwise(F.lit("ignore")).alias("action"), F.when(b("r") < 9, t["goal_ref"]).otherwise(F.lit("NEW_GOAL")).alias("goal_ref"), F.when(b("e") < 9, t["lifecycle_evidence"]).otherwise(F.lit("none")).alias("lifecycle_evidence"), F.when(b("t") < 9, F.lit("")).otherwise(F.lit("New title")).alias("title"),
    )
    return tables.decisions(spark, d).withColumn("prediction", p).withColumn("valid", b("v") > 0)


def _metrics_sql(by: str) -> str:
    m = lambda c: f"round_even(avg(coalesce(({c}), false)::int), 4)"
    return f"""select {by}, count(*) n, {m('valid')} valid_json, {m('valid and action = p_action')} action_accuracy, {m('valid and goal_ref = p_ref')} goal_ref_accuracy, {m('valid and evidence = p_evidence')} evidence_accuracy,
      {m('valid and action = p_action and goal_ref = p_ref and evidence = p_evidence')} joint_accuracy, {m("valid and action = p_action and goal_ref = p_ref and evidence = p_evidence and p_title = ''")} exact_json,
      round_even(coalesce(count(*) filter (valid and p_action = 'finishGoal' and action = 'finishGoal') / nullif(count(*) filter (valid and p_action = 'finishGoal'), 0)::double, 0), 4) finish_precision from {_PAIR} group by all"""


@query(_metrics_sql("runtime"))
def decision_metrics(spark, d):
    return evaluate.decision_metrics(_pairs(spark, d), ["runtime"])


@query(_metrics_sql("action"))
def decision_metrics_by_action(spark, d):
    return evaluate.decision_metrics(_pairs(spark, d).withColumn("action", F.col("target.action")), ["action"])


@query(f"""select dims, count(*) n from (select array_to_string(list_filter([case when action is distinct from p_action then 'action' end, case when goal_ref is distinct from p_ref then 'goal_ref' end,
    case when evidence is distinct from p_evidence then 'lifecycle_evidence' end], lambda x: x is not null), '+') dims from {_PAIR}) group by all""")
def error_dimensions(spark, d):
    dims = evaluate.error_dimensions(["action", "goal_ref", "lifecycle_evidence"])
    return _pairs(spark, d).select(dims.alias("dims")).groupBy("dims").agg(F.count(F.lit(1)).alias("n"))


@query("""select doc_kind, len(a) n, a[1 + len(a) * 50 // 100] p50, a[1 + len(a) * 90 // 100] p90, a[1 + len(a) * 99 // 100] p99, a[len(a)] "max"
    from (select doc_kind, list_sort(list(n_chars)) a from documents where n_chars is not null group by all)""")
def positional_percentiles(spark, d):
    return evaluate.percentiles(read_table(spark, d, "documents"), "doc_kind", "n_chars", {"p50": 50, "p90": 90, "p99": 99})


_DAY = r"regexp_replace(regexp_extract(trim(split_day), '^\d{4}[-/]?\d\d[-/]?\d\d'), '^(\d{4})[-/]?(\d\d)[-/]?(\d\d)$', '\1-\2-\3')"


@query(f"select nullif({_DAY}, '') \"day\", " + ", ".join(f"count(*) filter (action = '{a}') \"{a}\"" for a in ("startGoal", "continueCurrent", "finishGoal", "ignore")) + f" from {_DEC} group by 1")
def day_action_counts(spark, d):
    t = tables.decisions(spark, d).select("id", day_of(F.col("split_day")).alias("day"), F.col("target.action").alias("action"))
    actions = ["startGoal", "continueCurrent", "finishGoal", "ignore"]
    return t.dropDuplicates(["id"]).groupBy("day").pivot("action", actions).count().fillna(0, actions)


@query(f"""select evidence, coalesce(json_extract_string(list_filter(json_extract(env, '$.candidates[*]'), lambda c: json_extract_string(c, '$.ref') = goal_ref)[1], '$.status'), 'none') status, count(*) n from {_DEC} group by all""")
def invariant_histograms(spark, d):
    ref = F.col("target.goal_ref")
    status = F.get(F.filter("envelope.candidates", lambda c: c["ref"] == ref), F.lit(0))["status"]
    return tables.decisions(spark, d).select(F.col("target.lifecycle_evidence").alias("evidence"), F.coalesce(status, F.lit("none")).alias("status")).groupBy("evidence", "status").agg(F.count(F.lit(1)).alias("n"))


_CAND = "json_extract(env, '$.candidates[*]')"
_STATUS = f"coalesce(json_extract_string(list_filter({_CAND}, lambda c: json_extract_string(c, '$.ref') = goal_ref)[1], '$.status'), 'missing')"


@query(f"""select kind, "value", count(*) n from (select 'open status' kind, {_STATUS} "value" from {_DEC} where evidence = 'explicit_open' union all select 'finish status', {_STATUS} from {_DEC} where action = 'finishGoal'
    union all select 'start title words', (case when {_trim("json_extract_string(answer, '$.title')")} = '' then 0 else len(string_split({_collapse("json_extract_string(answer, '$.title')")}, ' ')) end)::varchar from {_DEC} where action = 'startGoal' and json_extract_string(answer, '$.title') is not null) group by all""")
def invariant_counts(spark, d):
    """Status of the candidate that open evidence and finishes name, and words of the titles of starts."""
    t = F.col("target")
    status = F.coalesce(F.get(F.filter("envelope.candidates", lambda c: c["ref"] == t["goal_ref"]), F.lit(0))["status"], F.lit("missing"))
    words = F.when(trim_ws(t["title"]) == "", F.lit(0)).otherwise(F.size(F.split(collapse_ws(t["title"]), " "))).cast("string")
    kind = lambda cond, name, value: F.when(cond, F.struct(F.lit(name).alias("kind"), value.alias("value")))
    three = [kind(t["lifecycle_evidence"] == "explicit_open", "open status", status), kind(t["action"] == "finishGoal", "finish status", status), kind((t["action"] == "startGoal") & t["title"].isNotNull(), "start title words", words)]
    rows = tables.decisions(spark, d).select(F.explode(F.array_compact(F.array(*three))).alias("x"))
    return rows.groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


_STYLE = f"""(select pred_id, {_bucket("pred_id || 'sf'", 21)} / 20.0::double sf, {_bucket("pred_id || 'vm'", 21)} / 20.0::double vm, {_bucket("pred_id || 'ab'")} = 0 ab, {_bucket("pred_id || 'ok'")} > 0 ok, pred_id % 2 = 0 student from predictions)"""
_GAIN = "avg(vm) filter (student) - avg(vm) filter (not student)"
_DELTA = "avg(sf) filter (student) - avg(sf) filter (not student)"


@query(f"""select round_even(avg(sf) filter (not student), 4) base_semantic_fidelity, round_even(avg(vm) filter (not student), 4) base_voice_match, round_even(avg(ab::int) filter (not student), 4) base_ai_boilerplate, round_even(avg(ok::int) filter (not student), 4) base_passed,
    round_even(avg(sf) filter (student), 4) student_semantic_fidelity, round_even(avg(vm) filter (student), 4) student_voice_match, round_even(avg(ab::int) filter (student), 4) student_ai_boilerplate, round_even(avg(ok::int) filter (student), 4) student_passed,
    round_even({_GAIN}, 4) voice_gain, round_even({_DELTA}, 4) semantic_delta, avg(sf) filter (student) >= 0.95 and avg(vm) filter (student) >= 0.8 and avg(ok::int) filter (student) >= 0.9 and avg(ab::int) filter (student) <= 0.08 and {_GAIN} >= 0.15 and {_DELTA} >= -0.02 gates_hold from {_STYLE}""")
def style_audit(spark, d):
    """Means and gates over verdicts that are drawn from hashes of the ids."""
    b = lambda s, n=10: num.hash_bucket(F.concat(F.col("pred_id").cast("string"), F.lit(s)), n)
    who = F.when(F.col("pred_id") % 2 == 0, F.lit("student")).otherwise(F.lit("base"))
    v = read_table(spark, d, "predictions").select("pred_id", who.alias("candidate"), (b("sf", 21) / 20.0).alias("semantic_fidelity"), (b("vm", 21) / 20.0).alias("voice_match"), (b("ab") == 0).alias("ai_boilerplate"), (b("ok") > 0).alias("passed"))
    return evaluate.style_audit(v)


_FROZEN_IDS = f"(select distinct {_bare('s')} session_id from (select unnest(session_ids) s from frozen_splits))"


@query(f"""select count(*) frozen, count(*) filter (v is null) missing_ground_truth, count(*) filter (v is not null and coalesce({_trim('t')}, '') = '') skipped_no_text, count(*) filter (v is not null and coalesce({_trim('t')}, '') <> '') usable
    from (select f.session_id, l.value v, x.text t from {_FROZEN_IDS} f left join (select * from {_LATEST} where aspect = 'outcome') l using (session_id) left join {_TEXTS} x using (session_id) where f.session_id is not null)""")
def frozen_holdout(spark, d):
    """How many frozen sessions can still be scored, and why the others can't."""
    from skein.functions.text import bare_session_id
    from skein.plans import flows

    ids = read_table(spark, d, "frozen_splits").select(F.explode("session_ids").alias("s")).select(bare_session_id(F.col("s")).alias("session_id")).where("session_id is not null")
    return flows.frozen_holdout(ids, _latest(spark, d).where(F.col("aspect") == ASPECT), _texts(spark, d))[1]


@query("select goal_id from goal_rows where message is not null order by sha256(message), goal_id limit 256")
def hash_first(spark, d):
    return splits.hash_first(read_table(spark, d, "goal_rows").where("message is not null").select("message", "goal_id"), "message").select("goal_id")


@query()
def stratified_slice(spark, d):
    """A tenth of the labels of the aspect for validation, spread over its classes."""
    l = _latest(spark, d).where((F.col("aspect") == ASPECT) & F.col("value").isNotNull())
    return splits.stratified_slice(l.select("session_id", "value"), max(2, l.count() // 10), SEED)


# --- curation ---------------------------------------------------------------------------------------------------------
@query(f"select session_id, min(goal_id) goal_id, arg_min(message, goal_id) message from {_GOALS} where session_id is not null and message is not null group by all")
def first_user_message(spark, d):
    g = tables.goals(spark, d).where("session_id is not null and message is not null")
    return curate.first_by(g.select("session_id", "goal_id", "message"), ["session_id"], ["goal_id"])


_TITLE = f"(select session_id, goal, row_number() over (partition by session_id order by case goal_source when 'title' then 0 else 1 end, goal_id) rn from {_GOALS} where goal is not null and session_id is not null)"


def _titles(spark: SparkSession, d: str) -> DataFrame:
    g = tables.goals(spark, d).where("goal is not null and session_id is not null").withColumn("o", F.when(F.col("goal_source") == "title", 0).otherwise(1))
    return curate.first_by(g.select("session_id", "o", "goal_id", "goal"), ["session_id"], ["o", "goal_id"]).select("session_id", "goal")


@query(f"select session_id, goal from {_TITLE} where rn = 1")
def preferred_title(spark, d):
    return _titles(spark, d)


@query(f"select session_id, u.message, t.goal from (select session_id, arg_min(message, goal_id) message from {_GOALS} where session_id is not null and message is not null group by all) u join {_TITLE} t using (session_id) where rn = 1")
def gold_join(spark, d):
    return first_user_message(spark, d).select("session_id", "message").join(_titles(spark, d), "session_id")


_RANKED = f"(select *, row_number() over (partition by runtime, session_id order by goal_id) rk from {_GOALS} where message is not null and session_id is not null)"


def _first_ten(spark: SparkSession, d: str) -> DataFrame:
    g = tables.goals(spark, d).where("message is not null and session_id is not null")
    return curate.first_n(g, ["runtime", "session_id"], ["goal_id"], 10)


@query(f"select goal_id, rk \"rank\" from {_RANKED} where rk <= 10")
def first_n_per_session(spark, d):
    return _first_ten(spark, d).select("goal_id", F.col("rank").cast("long").alias("rank"))


@query(f"select goal_id from {_RANKED} where rk <= 10 and length(message) between 3 and 4000 order by goal_id desc limit 400")
def overfetch_candidates(spark, d):
    return _first_ten(spark, d).where(F.length("message").between(3, 4000)).orderBy(F.desc("goal_id")).limit(400).select("goal_id")


@query(f"select digest, min(doc_id) doc_id, count(*) copies from (select doc_id, sha256({_normal('text')}) digest from documents where text is not null) group by all")
def dedupe_first(spark, d):
    t = read_table(spark, d, "documents").where("text is not null").select("doc_id", curate.digest(F.col("text")).alias("digest"))
    return t.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


_UNION = f"""(select goal_id, goal, gold, exempt from (select *, row_number() over (partition by exempt, digest order by part, goal_id) rn from (select goal_id, goal, coalesce(gold, false) gold, sha256({_normal('message')}) digest,
    case when gold then 0 else 1 end part, coalesce(goal_source = 'contract:no-task-v1', false) exempt from goal_rows where message is not null)) where exempt or rn = 1)"""


def _union(spark: SparkSession, d: str) -> DataFrame:
    g = read_table(spark, d, "goal_rows").where("message is not null").select("goal_id", "goal", "goal_source", F.coalesce("gold", F.lit(False)).alias("gold"), curate.digest(F.col("message")).alias("digest"))
    return curate.priority_union(g.where("gold"), g.where("not gold"), ["goal_id"], F.col("goal_source") == "contract:no-task-v1")


@query(f"select goal_id, gold from {_UNION}")
def priority_union(spark, d):
    return _union(spark, d).select("goal_id", "gold")


@query(f"""select goal_id, gold or (rn <= 32) gold from (select *, row_number() over (partition by gold, goal is null order by goal_id) rn from {_UNION}) where goal is not null or gold or rn <= 32""")
def goal_holdout_budget(spark, d):
    return curate.holdout_budget(_union(spark, d).select("goal_id", "goal", "gold"), ["goal_id"]).select("goal_id", "gold")


@query("""select runtime, count(*) n, count(*) filter (gold) gold, count(*) filter (goal is null) without_goal, count(*) filter (goal_source = 'contract:no-task-v1') no_task, count(*) filter (reviewed_by is not null) reviewed, count(distinct message) messages from goal_rows group by all""")
def goal_summary(spark, d):
    c = F.count_if
    return read_table(spark, d, "goal_rows").groupBy("runtime").agg(
        F.count(F.lit(1)).alias("n"), c(F.col("gold")).alias("gold"), c(F.col("goal").isNull()).alias("without_goal"), c(F.col("goal_source") == "contract:no-task-v1").alias("no_task"), c(F.col("reviewed_by").isNotNull()).alias("reviewed"), F.count_distinct("message").alias("messages")
    )


@query("select json_extract_string(list_filter(messages, lambda m: m.role = 'assistant')[1].content, '$.action') action, count(*) n from training_rows group by all")
def action_histogram(spark, d):
    content = F.get(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(0))["content"]
    return read_table(spark, d, "training_rows").groupBy(F.get_json_object(content, "$.action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, count(distinct text) versions from (select doc_id, text from documents union all select doc_id - 1, text from documents where doc_id % 5 = 0) group by all having count(distinct text) > 1")
def conflict_check(spark, d):
    t = read_table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return curate.conflicts(t.unionByName(t.where("doc_id % 5 = 0").withColumn("doc_id", F.col("doc_id") - 1)), "doc_id", ["text"])


@query(f"select {_bare('session_id')} session_id from goal_rows where gold and {_bare('session_id')} is not null intersect select {_bare('session_id')} from predictions")
def split_overlap(spark, d):
    from skein.functions.text import bare_session_id

    p = read_table(spark, d, "predictions").select(bare_session_id(F.col("session_id")).alias("session_id"))
    return curate.overlap(tables.goals(spark, d).where("gold and session_id is not null"), p, "session_id")


@query(f"select pred_id from predictions where message is not null and {_normal('message')} not in (select {_normal('message')} from goal_rows where message is not null)")
def known_antijoin(spark, d):
    return curate.not_known(read_table(spark, d, "predictions").where("message is not null"), read_table(spark, d, "goal_rows").where("message is not null"), "message").select("pred_id")


@query("select g.goal_id from goal_rows g anti join (select goal_id from goal_rows where reviewed_by is not null) r using (goal_id)")
def resume_antijoin(spark, d):
    g = read_table(spark, d, "goal_rows")
    return g.join(g.where("reviewed_by is not null").select("goal_id"), "goal_id", "left_anti").select("goal_id")


@query(f"select coalesce(action, 'none') || '->' || p_action transition, count(*) n from {_PAIR} where action is distinct from p_action group by all")
def curriculum_moves(spark, d):
    p = _pairs(spark, d).select("id", F.col("target.action").alias("intended"), F.col("prediction.action").alias("reviewed"))
    return curate.accepted(p, "intended", "reviewed")[1]


@query(f"""with v as (select id from {_DEC} where {_bucket('id')} > 0 union all select id from {_DEC} where {_bucket('id')} = 5 union all select id || 'x' from {_DEC} where {_bucket('id')} = 7),
    j as (select p.id p, v.id v, c from (select distinct id from {_DEC}) p full join (select id, count(*) c from v group by id) v on p.id = v.id)
    select case when v is null then 'missing' when p is null then 'unknown' else 'duplicate' end problem, count(*) n from j where v is null or p is null or c > 1 group by all""")
def verdict_join(spark, d):
    ids = tables.decisions(spark, d).select("id").withColumn("b", num.hash_bucket(F.col("id")))
    v = ids.where("b > 0").select("id").unionByName(ids.where("b = 5").select("id")).unionByName(ids.where("b = 7").select(F.concat("id", F.lit("x")).alias("id")))
    return curate.verdict_join(ids, v)


@query(f"""with p as (select regexp_replace(regexp_replace(lower(goal_source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') "name", goal_id ord, runtime "value" from goal_rows where goal_source is not null),
    f as (select "name", "value", min(ord) ord from p where "value" is not null group by all), k as (select *, row_number() over (partition by "name" order by ord, "value") rn from f)
    select "name", support, vals from (select "name", count(*) support from p group by all) left join (select "name", list("value" order by rn) vals from k where rn <= 3 group by all) using ("name") order by support desc, "name" limit 8""")
def proposal_merge(spark, d):
    g = read_table(spark, d, "goal_rows").where("goal_source is not null").select(pred.kebab(F.col("goal_source")).alias("name"), F.col("goal_id").alias("ord"), F.col("runtime").alias("value"))
    return curate.merge_proposals(g, 3, 8)


_OLD = "list_filter(json_extract(env, '$.candidates[*]'), lambda c: json_extract_string(c, '$.ref') is distinct from 'NEW_GOAL')"
_SAME = f"list_filter({_OLD}, lambda c: coalesce(json_extract_string(c, '$.same_session') = 'true', false))"
_SCORE = "coalesce(json_extract_string({x}, '$.score')::double, 0)"


@query(f"""select id, json_extract_string(c, '$.ref') ref, json_extract_string(c, '$.score')::double score from (select id, list_reduce(case when len({_SAME}) > 0 then {_SAME} else {_OLD} end,
    lambda a, b: case when {_SCORE.format(x='b')} > {_SCORE.format(x='a')} then b else a end) c from {_DEC} where len({_OLD}) > 0)""")
def candidate_pick(spark, d):
    """The candidate with the highest score, of the same session if there is one."""
    best = curate.best_candidate(F.col("envelope.candidates"))
    return tables.decisions(spark, d).select("id", best.alias("b")).where("b is not null").select("id", "b.ref", "b.score")


# --- functions --------------------------------------------------------------------------------------------------------
_T = _trim("message")
_LOW = f"lower({_T})"
_SAFE = f"(length({_T}) between 3 and 4000 and not starts_with({_T}, '/') and not {_has(_LOW, pred.SECRET_MARKERS)})"
_EDGE = rf"regexp_replace({_LOW}, '^[\s!-/:-@\[-`{{-~]+|[\s!-/:-@\[-`{{-~]+$', '', 'g')"


@query(f"""select goal_id, {_SAFE} safe, {_SAFE} and not {_starts(_LOW, pred.SYNTHETIC_PREFIXES)} and not regexp_matches({_LOW}, '{pred.CLASSIFIER_PREFIX.replace("'", "''")}') and not contains({_LOW}, '{pred.SYNTHETIC_FRAGMENT}') task,
    {_collapse(_EDGE)} in ({", ".join(f"'{x}'" for x in pred.NO_TASK)}) no_task from goal_rows where message is not null""")
def message_flags(spark, d):
    m = F.col("message")
    return read_table(spark, d, "goal_rows").where("message is not null").select("goal_id", pred.safe_message(m).alias("safe"), pred.task_message(m).alias("task"), pred.obvious_no_task(m).alias("no_task"))


_A = _trim("text")


@query(rf"""select doc_id, length(t) between 20 and 2000 and len(string_split(regexp_replace(t, '\r?\n$', ''), chr(10))) <= 8 and not starts_with(t, '/') and not {_starts('lower(t)', pred.UNAUTHORED_PREFIXES)} and not {_has('lower(t)', pred.UNAUTHORED_FRAGMENTS)}
    and len(list_filter(string_split({_collapse('t')}, ' '), lambda w: regexp_matches(w, '\p{{L}}'))) >= 4 and length(regexp_replace(t, '[^\p{{L}}\p{{N}}{_WS[1:-1]}]', '', 'g')) * 100 // greatest(1, length(t)) >= 65 authored from (select doc_id, {_A} t from documents where text is not null)""")
def likely_authored(spark, d):
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", pred.likely_authored(F.col("text")).alias("authored"))


_AUTHORED = rf"""length(t) between 20 and 2000 and len(string_split(regexp_replace(t, '\r?\n$', ''), chr(10))) <= 8 and not starts_with(t, '/') and not {_starts('lower(t)', pred.UNAUTHORED_PREFIXES)} and not {_has('lower(t)', pred.UNAUTHORED_FRAGMENTS)}
    and len(list_filter(string_split({_collapse('t')}, ' '), lambda w: regexp_matches(w, '\p{{L}}'))) >= 4 and length(regexp_replace(t, '[^\p{{L}}\p{{N}}{_WS[1:-1]}]', '', 'g')) * 100 // greatest(1, length(t)) >= 65"""


@query(f"""with a as (select goal_id, session_id, {_trim('message')} t, sha256({_normal('message')}) digest, sha256(session_id || ':' || message) hk from {_GOALS} where session_id is not null and runtime in ('omp', 'claude', 'codex', 'droid', 'kimi') and length(message) between 20 and 2000 order by hk, goal_id limit 3600),
    o as (select * from (select *, row_number() over (partition by digest order by hk, goal_id) rn from a where {_AUTHORED}) where rn = 1), c as (select *, row_number() over (partition by session_id order by hk) k from o)
    select goal_id from c where k <= 6 order by hk limit 300""")
def humanizer_export(spark, d):
    from skein.plans import flows

    return flows.humanizer_export(tables.goals(spark, d), 300).select("goal_id")


_INNER = rf"regexp_replace({_collapse(r'''regexp_extract(t, '(?s)<goal>(.*?)</goal>', 1)''')}, '\.+$', '')"
_NW = f"(case when {_trim('g')} = '' then 0 else len(string_split({_trim('g')}, ' ')) end)"


@query(f"""select pred_id, kind, case when kind = 'task' then g end goal from (select pred_id, g, case when t in ('<goal/>', '<goal></goal>') then 'no_task' when regexp_matches(t, '(?s)<goal>.*?</goal>') and {_NW} between 3 and 7 and length(g) <= 100 then 'task' else 'rejected' end kind
    from (select pred_id, t, {_INNER} g from (select pred_id, {_trim('student')} t from predictions)))""")
def parse_goal(spark, d):
    return read_table(spark, d, "predictions").select("pred_id", pred.parse_goal(F.col("student")).alias("p")).select("pred_id", "p.kind", "p.goal")


@query(f"select pred_id, lower({_trim('goal')}) in ({', '.join(repr(x) for x in pred.GENERIC_GOALS)}) or lower(g) in ({', '.join(repr(x) for x in pred.GENERIC_GOALS)}) generic from (select pred_id, goal, regexp_replace(goal, '</?goal/?>', '', 'g') g from predictions) where goal is not null")
def generic_goals(spark, d):
    g = F.col("goal")
    return read_table(spark, d, "predictions").where("goal is not null").select("pred_id", (pred.generic_goal(trim_ws(g)) | pred.generic_goal(F.regexp_replace(g, "</?goal/?>", ""))).alias("generic"))


# ordinal signs are letters at a word's edge; the SQL engine's \\b knows ASCII only
_ANCHORS = r"list_distinct(regexp_extract_all(translate({c}, 'ºª', 'oa'), 'https?://\S+|\b[\w.+-]+@[\w.-]+\.[A-Za-z]{{2,}}\b|\b\d[\d.,:/%-]*\b'))"


@query(f"select goal_id, len({_ANCHORS.format(c='message')})::int n_anchors, array_to_string(list_sort({_ANCHORS.format(c='message')}), ' ') anchors from goal_rows where message is not null")
def anchors_per_message(spark, d):
    a = pred.anchors(F.col("message"))
    return read_table(spark, d, "goal_rows").where("message is not null").select("goal_id", F.size(a).alias("n_anchors"), F.array_join(F.array_sort(a), " ").alias("anchors"))


@query(f"""select pred_id, coalesce(s <> '' and s <> t and length(s) / greatest(1, length(t))::double between 0.65 and 2.5 and len(list_filter({_ANCHORS.format(c='t')}, lambda x: not list_contains({_ANCHORS.format(c='s')}, x))) = 0, false) valid
    from (select pred_id, {_trim('goal')} t, {_trim('student')} s from predictions where goal is not null and student is not null)""")
def style_pair_valid(spark, d):
    p = read_table(spark, d, "predictions").where("goal is not null and student is not null")
    return p.select("pred_id", F.coalesce(pred.valid_source(F.col("goal"), F.col("student")), F.lit(False)).alias("valid"))


@query(f"""select reason, count(*) n from (select case when coalesce(s, '') = '' then 'blank' when s = t then 'same' when not (length(s) / greatest(1, length(t))::double between 0.65 and 2.5) then 'length'
    when len(list_filter({_ANCHORS.format(c='t')}, lambda x: not list_contains({_ANCHORS.format(c='s')}, x))) > 0 then 'anchors' end reason from (select {_trim('goal')} t, {_trim('student')} s from predictions where goal is not null)) where reason is not null group by all""")
def rejection_reasons(spark, d):
    r = pred.rejection_reason(F.col("goal"), F.col("student"))
    return read_table(spark, d, "predictions").where("goal is not null").select(r.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy("reason")


_GRAMS = "(case when length({c}) < 3 then [{c}] else list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3)) end)"


@query(f"""with p as (select pred_id, {_GRAMS.format(c='goal')} a, {_GRAMS.format(c='student')} b from predictions where goal is not null and student is not null), x as (select pred_id, unnest(a) g, 1 s from p union all select pred_id, unnest(b), 2 from p),
    m as (select pred_id, sum(least(na, nb)) common from (select pred_id, g, count(*) filter (s = 1) na, count(*) filter (s = 2) nb from x group by all) group by all)
    select pred_id, round(case when common > 0 then 2 * (common / len(b)::double) * (common / len(a)::double) / (common / len(b)::double + common / len(a)::double) else 0 end, 6) chrf from p join m using (pred_id)""")
def trigram_chrf(spark, d):
    return evaluate.chrf_scores(read_table(spark, d, "predictions"), "pred_id", "goal", "student").withColumn("chrf", F.round("chrf", 6))


def _chrf_mean(a: str, b: str) -> str:
    return f"""(with p as (select pred_id, {_GRAMS.format(c=a)} a, {_GRAMS.format(c=b)} b from predictions where goal is not null and student is not null and message is not null), x as (select pred_id, unnest(a) g, 1 s from p union all select pred_id, unnest(b), 2 from p),
      m as (select pred_id, sum(least(na, nb)) common from (select pred_id, g, count(*) filter (s = 1) na, count(*) filter (s = 2) nb from x group by all) group by all) select avg(2 * common / (len(a) + len(b))::double) from p join m using (pred_id))"""


@query(f"select round_even(b, 4) base, round_even(s, 4) student, round_even(s - b, 4) gain from (select {_chrf_mean('goal', 'message')} b, {_chrf_mean('goal', 'student')} s)")
def similarity_gain(spark, d):
    """Mean similarity to the goal of the bare message and of the student's answer, and what the student gains."""
    return evaluate.similarity_gain(read_table(spark, d, "predictions"), "pred_id", "goal", "message", "student").select("base", "student", "gain")


@query()
def sequence_ratio(spark, d):
    return read_table(spark, d, "predictions").select("pred_id", F.round(num.sequence_ratio(F.col("goal"), F.col("student")), 6).alias("ratio"))


@query(r"""select label_id, regexp_replace(regexp_replace(lower(note), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') kebab, regexp_replace(regexp_replace(source, '[^A-Za-z0-9._-]+', '--', 'g'), '^-+|-+$', '', 'g') folder,
    regexp_matches(aspect, '^[a-z0-9][a-z0-9_-]*$') name_ok, regexp_matches(source, '^(manual|human|model|brama)(:[A-Za-z0-9._/-]+)?$') source_ok from session_labels""")
def name_grammar(spark, d):
    return read_table(spark, d, "session_labels").select(
        "label_id", pred.kebab(F.col("note")).alias("kebab"), pred.directory_name(F.col("source")).alias("folder"), pred.name_ok(F.col("aspect")).alias("name_ok"), pred.source_ok(F.col("source")).alias("source_ok")
    )


_VALUES = ["solved", "partial", "abandoned"]
_CLEAN = """regexp_replace(trim(a), '^["''`.\\s]+|["''`.\\s]+$', '', 'g')"""


@query(f"""select label_id, case when v <> '' then v when len(i) = 1 then i[1] end "value", v <> '' exact from (select label_id, coalesce(list_filter(['solved', 'partial', 'abandoned'], lambda x: lower(x) = lower({_CLEAN}))[1], '') v,
    list_filter(['solved', 'partial', 'abandoned'], lambda x: contains(lower(a), lower(x))) i from (select label_id, coalesce(note, '') || ' ' || coalesce(value, '') || '.' a from session_labels))""")
def parse_answer(spark, d):
    a = F.concat(F.coalesce("note", F.lit("")), F.lit(" "), F.coalesce("value", F.lit("")), F.lit("."))
    return read_table(spark, d, "session_labels").select("label_id", pred.parse_answer(a, _VALUES).alias("p")).select("label_id", "p.value", "p.exact")


@query(r"select doc_id, nullif(regexp_extract(text, '(?s)\{.*\}'), '') obj from documents where text is not null")
def json_object_extract(spark, d):
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", pred.first_json_object(F.col("text")).alias("obj"))


@query(f"""select goal_id, 0 turn_index, true is_first_turn, true has_new_objective, (case when {_trim('message')} = '' then 0 else len(string_split({_collapse('message')}, ' ')) end)::int word_count, (case when {_trim('message')} = '' then 0 else len(string_split({_collapse('message')}, ' ')) end) <= 12 is_short_prompt, contains(message, '?') is_question,
    {_has('lower(message)', ("status", "progress", "what happened"))} has_status, {_has('lower(message)', ("wrong", "instead", "do not", "don't"))} has_correction, {_has('lower(message)', ("done", "finished", "thanks", "thank you"))} has_completion from goal_rows where message is not null""")
def message_features(spark, d):
    return read_table(spark, d, "goal_rows").where("message is not null").select("goal_id", *pred.lifecycle_features(F.col("message")))


_FAMILY = "(case action when 'finishGoal' then 'finish_topic' when 'startGoal' then 'start_switch' when 'ignore' then 'ignore_status' else 'continue_correction' end)"
_ETEXT = "json_extract_string(env, '$.text')"


@query(f"""select id, coalesce(json_extract(env, '$.turn_index')::bigint, 0) turn_index, false is_first_turn, (case when {_trim(_ETEXT)} = '' then 0 else len(string_split({_collapse(_ETEXT)}, ' ')) end)::int word_count,
    (case when {_trim(_ETEXT)} = '' then 0 else len(string_split({_collapse(_ETEXT)}, ' ')) end) <= 12 is_short_prompt, contains({_ETEXT}, '?') is_question, {_FAMILY} = 'start_switch' has_new_objective, {_FAMILY} = 'ignore_status' has_status,
    {_FAMILY} = 'continue_correction' has_correction, {_FAMILY} = 'finish_topic' or {_has(f'lower({_ETEXT})', pred.FINISHED_WORDS)} has_completion from {_DEC} where {_ETEXT} is not null""")
def feature_flags(spark, d):
    a = F.col("target.action")
    family = F.when(a == "finishGoal", F.lit("finish_topic")).when(a == "startGoal", F.lit("start_switch")).when(a == "ignore", F.lit("ignore_status")).otherwise(F.lit("continue_correction"))
    rows = tables.decisions(spark, d).where("envelope.text is not null")
    return rows.select("id", *pred.feature_flags(F.col("envelope.text"), family, F.coalesce("envelope.turn_index", F.lit(0))))


@query(f"""select id, coalesce(action <> 'finishGoal' and {_has("lower(json_extract_string(env, '$.text'))", pred.COMPLETION_WORDS)}, false) completion_negative,
    coalesce(evidence = 'none' and {_has("lower(json_extract_string(env, '$.text'))", pred.OPEN_WORDS)}, false) open_negative from {_DEC}""")
def keyword_negatives(spark, d):
    t, text = F.col("target"), F.col("envelope.text")
    return tables.decisions(spark, d).select(
        "id", F.coalesce((t["action"] != "finishGoal") & pred.keyword_negative(text, pred.COMPLETION_WORDS), F.lit(False)).alias("completion_negative"),
        F.coalesce((t["lifecycle_evidence"] == "none") & pred.keyword_negative(text, pred.OPEN_WORDS), F.lit(False)).alias("open_negative"),
    )


_OK = "(action in ('startGoal', 'continueCurrent', 'finishGoal', 'ignore') and goal_ref is not null and evidence in ('none', 'explicit_open', 'explicit_completion') and (action = 'startGoal') = (goal_ref = 'NEW_GOAL') and (action = 'finishGoal') = (evidence = 'explicit_completion'))"
_REFS = "list_transform(json_extract(env, '$.candidates[*]'), lambda c: json_extract_string(c, '$.ref'))"


@query(f"select id, coalesce({_OK}, false) ok, coalesce(env is not null and {_OK} and list_contains(list_append({_REFS}, 'NEW_GOAL'), goal_ref), false) ok_in_refs, coalesce(len({_REFS}), 0)::int n_refs from {_DEC}")
def decision_contract(spark, d):
    refs = F.transform("envelope.candidates", lambda c: c["ref"])
    return tables.decisions(spark, d).select("id", pred.decision_ok(F.col("target")).alias("ok"), F.when(refs.isNull(), F.lit(False)).otherwise(pred.decision_ok(F.col("target"), refs)).alias("ok_in_refs"), F.coalesce(F.nullif(F.size(refs), F.lit(-1)), F.lit(0)).alias("n_refs"))


_STRICT = f"""(json_type(o) = 'OBJECT' and list_sort(json_keys(o)) = ['action', 'goal_ref', 'lifecycle_evidence', 'title'] and json_type(o, '$.action') = 'VARCHAR' and json_type(o, '$.goal_ref') = 'VARCHAR' and json_type(o, '$.lifecycle_evidence') = 'VARCHAR'
    and json_type(o, '$.title') = 'VARCHAR' and {_OK} and case when action = 'startGoal' then {_trim("json_extract_string(o, '$.title')")} = '' or ({{legacy}} and len(string_split({_collapse("json_extract_string(o, '$.title')")}, ' ')) between 3 and 7) else json_extract_string(o, '$.title') = '' end)"""


@query(f"select id, coalesce({_STRICT.replace('{legacy}', 'false')}, false) strict, coalesce({_STRICT.replace('{legacy}', 'true')}, false) with_title from (select *, case when json_valid(answer) then answer end o from {_DEC})")
def strict_contract(spark, d):
    a = F.col("answer")
    return tables.decisions(spark, d).select("id", pred.strict_decision_ok(a).alias("strict"), pred.strict_decision_ok(a, True).alias("with_title"))


@query(f"select id, array_to_string(list_filter({_REFS}, lambda r: r <> 'NEW_GOAL'), ' ') refs from {_DEC} where json_extract(env, '$.candidates') is not null")
def ref_enum(spark, d):
    """The refs that an answer to each request may name."""
    rows = tables.decisions(spark, d).where("envelope.candidates is not null")
    return rows.select("id", F.array_join(pred.existing_refs(F.col("envelope.candidates")), " ").alias("refs"))


@query("select id, case when len(list_filter(messages, lambda m: m.role = 'user')) = 1 then list_filter(messages, lambda m: m.role = 'user')[1].content end is not null one_user, case when len(list_filter(messages, lambda m: m.role = 'assistant')) = 1 then list_filter(messages, lambda m: m.role = 'assistant')[1].content end is not null one_assistant from training_rows")
def one_message(spark, d):
    t = read_table(spark, d, "training_rows")
    return t.select("id", *[pred.one_message(F.col("messages"), r).isNotNull().alias(f"one_{r}") for r in ("user", "assistant")])


@query(f"""select id, '{{"action":"' || action || '","goal_ref":"' || goal_ref || '","lifecycle_evidence":"' || evidence || '","title":""}}' canonical from {_DEC}""")
def canonical_decision(spark, d):
    t = F.col("target")
    return tables.decisions(spark, d).select("id", F.to_json(F.struct(t["action"].alias("action"), t["goal_ref"].alias("goal_ref"), t["lifecycle_evidence"].alias("lifecycle_evidence"), F.lit("").alias("title"))).alias("canonical"))


@query(f"select id, json_extract_string(env, '$.text') \"text\", json_extract(env, '$.turn_index')::bigint turn_index, json_extract_string(env, '$.local_day') local_day, len(json_extract(env, '$.candidates[*]'))::int n_candidates from {_DEC} where env is not null")
def envelope_fields(spark, d):
    e = F.col("envelope")
    return tables.decisions(spark, d).where(F.get_json_object("content", "$").isNotNull()).select("id", e["text"].alias("text"), e["turn_index"].alias("turn_index"), e["local_day"].alias("local_day"), F.size(e["candidates"]).alias("n_candidates"))


@query("select event_id, json_extract_string(case when json_valid(props) then props end, '$.k') k from events")
def event_json(spark, d):
    return read_table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(f"""select doc_id, sha256({_normal('text')}) digest, len(regexp_extract_all({_normal('text')}, '\\S+'))::int n_words from documents where text is not null""")
def normal_digest(spark, d):
    n = normal_form(F.col("text"))
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(n, 256).alias("digest"), F.when(n == "", F.lit(0)).otherwise(F.size(F.split(n, " "))).alias("n_words"))


@query("select sum(trust * n)::bigint weighted, sum(n)::bigint n from (select lower(trim(split_part(source, ':', 1))) k, count(*) n from session_labels group by 1) join source_trust on k = source_kind")
def trust_totals(spark, d):
    l = read_table(spark, d, "session_labels").groupBy(F.lower(F.trim(F.substring_index("source", ":", 1))).alias("source_kind")).agg(F.count(F.lit(1)).alias("n"))
    return l.join(read_table(spark, d, "source_trust"), "source_kind").agg(F.sum(F.col("trust") * F.col("n")).alias("weighted"), F.sum("n").alias("n"))


# --- learning ---------------------------------------------------------------------------------------------------------
@query()
def lr_holdout_predictions(spark, d):
    """Fit on the training side of the split, predict the held-out sessions."""
    s = cut(splits.stratified_holdout(_usable(spark, d), FRACTION, SEED))
    docs = s.select(F.col("session_id").alias("doc"), "text", F.col("value").alias("label"), "side")
    model = classify.TextClassifier.fit(docs.where("side = 'train'").drop("side"))
    held = docs.where("side = 'holdout'")
    return model.predict(held.select("doc", "text")).join(held.select("doc", "label"), "doc").select(F.col("doc").alias("session_id"), "label", "predicted", F.round("probability", 4).alias("probability"))


@query()
def cv_accuracy(spark, d):
    """Mean accuracy over stratified folds, five at most, of the aspect's usable sessions."""
    docs = _usable(spark, d).select(F.col("session_id").alias("doc"), "text", F.col("value").alias("label"))
    return spark.createDataFrame([(round(classify.cross_validate(cut(docs), SEED), 4),)], "accuracy double")


# --- curriculum, prompts, reports ---------------------------------------------------------------------------------------
_POLISH = f"(len(list_filter(regexp_extract_all(lower({{c}}), '\\p{{{{L}}}}+'), lambda x: x in ({', '.join(repr(w) for w in pred.POLISH_WORDS)}))) >= 2 or regexp_matches(lower({{c}}), '{pred.POLISH_SIGNS}'))"


@query(f"""select pred_id, {_POLISH.format(c='message')} and not {_POLISH.format(c='student')} other_language,
    array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(message, '{pred.IDENTIFIER}')), lambda x: not contains(student, x))), ', ') lost from predictions where message is not null and student is not null""")
def language_violations(spark, d):
    m, s = F.col("message"), F.col("student")
    return read_table(spark, d, "predictions").where("message is not null and student is not null").select("pred_id", (pred.is_polish(m) & ~pred.is_polish(s)).alias("other_language"), F.array_join(pred.lost_identifiers(m, s), ", ").alias("lost"))


_FAMILIES = {"completion": ["{title} is done now", "that finishes {title}"], "switch": ["leave it, start with {title}"], "status": ["how far is {title}", "what about {title}", "still on {title}?"]}
_FAMILY_SQL = "case number // 40 when 0 then 'completion' when 1 then 'switch' else 'status' end"
_TEMPLATE_SQL = "case number // 40 when 0 then ['{title} is done now', 'that finishes {title}'][number % 40 % 2 + 1] when 1 then 'leave it, start with {title}' else ['how far is {title}', 'what about {title}', 'still on {title}?'][number % 40 % 3 + 1] end"


@query(f"""with s as (select id, title, row_number() over (order by sha256('{SEED}:' || id), id) - 1 place from (select id, json_extract_string(env, '$.candidates[0].title') title from {_DEC}) where title is not null), n as (select least(count(*), 120) n from s)
    select number, {_FAMILY_SQL} family, id, replace({_TEMPLATE_SQL}, '{{title}}', title) "text" from (select unnest(range(120)) number) join n on true join s on place = number % n""")
def round_robin(spark, d):
    t = tables.decisions(spark, d).select("id", F.get("envelope.candidates", F.lit(0))["title"].alias("title")).where("title is not null")
    return splits.round_robin(t, _FAMILIES, 40, SEED, "id").select("number", "family", "id", F.replace("template", F.lit("{title}"), F.col("title")).alias("text"))


@query("select pred_id, 'Message: ' || message || chr(10) || 'Label: ' || goal || chr(10) || 'Student: ' || student prompt from predictions where message is not null and goal is not null and student is not null")
def audit_prompts(spark, d):
    from skein.operators.teacher import audit_prompt

    p = read_table(spark, d, "predictions").where("message is not null and goal is not null and student is not null")
    return p.select("pred_id", audit_prompt(F.col("message"), F.col("goal"), F.col("student")).alias("prompt"))


@query(f"select a.id, p.action, p.p_action, p.goal_ref, p.p_ref from {_AUDIT} a join {_PAIR} p using (id) where a.verdict = 'wrong'")
def rejected_report(spark, d):
    wrong = _audit(spark, d).where("verdict = 'wrong'").select("id")
    return wrong.join(_pairs(spark, d), "id").select("id", F.col("target.action").alias("action"), F.col("prediction.action").alias("p_action"), F.col("target.goal_ref").alias("goal_ref"), F.col("prediction.goal_ref").alias("p_ref"))


@query(f"select doc_id, regexp_replace({_trim('text')}, '(?s)^```[a-zA-Z]*\\s*|\\s*```$', '', 'g') body from documents where text is not null")
def fence_strip(spark, d):
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", pred.strip_fence(F.col("text")).alias("body"))


@query("select messages[2].role \"role\", count(*) n from (select messages from training_rows) group by all")
def second_message_roles(spark, d):
    return read_table(spark, d, "training_rows").groupBy(F.get("messages", F.lit(1))["role"].alias("role")).agg(F.count(F.lit(1)).alias("n"))
