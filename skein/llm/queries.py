"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm import bpe, grouped_split, merkle, mixing, overlap, pairs, pii, residue, stable_sample, survivors
from skein.runtime import cut, read_table

Query = Callable[[SparkSession, str], DataFrame]


def _t(*names: str):
    """Query from a function of tables."""

    def wrap(fn: Callable[..., DataFrame]) -> Query:
        return lambda spark, sf_dir: fn(*(read_table(spark, sf_dir, n) for n in names))

    return wrap


def _p3_redacted(session_texts: DataFrame, goals: DataFrame, name_parts: DataFrame) -> DataFrame:
    rows = pii.rows_of(session_texts, goals)
    return pii.redacted(rows, pii.fit(rows, name_parts)).where("items > 0")


def _p2_labels(training: DataFrame, labels: DataFrame) -> DataFrame:
    return grouped_split.follow(labels, cut(grouped_split.assign(training)))


def _p5_report(training: DataFrame, days: DataFrame, goals: DataFrame) -> DataFrame:
    return overlap.report(overlap.training_side(training, days), "training_rows").unionByName(overlap.report(overlap.goal_side(goals), "goal_rows"))


def _mix(documents: DataFrame, targets: DataFrame) -> DataFrame:
    return mixing.mix(cut(mixing.sized_texts(documents, targets)), targets)


def _p2_proof(training: DataFrame) -> DataFrame:
    """What must hold of the splits: no session and no author in two of them, and shares near the given ones."""
    m = grouped_split.members(training).where("id is not null").select("id", "session", "author")
    s = cut(grouped_split.assign(training).select("id", "split"))
    j = m.join(s, "id")
    torn = lambda c: j.where(F.col(c).isNotNull()).groupBy(c).agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias(f"torn_{c}s"))
    share = lambda x: F.avg((F.col("split") == x).cast("double"))
    near = [(F.abs(share(x) - p) < 0.02).alias(f"{x}_near") for x, p in zip(grouped_split.SPLITS, grouped_split.SHARES)]
    return torn("session").join(torn("author"), how="cross").join(s.agg(F.count(F.lit(1)).alias("n"), *near), how="cross")  # one row each


def _p9_proof(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """What must hold of the mixture: shares near the targets for sources with texts, no text repeated too often."""
    r = mixing.shares(_mix(documents, targets), targets)
    have = documents.where("doc_id is not null and text != ''").select("source").distinct().withColumn("_have", F.lit(True))
    r = r.join(have, "source", "left").withColumn("_have", F.coalesce("_have", F.lit(False)))
    want = F.col("target_share") / F.sum(F.when(F.col("_have"), F.col("target_share"))).over(Window.partitionBy())  # a row for each target
    return r.select("source", (F.abs(F.when(F.col("_have"), want).otherwise(F.lit(0.0)) - F.col("actual_share")) < 0.02).alias("near"), (F.col("most_copies") <= F.col("max_repeats")).alias("cap_kept"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _t("predictions")(pairs.found),
        "p1_report": _t("predictions")(pairs.report),
        "p2_found": _t("training_rows")(grouped_split.found),
        "p2_splits": _t("training_rows")(lambda t: grouped_split.assign(t).select("id", "split")),
        "p2_labels": _t("training_rows", "session_labels")(_p2_labels),
        "p2_shares": _t("training_rows")(lambda t: grouped_split.shares_report(grouped_split.assign(t))),
        "p2_proof": _t("training_rows")(_p2_proof),
        "p3_found": _t("session_texts", "goal_rows", "name_parts")(pii.found),
        "p3_redacted": _t("session_texts", "goal_rows", "name_parts")(_p3_redacted),
        "p4_found": _t("session_labels", "source_trust")(survivors.found),
        "p4_merged": _t("session_labels", "source_trust")(survivors.merged),
        "p5_found": _t("training_rows", "split_days", "goal_rows")(overlap.found),
        "p5_report": _t("training_rows", "split_days", "goal_rows")(_p5_report),
        "p5_counts": _t("training_rows", "split_days", "goal_rows")(lambda *t: _p5_report(*t).drop("mean_coverage")),
        "p6_found": _t("goal_rows")(merkle.found),
        "p6_collapsed": _t("goal_rows")(merkle.collapsed),
        "p7_found": _t("frozen_splits", "session_labels")(stable_sample.broken_records),
        "p7_sample": _t("session_labels", "frozen_splits")(lambda labels, frozen: stable_sample.sample(labels, stable_sample.job_specs(frozen))),
        "p8_ids": _t("documents")(bpe.corpus_ids),
        "p9_mix": _t("documents", "mix_targets")(_mix),
        "p9_shares": _t("documents", "mix_targets")(lambda d, t: mixing.shares(_mix(d, t), t)),
        "p9_proof": _t("documents", "mix_targets")(_p9_proof),
        "p10_found": _t("documents")(residue.found),
        "p10_kept": _t("documents")(residue.kept),
        "p10_recurring": _t("documents")(residue.recurring),
    }


_BARE = r"nullif(regexp_replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '^(omp|claude|codex|droid|kimi)[^0-9a-z]+', ''), '')"
_INSTANT = r"(case when regexp_matches({c}, '^\d{{4}}-\d\d-\d\d([T ].*)?$') then case when regexp_matches({c}, '(Z|[+-]\d\d:\d\d)$') then epoch_us(try_cast({c} as timestamptz)) else epoch_us(try_cast({c} as timestamp)) end end)"
_WORDS = r"list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'))"
_TEXT = "coalesce(case when json_valid({c}) and json_type({c}) = 'OBJECT' then json_extract_string({c}, '$.text') end, {c})"
_LEAF = r"regexp_replace(lower(upper(nfc_normalize(coalesce({c}, '')))), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"
_AUTHOR = r"nullif(nullif(regexp_replace(regexp_replace(lower({c}), '^\s+|\s+$', '', 'g'), '^@+\s*', ''), ''), 'unknown')"
_DAY = r"regexp_replace(regexp_extract(trim({c}), '^\d{{4}}[-/]?\d\d[-/]?\d\d'), '^(\d{{4}})[-/]?(\d\d)[-/]?(\d\d)$', '\1-\2-\3')"


def _near(rows: str, name: str) -> str:
    """Pairs of an evaluation and a training row of `rows` (id, train, w) that share enough words."""
    return f"""select least(a.id, b.id) id_a, greatest(a.id, b.id) id_b from {rows} a, {rows} b
    where not a.train and b.train and len(a.w) > 0 and len(b.w) > 0 and len(list_intersect(a.w, b.w)) >= 0.7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9"""


_RT = "case when lower(trim({c})) in ('omp', 'claude', 'codex', 'droid', 'kimi') then lower(trim({c})) else 'other' end"


def _counted(table: str, rows: str) -> str:
    """Evaluation rows with words of `rows` (id, split, runtime, train, w), and how many of them overlap a training row."""
    return f"""select '{table}' table_name, split, runtime, count(*) records, count(o.id) overlapping from {rows} left join (select distinct a.id from {rows} a, {rows} b where not a.train and b.train and len(a.w) > 0 and len(b.w) > 0
      and len(list_intersect(a.w, b.w)) >= 0.7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9) o using (id) where not train and len(w) > 0 group by all"""


def oracle_sql() -> dict[str, str]:
    value = "max(case when {c} is not null and regexp_replace({c}, '^\\s+|\\s+$', '', 'g') not in ('', 'None') then row(trust, t, label_id) end)"
    picks = ", ".join(f"coalesce(struct_extract({value.format(c=c)}, 3), -1) {c}_from" for c in ("value", "note", "runtime"))
    form = f"""case when json_valid(message) and json_type(message) = 'OBJECT'
        then 'J' || list_sort(list_transform(json_keys(message), lambda k: k || ':' || {_LEAF.format(c="json_extract_string(message, '$.' || k)")}))::varchar
        else 'P' || {_LEAF.format(c="message")} end"""
    return {
        "p2_found": f"""with recursive m as (
              select distinct {_BARE.format(c="json_extract_string(metadata, '$.session_id')")} s, {_AUTHOR.format(c="json_extract_string(metadata, '$.author')")} a
              from training_rows where json_valid(metadata)),
            e as (select distinct x.s u, y.s v from (select a, min(s) s from m where a is not null and s is not null group by a) x join m y on x.a = y.a where y.s is not null),
            b as (select u, v from e union select v, u from e),
            r(n, c) as (select distinct u, u from b union select b.v, r.c from r join b on b.u = r.n where r.c < b.v)
            select c session_a, n session_b from (select n, min(c) c from r group by n) where c < n""",
        "p4_found": f"""with r as (select {_BARE.format(c="session_id")} session_id, aspect, l.label_id, value, note, runtime, coalesce(t.trust, -1) trust, coalesce({_INSTANT.format(c="ts")}, -4611686018427387904) t
              from session_labels l left join source_trust t on t.source_kind = lower(trim(split_part(l.source, ':', 1))))
            select session_id, aspect, {picks} from r where session_id is not null and aspect is not null group by all having count(distinct label_id) > 1""",
        "p2_proof": "select 0::bigint torn_sessions, 0::bigint torn_authors, count(*) n, true train_near, true validation_near, true test_near from training_rows where id is not null",
        "p4_merged": f"""with r as (select {_BARE.format(c="session_id")} session_id, aspect, l.label_id, value, note, runtime, coalesce(t.trust, -2147483648) trust, coalesce({_INSTANT.format(c="ts")}, -4611686018427387904) t
              from session_labels l left join source_trust t on t.source_kind = lower(trim(split_part(l.source, ':', 1)))),
            g as (select session_id, aspect, count(*) n, max(row(trust, t, label_id)) b, {picks} from r where session_id is not null and aspect is not null and label_id is not null group by all)
            select g.session_id, g.aspect, n, struct_extract(b, 3) best_label, v.value, o.note, u.runtime from g left join session_labels v on v.label_id = value_from left join session_labels o on o.label_id = note_from left join session_labels u on u.label_id = runtime_from""",
        "p6_collapsed": f"""select min(goal_id) goal_id, count(*) copies from (select goal_id, {form} m, {_LEAF.format(c="goal")} g from goal_rows where goal_id is not null and goal_source is distinct from 'contract:no-task-v1') group by m, g""",
        "p9_proof": "select source, true as near, true as cap_kept from mix_targets",
        "p5_found": f"""with t as (select id, split_name = 'train' train, {_WORDS.format(c=_TEXT.format(c="u"))} w from (
                select id, {_DAY.format(c="split_day")} d, list_filter(messages, lambda m: m.role = 'user')[1].content u from training_rows) x join split_days on d = split_days.split_day),
              g as (select goal_id id, not coalesce(gold, false) train, {_WORDS.format(c=_TEXT.format(c="message"))} w from goal_rows where goal_source is distinct from 'contract:no-task-v1')
            select distinct * from ({_near("t", "t")} union all {_near("g", "g")})""",
        "p5_counts": f"""with t as (select id, split_name split, {_RT.format(c="case when json_valid(metadata) then json_extract_string(metadata, '$.runtime') end")} runtime, split_name = 'train' train, {_WORDS.format(c=_TEXT.format(c="u"))} w from (
                select id, metadata, {_DAY.format(c="split_day")} d, list_filter(messages, lambda m: m.role = 'user')[1].content u from training_rows) x join split_days on d = split_days.split_day where id is not null),
              g as (select goal_id id, 'gold' split, {_RT.format(c="runtime")} runtime, not coalesce(gold, false) train, {_WORDS.format(c=_TEXT.format(c="message"))} w from goal_rows where goal_id is not null and goal_source is distinct from 'contract:no-task-v1')
            {_counted("training_rows", "t")} union all {_counted("goal_rows", "g")}""",
        "p6_found": f"""with r as (select goal_id, {form} m, {_LEAF.format(c="goal")} g from goal_rows where goal_source is distinct from 'contract:no-task-v1'),
              f as (select *, min(goal_id) over (partition by m, g) first_id from r)
            select first_id, goal_id copy_id from f where goal_id <> first_id""",
        "p7_found": f"""with f as (select *, lag(session_ids) over (partition by job, seed, fraction order by coalesce({_INSTANT.format(c="created_at")}, -4611686018427387904), frozen_id) prev from frozen_splits),
              p as (select distinct frozen_id, {_BARE.format(c="s")} session_id from (select frozen_id, unnest(prev) s from f)),
              n as (select distinct frozen_id, {_BARE.format(c="s")} session_id from (select frozen_id, unnest(session_ids) s from f))
            select * from p where session_id in (select {_BARE.format(c="session_id")} from session_labels) and not exists (select 1 from n where n.frozen_id = p.frozen_id and n.session_id = p.session_id)""",
    }
