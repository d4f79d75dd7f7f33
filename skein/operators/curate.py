"""Corpus curation: first occurrences, priority unions, caps, budgets, conflicts, proposal merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import normal_form


def digest(c: Column) -> Column:
    """SHA-256 of a text's normal form (case and blanks)."""
    return F.sha2(normal_form(c), 256)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key by `order`, by a combining aggregate: keys with many rows cost no sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in [*order, *rest]])


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Up to n rows per key by order; the limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def priority_union(first: DataFrame, second: DataFrame, order: list[str], exempt: Column) -> DataFrame:
    """Rows of both without repeats by digest; rows of `first` win, `exempt` rows are all kept and hide nothing."""
    both = first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1))).withColumn("exempt", F.coalesce(exempt, F.lit(False)))
    kept = first_by(both.where("not exempt"), ["digest"], ["part", *order])
    return kept.unionByName(both.where("exempt"))


def holdout_budget(df: DataFrame, order: list[str], budget: int = 32) -> DataFrame:
    """First `budget` rows with and without goal that aren't gold become gold; rows without goal beyond it are dropped."""
    task = F.col("goal").isNotNull()
    open_rows = df.where(~F.coalesce("gold", F.lit(False))).withColumn("_task", task)
    picked = open_rows.where("_task").orderBy(*order).limit(budget).unionByName(open_rows.where("not _task").orderBy(*order).limit(budget)).withColumn("_picked", F.lit(True))
    ids = [*order]
    marked = df.join(F.broadcast(picked.select(*ids, "_picked")), ids, "left")  # at most twice the budget
    out = marked.withColumn("gold", F.coalesce(F.col("gold"), F.lit(False)) | F.coalesce("_picked", F.lit(False))).drop("_picked")
    return out.where(task | F.col("gold"))


def capped_export(df: DataFrame, keys: list[str], limit: int, per_key: int) -> DataFrame:
    """Hash-ordered sample: repeats by digest go first, then at most per_key rows of a key, then the limit."""
    ties = [c for c in ("goal_id",) if c in df.columns]
    once = first_by(df, ["digest"], ["hash_key", *ties])
    return first_n(once, keys, ["hash_key"], per_key).drop("rank").orderBy("hash_key").limit(limit)


def conflicts(df: DataFrame, ident: str, payload: list[str]) -> DataFrame:
    """ident, versions of ids that carry different rows."""
    h = F.sha2(F.to_json(F.struct(*payload)), 256)
    return df.groupBy(ident).agg(F.count_distinct(h).alias("versions")).where("versions > 1")


def overlap(a: DataFrame, b: DataFrame, ident: str) -> DataFrame:
    return a.select(ident).intersect(b.select(ident))


def not_known(df: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """Rows whose text, apart from case and blanks, isn't among the known ones."""
    d = df.withColumn("_d", digest(F.col(text)))
    return d.join(known.select(digest(F.col(text)).alias("_d")).distinct(), "_d", "left_anti").drop("_d")


def accepted(df: DataFrame, intended: str, reviewed: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose review agrees, `intended->reviewed` with counts of the others)."""
    agree = F.col(intended).eqNullSafe(F.col(reviewed))
    moved = df.where(~agree).groupBy(F.concat_ws("->", F.coalesce(intended, F.lit("none")), F.coalesce(reviewed, F.lit("none"))).alias("transition")).agg(F.count(F.lit(1)).alias("n"))
    return df.where(agree), moved


def merge_proposals(df: DataFrame, most_values: int = 8, top: int = 8, most_evidence: int = 12) -> DataFrame:
    """name, support, vals (first ones, in order, without repeats) of proposals (name, ord, value), best supported first;
    where proposals carry evidence or a description, also evidence (likewise) and the first description that isn't blank.

    Each value's first place is found before values of a name are gathered, and only its first ones are.
    """

    def firsts(column: str, most: int, out: str) -> DataFrame:
        few = first_n(df.where(F.col(column).isNotNull()).groupBy("name", column).agg(F.min("ord").alias("ord")), ["name"], ["ord", column], most)
        return few.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rank", column))).alias("v")).select("name", F.transform("v", lambda x: x[column]).alias(out))

    out = df.groupBy("name").agg(F.count(F.lit(1)).alias("support")).join(firsts("value", most_values, "vals"), "name", "left")
    if "evidence" in df.columns:
        out = out.join(firsts("evidence", most_evidence, "evidence"), "name", "left")
    if "description" in df.columns:
        out = out.join(df.where(F.trim("description") != "").groupBy("name").agg(F.min_by("description", "ord").alias("description")), "name", "left")
    return out.orderBy(F.desc("support"), "name").limit(top)


def with_literals(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """df and rows written by hand, in its columns."""
    return df.unionByName(df.sparkSession.createDataFrame(rows, df.schema))


def best_candidate(candidates: Column) -> Column:
    """The candidate with the highest score (null counts as 0), the first of equals: among those of the same session if
    there are any, never the one for a new goal."""
    old = F.filter(candidates, lambda c: ~F.coalesce(c["ref"] == "NEW_GOAL", F.lit(False)))
    same = F.filter(old, lambda c: F.coalesce(c["same_session"], F.lit(False)))
    pool = F.when(F.size(same) > 0, same).otherwise(old)
    score = lambda c: F.coalesce(c["score"], F.lit(0.0))
    most = F.array_max(F.transform(pool, score))
    return F.get(F.filter(pool, lambda c: score(c) == most), F.lit(0))


def verdict_join(predictions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """problem, n: ids without verdict, verdicts without prediction, repeated verdicts; all must be none."""
    v = verdicts.groupBy("id").agg(F.count(F.lit(1)).alias("_v"))
    j = predictions.select("id").distinct().withColumn("_p", F.lit(True)).join(v, "id", "full_outer")
    problem = F.when(F.col("_v").isNull(), F.lit("missing")).when(F.col("_p").isNull(), F.lit("unknown")).when(F.col("_v") > 1, F.lit("duplicate"))
    return j.select(problem.alias("problem")).where("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
