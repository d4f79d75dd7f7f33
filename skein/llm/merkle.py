"""Duplicates hidden by formatting: bottom-up hashing of nested records.

A leaf is normalised to its letters, digits and marks (canonically composed, case folded), so blanks, invisible signs, case
and punctuation don't matter, wherever they stand. An object sorts the digests of its fields, so their order doesn't
matter; arrays keep their order. Records with the same root digest are confirmed by comparing their whole canonical forms,
so a collision of digests can't merge records.

Plain texts are normalised and hashed in the JVM; only texts that look like JSON or hold combining marks are sent to
Python. Each record is hashed once; the forms are made again only for records that share their digest.

Defined cases: null counts as the empty text; a text that looks like JSON but can't be read is plain text; null ids are
left out; a repeated id counts once for each row but is never its own copy; repeated JSON keys are all kept; columns
beyond id, message, goal and goal_source are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import bare_letters
from skein.llm.bitmap import rows_with
from skein.runtime import cut, skew_lookup

_NODE = T.StructType([T.StructField("digest", T.StringType()), T.StructField("form", T.StringType())])
ACKNOWLEDGED = "contract:no-task-v1"
_drop = regex.compile(r"[^\p{L}\p{N}\p{M}]+")


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def leaf(c: Column) -> Column:
    """Canonical form of plain text."""
    return bare_letters(F.coalesce(_composed(F.when(F.regexp_like(c, F.lit(r"\p{M}")), c)), c, F.lit("")))


def _leaf(text: str) -> str:
    return _drop.sub("", unicodedata.normalize("NFC", text).upper().lower())


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


class _Object(list):
    """Fields of a JSON object in their order, repeated keys included."""


def _node(x) -> tuple[str, str]:
    """Digest and canonical form of a parsed JSON value, bottom-up."""
    if isinstance(x, _Object):
        fields = []
        for k, v in x:
            digest, form = _node(v)
            key = _leaf(k)
            fields.append((_sha(f"F{key}\x1f{digest}"), f"{json.dumps(key)}:{form}"))
        fields.sort()
        return _sha("O" + "".join(d for d, _ in fields)), "{" + ",".join(f for _, f in fields) + "}"
    if isinstance(x, list):
        parts = [_node(v) for v in x]
        return _sha("A" + "".join(d for d, _ in parts)), "[" + ",".join(f for _, f in parts) + "]"
    form = json.dumps(_leaf(x)) if isinstance(x, str) else "#" + json.dumps(x)
    return _sha("L" + form), form


@F.pandas_udf(_NODE)
def _json_node(texts: pd.Series) -> pd.DataFrame:
    digests, forms = [], []
    for t in texts:
        d = f = None
        if t is not None:
            try:
                x = json.loads(t, object_pairs_hook=_Object)
                if isinstance(x, list):
                    d, f = _node(x)
            except (ValueError, RecursionError):
                pass
        digests.append(d)
        forms.append(f)
    return pd.DataFrame({"digest": digests, "form": forms})


def canonical(rows: DataFrame, key: str, fields: list[str], keep: list[str] = ()) -> DataFrame:
    """key, digest and form of the record made of `fields`, each of which may hold JSON."""
    df = rows.select(key, *keep, *fields)
    parts = []
    for f in fields:
        looks = F.regexp_like(F.col(f), F.lit(r"^\s*[\[{][\s\S]*[\]}]\s*$"))
        df = df.withColumn(f"_j_{f}", _json_node(F.when(looks, F.col(f))))
        plain = leaf(F.col(f))
        parts.append((F.coalesce(F.col(f"_j_{f}.digest"), F.sha2(F.concat(F.lit("P"), plain), 256)), F.coalesce(F.concat(F.lit("J"), F.col(f"_j_{f}.form")), F.concat(F.lit("P"), plain))))
    return df.select(
        key, *keep, F.sha2(F.concat(F.lit("R"), *[d for d, _ in parts]), 256).alias("digest"), F.concat_ws("\x1f", *[f for _, f in parts]).alias("form")
    )


def _tasks(goals: DataFrame) -> DataFrame:
    return goals.where(F.col("goal_id").isNotNull() & ~F.col("goal_source").eqNullSafe(ACKNOWLEDGED)).select("goal_id", "message", "goal")


def classes(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """first_id, copies, and copy_id for each further record of a class of equal records."""
    digests = cut(canonical(rows, key, fields).select(key, F.unhex("digest").alias("digest")))  # without the texts
    several = cut(digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot = several.where(F.col("n") * 1000 >= F.lit(digests.count())).select("digest")  # at most 1000 by counting
    members = cut(skew_lookup(digests, several.select("digest"), "digest", hot, "inner"))
    # only records that share their digest are read again; equal forms combine before they are shuffled
    nodes = canonical(rows_with(rows, members.select(key).distinct(), key), key, fields).withColumn("digest", F.unhex("digest"))
    forms = cut(nodes.groupBy("digest", "form").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("copies")))
    kinds = forms.groupBy("digest").agg(F.count(F.lit(1)).alias("kinds"), F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))
    single = kinds.where("kinds = 1").drop("kinds")
    same = skew_lookup(members, single, "digest", hot, "inner")
    clash = kinds.where("kinds > 1").select("digest")
    if clash.take(1):  # records that share a digest and differ in their forms: compared by the form itself
        mixed = nodes.join(clash, "digest", "left_semi").join(forms.where("copies > 1"), ["digest", "form"]).drop("form")
        same = same.unionByName(mixed)
    return same.where(F.col(key) != F.col("first_id")).select("first_id", F.col(key).alias("copy_id"), "copies").distinct()


def found(goals: DataFrame) -> DataFrame:
    return classes(_tasks(goals), "goal_id", ["message", "goal"]).select("first_id", "copy_id")


def collapsed(goals: DataFrame) -> DataFrame:
    """One row per class of equal records: goal_id (the smallest) and copies (rows in the class)."""
    nodes = canonical(_tasks(goals), "goal_id", ["message", "goal"])
    return nodes.groupBy("digest", "form").agg(F.min("goal_id").alias("goal_id"), F.count(F.lit(1)).alias("copies")).select("goal_id", "copies")
