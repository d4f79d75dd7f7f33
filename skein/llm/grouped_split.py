"""Splits that keep related records together: grouped iterative stratification.

Sessions and authors form a graph; its connected components are the groups. They are found by contraction: in each round
every node hooks onto the smallest smaller neighbour, one pointer jump follows, and the edges move to the new nodes, so
the edge table shrinks until none is left. The rounds are tables in the checkpoint folder; nothing is collected.

Groups carry a vector of rows per runtime. Labels are handled by rarity, the rarest outstanding label first: the groups
that hold it, largest first, fill the splits that still need most of it. Groups larger than 1/HOT_SHARE of the rows, of
which there are fewer than HOT_SHARE, come first and one by one; a label's other groups are placed at once by running
sums (two-level, so no task sorts them all).

Defined cases: rows of training_rows without readable session go with their author's other rows, and without author form a
group of their own row; authors null,
empty or `unknown` don't link; author handles are compared without case, blanks and a leading @; a session without any
row in training_rows is placed by itself when labels follow their session; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import RUNTIMES, bare_session_id, trim_ws
from skein.runtime import HOT_SHARE, cut, prefix_sums, skew_lookup

SPLITS = ("train", "validation", "test")
SHARES = (0.8, 0.1, 0.1)
#: Label of rows whose runtime is missing or none of the known ones.
OTHER = "other"
LABELS = (*RUNTIMES, OTHER)
_MAX_ROUNDS = 60
#: Stretches of the hash within one power of two of group sizes, for running sums.
_BUCKET_BITS = 12
_BUCKETS = 1 << _BUCKET_BITS


def author_key(c: Column) -> Column:
    a = F.regexp_replace(trim_ws(F.lower(c)), r"^@+\s*", "")
    return F.when(a.isin("", "unknown"), F.lit(None)).otherwise(a)


def members(training: DataFrame) -> DataFrame:
    """id, session, author, runtime of each row."""
    meta = F.from_json("metadata", "session_id string, runtime string, author string")
    r = training.select("id", meta.alias("m"))
    runtime = F.lower(trim_ws(F.col("m.runtime")))
    return r.select(
        "id", bare_session_id(F.col("m.session_id")).alias("session"), author_key(F.col("m.author")).alias("author"),
        F.when(runtime.isin(*RUNTIMES), runtime).otherwise(F.lit(OTHER)).alias("runtime"),
    )


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (a, b strings), root the smallest node of its component."""
    e = cut(edges.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = cut(e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("root", F.col("node")))
    for _ in range(_MAX_ROUNDS):
        total = e.count()
        if not total:
            return roots
        up = e.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("p"))
        jump = up.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        up = cut(up.join(jump, "p", "left").select("x", F.coalesce("pp", "p").alias("p")))  # p of a hooked node is never itself
        # only `a` can be hot: each b is hooked and its edges are spread over the hash of (a, b)
        heavy = e.groupBy("a").count().where(F.col("count") * HOT_SHARE >= F.lit(total)).select(F.col("a").alias("x"))
        left = skew_lookup(e.withColumnRenamed("a", "x"), up, "x", heavy).select(F.coalesce("p", "x").alias("a"), "b")
        both = left.join(up.withColumnRenamed("x", "b").withColumnRenamed("p", "q"), "b").select("a", F.col("q").alias("c"))
        nxt = both.where("a != c").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
        big = roots.groupBy("root").count().where(F.col("count") * HOT_SHARE >= F.lit(roots.count())).select(F.col("root").alias("x"))
        moved = skew_lookup(roots.withColumnRenamed("root", "x"), up, "x", big).select("node", F.coalesce("p", "x").alias("root"))
        e, roots = cut(nxt), cut(moved)
    raise RuntimeError("components: the graph did not contract")


def session_groups(m: DataFrame) -> DataFrame:
    """session, root for each session that shares an author with another one, directly or through others."""
    pairs = m.where("session is not null and author is not null").select("session", "author").distinct()
    head = pairs.groupBy("author").agg(F.min("session").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hot = pairs.groupBy("author").count().where(F.col("count") * HOT_SHARE >= F.lit(pairs.count())).select("author")
    edges = skew_lookup(pairs, head, "author", hot, "inner").select("a", F.col("session").alias("b"))
    return components(edges).select(F.col("node").alias("session"), "root")


def found(training: DataFrame) -> DataFrame:
    g = session_groups(members(training))
    return g.where("session != root").select(F.col("root").alias("session_a"), F.col("session").alias("session_b"))


def _sums(groups: DataFrame) -> dict[str, int]:
    return groups.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in LABELS]).first().asDict()


def place(groups: DataFrame, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """group, split for groups (group string, one column of counts per label)."""
    spark = groups.sparkSession
    g = cut(groups.withColumn("size", sum((F.col(x) for x in LABELS), F.lit(0))))
    totals = g.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in LABELS], F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    need = {s: {x: totals[x] * p for x in LABELS} for s, p in zip(SPLITS, shares, strict=True)}
    parts: list[DataFrame] = []
    # one rule for all groups; those of a size that only few can have go first and one by one, so that the many small ones
    # can even out what they leave
    large = sorted(g.where(F.col("size") * HOT_SHARE > F.lit(totals["size"])).collect(), key=lambda r: (-r["size"], r["group"]))  # fewer than HOT_SHARE rows
    chosen = []
    rest = g.where(F.col("size") * HOT_SHARE <= F.lit(totals["size"]))
    sums = _sums(rest)
    while large:
        held = {x: sums[x] + sum(r[x] for r in large) for x in LABELS if any(r[x] for r in large)}
        rare = min(held, key=lambda x: (held[x], x))
        for r in [r for r in large if r[rare]]:
            best = max(SPLITS, key=lambda s: (need[s][rare], sum(need[s].values())))
            for x in LABELS:
                need[best][x] -= r[x]
            chosen.append((r["group"], best))
        large = [r for r in large if not r[rare]]
    parts.append(spark.createDataFrame(chosen, "group string, split string"))
    todo = [x for x in LABELS if sums[x]]
    while todo:
        rare = min(todo, key=lambda x: (sums[x], x))
        here = rest.where(F.col(rare) > 0)
        rest = rest.where(F.col(rare) == 0)
        # largest first, then by hash; the bucket follows that order
        order = here.withColumn("_h", F.xxhash64("group")).withColumn("_all", F.lit(0)).withColumn(
            "_b", F.floor(F.log2("size")) * F.lit(-_BUCKETS) + F.shiftrightunsigned(F.col("_h"), 64 - _BUCKET_BITS)
        )
        summed = prefix_sums(order, ["_all"], ["_h", "group"], rare, "_b", "_before")
        want = {s: max(0.0, need[s][rare]) for s in SPLITS}
        if not sum(want.values()):
            want = dict(zip(SPLITS, shares, strict=True))
        scale = sums[rare] / sum(want.values())
        # each split takes the stretch of the running sum that it needs; the neediest comes last and takes what is over
        ranked = sorted(SPLITS, key=lambda s: want[s])
        split, at = F.lit(ranked[-1]), sum(want[s] for s in ranked[:-1]) * scale
        for s in reversed(ranked[:-1]):
            split = F.when(F.col("_before") + F.col(rare) / 2 < F.lit(at), F.lit(s)).otherwise(split)
            at -= want[s] * scale
        placed = cut(summed.withColumn("split", split).select("group", "split", *LABELS))
        for r in placed.groupBy("split").agg(*[F.sum(x).alias(x) for x in LABELS]).collect():  # three rows
            for x in LABELS:
                need[r["split"]][x] -= r[x]
        parts.append(placed.select("group", "split"))
        sums = _sums(rest)
        todo = [x for x in todo if x != rare and sums[x]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assign(training: DataFrame, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """id, session, runtime, split of each training row."""
    m = cut(members(training).where("id is not null"))
    g = session_groups(m)
    # a row without session joins its author's sessions, or the author's other rows without one
    bare = m.where("session is null and author is not null")
    heads = m.where("session is not null and author is not null").groupBy("author").agg(F.min("session").alias("_head"))
    joined = skew_lookup(bare, heads, "author").withColumn("node", F.coalesce("_head", F.concat(F.lit("author:"), F.col("author")))).drop("_head")
    nodes = cut(m.where("session is not null or author is null").withColumn("node", F.col("session")).unionByName(joined))
    hot = nodes.groupBy("node").count().where(F.col("node").isNotNull() & (F.col("count") * HOT_SHARE >= F.lit(m.count()))).select("node")
    keyed = skew_lookup(nodes, g.withColumnRenamed("session", "node"), "node", hot).withColumn("group", F.coalesce("root", "node", F.concat(F.lit("row:"), F.col("id"))))
    keyed = cut(keyed.select("id", "session", "runtime", "group"))
    vectors = keyed.groupBy("group").agg(*[F.count_if(F.col("runtime") == x).alias(x) for x in LABELS])
    split = place(vectors, shares)
    big = keyed.groupBy("group").count().where(F.col("count") * HOT_SHARE >= F.lit(keyed.count())).select("group")
    return skew_lookup(keyed, split, "group", big, "inner").select("id", "session", "runtime", "split")


def follow(labels: DataFrame, assigned: DataFrame) -> DataFrame:
    """label_id, session, split: rows of session_labels follow their session; others are placed by a hash of the session."""
    l = labels.where("label_id is not null").select("label_id", bare_session_id(F.col("session_id")).alias("session"))
    s = assigned.where("session is not null").groupBy("session").agg(F.min("split").alias("split"))
    u = F.pmod(F.xxhash64(F.coalesce(F.col("session"), F.concat(F.lit("row:"), F.col("label_id").cast("string")))), F.lit(1_000_000)) / 1_000_000
    own = F.when(u < SHARES[0], F.lit(SPLITS[0])).when(u < SHARES[0] + SHARES[1], F.lit(SPLITS[1])).otherwise(F.lit(SPLITS[2]))
    return skew_lookup(l, s, "session").select("label_id", "session", F.coalesce("split", own).alias("split"))


def shares_report(assigned: DataFrame) -> DataFrame:
    """runtime, split, n, share of the runtime's rows."""
    n = assigned.groupBy("runtime", "split").agg(F.count(F.lit(1)).alias("n"))
    t = n.groupBy("runtime").agg(F.sum("n").alias("_t"))
    return n.join(F.broadcast(t), "runtime").select("runtime", "split", "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))
