"""Mixing sources to target weights by Pareto order sampling.

The size of a text is its number of tokens by a public tokenizer. The mixture has the largest total for which every
source that has texts can give its share with no text taken more than max_repeats times. Each text has an expected
number of copies in proportion to its weight (short texts get less), at most max_repeats; its whole part is allocated
for certain, the rest is an inclusion probability. Texts of a source are ranked by random odds divided by inclusion odds
and taken in that order until the tokens still missing are reached; ranks come from sums over stretches of the order,
so no task sorts a source.

Weights are a choice beyond the method, made by the parameter full_weight: a text of fewer tokens gets proportionally
less; with 1 all texts of a source have equal chances.

Defined cases: exact copies of a text count as one, kept under the smallest doc_id with a source in the targets; null
and empty texts, null ids and sources without target are left out; a source with a target and no text is reported with
share 0 and the others keep their proportions; null or negative targets count as 0, null or lower max_repeats as 1;
repeated rows of a target count once (the largest); an empty table gives an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.bpe import VOCABULARY, count_tokens
from skein.runtime import cut, prefix_sums

SEED = 20260808
#: Tokens from which a text has the full weight; there are that many different weights.
FULL_WEIGHT = 64
#: Stretches of a source's order.
STRETCHES = 4096


def targets(mix_targets: DataFrame) -> DataFrame:
    return mix_targets.where("source is not null").groupBy("source").agg(
        F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("max_repeats")
    )


def sized_texts(documents: DataFrame, mix_targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens of each distinct text of a source with a target."""
    # the targets name sources and don't grow with the documents
    d = documents.where("doc_id is not null and text is not null and text != ''").join(F.broadcast(targets(mix_targets).where("target_share > 0").select("source")), "source")
    sized = d.select(F.sha2("text", 256).alias("h"), "doc_id", "source", count_tokens(F.col("text"), path).alias("tokens"))
    one = sized.groupBy("h").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("d"))
    return one.select("d.doc_id", "d.source", "d.tokens").where("tokens > 0")


def _scale(weights: list[tuple[float, int]], need: float, cap: int) -> float:
    """c with sum(tokens * min(cap, c * weight)) = need."""
    low, high = 0.0, cap / min(w for w, _ in weights)
    for _ in range(100):
        mid = (low + high) / 2
        if sum(t * min(cap, mid * w) for w, t in weights) < need:
            low = mid
        else:
            high = mid
    return high


def plan(texts: DataFrame, mix_targets: DataFrame, full_weight: int = FULL_WEIGHT) -> list[dict]:
    """Per source: need (tokens) and scale of the expected copies; driver-side over at most full_weight sums a source."""
    goal = {r["source"]: r for r in targets(mix_targets).where("target_share > 0").collect()}
    sums: dict[str, list[tuple[float, int]]] = {}
    for r in texts.groupBy("source", F.least("tokens", F.lit(full_weight)).alias("w")).agg(F.sum("tokens").alias("t")).collect():
        sums.setdefault(r["source"], []).append((r["w"] / full_weight, r["t"]))
    sums = {s: w for s, w in sums.items() if s in goal}
    have = {s: sum(t for _, t in w) for s, w in sums.items()}
    total = min((have[s] * goal[s]["max_repeats"] / goal[s]["target_share"] for s in have), default=0.0)
    out = []
    for s, w in sorted(sums.items()):
        need = total * goal[s]["target_share"]
        out.append({"source": s, "need": need, "cap": int(goal[s]["max_repeats"]), "scale": _scale(w, need, int(goal[s]["max_repeats"]))})
    return out


def _usual_odds(p: dict) -> float:
    """Inclusion odds of a source's texts of full weight."""
    chance = min(1 - 1e-9, max(1e-9, min(p["cap"], p["scale"]) % 1))
    return chance / (1 - chance)


def mix(texts: DataFrame, mix_targets: DataFrame, seed: int = SEED, full_weight: int = FULL_WEIGHT) -> DataFrame:
    """doc_id, source, tokens, copies of the texts taken."""
    spark = texts.sparkSession
    p = spark.createDataFrame([(r["source"], r["need"], r["cap"], r["scale"], _usual_odds(r)) for r in plan(texts, mix_targets, full_weight)], "source string, need double, cap long, scale double, usual double")
    weight = F.least("tokens", F.lit(full_weight)) / full_weight
    t = texts.join(F.broadcast(p), "source").withColumn("expected", F.least(F.col("cap").cast("double"), F.col("scale") * weight))
    t = t.withColumn("whole", F.floor(F.col("expected") + F.lit(1e-9))).withColumn("chance", F.greatest(F.lit(0.0), F.col("expected") - F.col("whole")))
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**53 - 1)) + 1) / F.lit(float(2**53))
    odds = (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))
    t = cut(t.withColumn("rank", F.when(F.col("chance") > 1e-12, odds)).select("doc_id", "source", "tokens", "need", "whole", "usual", "rank"))
    rest = t.groupBy("source").agg((F.max("need") - F.sum(F.col("whole") * F.col("tokens"))).alias("rest"))
    drawn = t.where("rank is not null")
    # ranks times the usual odds are the random odds of most texts, so the stretches of a source hold about as many each,
    # whatever its chance
    even = F.col("rank") * F.col("usual")
    drawn = drawn.withColumn("stretch", F.least(F.floor(even / (1 + even) * STRETCHES), F.lit(STRETCHES - 1)))
    ranked = prefix_sums(drawn.select("doc_id", "source", "tokens", "whole", "rank", "stretch"), ["source"], ["rank", "doc_id"], "tokens", "stretch", "before")
    ranked = ranked.join(F.broadcast(rest), "source").withColumn("copies", F.col("whole") + (F.col("before") + F.col("tokens") / 2 <= F.col("rest")).cast("long"))
    sure = t.where("rank is null").withColumn("copies", F.col("whole"))
    cols = ["doc_id", "source", "tokens", "copies"]
    return ranked.select(*cols).unionByName(sure.select(*cols)).where("copies > 0")


def shares(mixture: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, texts, most_copies, tokens, actual_share for every source with a target."""
    got = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    total = got.agg(F.sum("tokens").alias("_all"))
    r = targets(mix_targets).join(got, "source", "left").join(F.broadcast(total), F.lit(True))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return r.select("source", "target_share", "max_repeats", z("texts").alias("texts"), z("most_copies").alias("most_copies"), z("tokens").alias("tokens"),
                    F.round(F.coalesce(z("tokens") / F.col("_all"), F.lit(0.0)), 6).alias("actual_share"))
