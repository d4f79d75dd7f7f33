"""Multinomial logistic regression over TF-IDF vectors, stratified cross-validation, prediction, artifacts."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.numbers import sublinear_tf
from skein.operators import features
from skein.operators.logistic import Corpus
from skein.operators.splits import folds
from skein.runtime import HOT_SHARE, cut, skew_lookup
from skein.sources import files

MAX_ITER, TOL = 100, 1e-6


class TextClassifier:
    """Classes in sorted order; the first maximum wins ties. terms: term, df, idf, w (a coefficient for each class)."""

    def __init__(self, terms: DataFrame, classes: list[str], intercepts: list[float]):
        self.terms, self.classes, self.intercepts = terms, classes, intercepts

    @classmethod
    def fit(cls, docs: DataFrame, max_iter: int = MAX_ITER) -> TextClassifier:
        """docs: doc, text, label. The L2 penalty is one half of the squared weights against the summed loss."""
        corpus = Corpus(docs.select("text", "label", F.lit(-1).alias("fold")), keep_terms=True)
        run = corpus.fit([0], max_iter, TOL)[0]
        return cls(corpus.coefficients(run), corpus.classes, [float(x) for x in run.b])

    def predict(self, docs: DataFrame) -> DataFrame:
        """doc, predicted, probability of docs (doc, text); documents without known terms get the class of the intercepts."""
        total = self.terms.agg(F.sum("df").alias("_all"))  # one row
        hot = self.terms.join(F.broadcast(total), F.col("df") * HOT_SHARE >= F.col("_all")).select("term")  # at most HOT_SHARE by counting
        x = sublinear_tf(F.col("n")) * F.col("idf")
        known = skew_lookup(features.term_counts(docs), self.terms.select("term", "idf", "w"), "term", hot, "inner").select("doc", x.alias("x"), "w")
        sums = known.groupBy("doc").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_norm"), *[F.sum(F.col("x") * F.col("w")[k]).alias(f"_m{k}") for k in range(len(self.classes))])
        m = F.array(*[F.coalesce(F.col(f"_m{k}") / F.col("_norm"), F.lit(0.0)) + F.lit(b) for k, b in enumerate(self.intercepts)])
        both = docs.select("doc").distinct().join(sums, "doc", "left").select("doc", m.alias("m"))
        e = both.withColumn("e", F.transform("m", lambda v: F.exp(v - F.array_max("m"))))
        p = e.select("doc", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"))
        label = F.array(*[F.lit(c) for c in self.classes])
        return p.select("doc", F.element_at(label, F.array_position("p", F.array_max("p")).cast("int")).alias("predicted"), F.array_max("p").alias("probability"))

    def save(self, folder: str, metrics: dict) -> None:
        """Model first, then the metrics, so that metrics never name a model that isn't there. Any file system will do."""
        self.terms.write.mode("overwrite").parquet(f"{folder}/model")
        files.write_text(self.terms.sparkSession, f"{folder}/metrics.json", json.dumps(metrics | {"classes": self.classes, "intercepts": self.intercepts}, sort_keys=True))

    @classmethod
    def load(cls, spark, folder: str) -> TextClassifier:
        metrics = json.loads(files.read_text(spark, f"{folder}/metrics.json"))
        classes, intercepts = metrics["classes"], metrics.get("intercepts", [])
        terms = spark.read.schema("term string, df long, idf double, w array<double>").parquet(f"{folder}/model")
        if len(classes) != len(intercepts) or terms.where(F.col("w").isNull() | (F.size("w") != len(classes))).take(1):
            raise ValueError("the artifact's model, classes and intercepts don't fit together")
        return cls(terms, classes, intercepts)


def cross_validate(docs: DataFrame, seed: int, most: int = 5, max_iter: int = MAX_ITER) -> float:
    """Mean accuracy over stratified folds, the vocabulary fitted anew in each; 0.0 where no fold can be scored."""
    counts = {r["label"]: r["count"] for r in docs.groupBy("label").count().collect()}
    if sum(counts.values()) < 10 or min(counts.values(), default=0) < 2:
        return 0.0
    k = min(most, min(counts.values()))
    corpus = Corpus(folds(docs, seed, k, "label", "doc"), k)
    scored = [f for f in range(k) if (corpus.fold_of == f).any() and len(set(corpus.y[corpus.fold_of != f])) > 1]
    runs = corpus.fit(scored, max_iter, TOL)
    scores = []
    for f, run in runs.items():
        test = corpus.fold_of == f
        scores.append(float(np.mean(run.margins()[:, test].argmax(axis=0) == corpus.y[test])))
    return sum(scores) / len(scores) if scores else 0.0
