"""TF-IDF in long form (doc, term, weight): no vocabulary limit, no Python, no driver-side loop."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.functions.numbers import smooth_idf, sublinear_tf
from skein.functions.text import tokens
from skein.runtime import HOT_SHARE, cut, ensure_checkpoint_dir, prefix_sums, skew_lookup


def ngrams(words: Column, most: int = 2) -> Column:
    """All n-grams of 1..most words joined by a space, in one array."""
    n = F.size(words)
    parts = [words]
    for k in range(2, most + 1):
        parts.append(F.when(n >= k, _windows(words, n, k)).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def _windows(words: Column, n: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))


def term_counts(docs: DataFrame, most: int = 2) -> DataFrame:
    """doc, term, n of docs (doc, text)."""
    words = docs.select("doc", tokens(F.col("text")).alias("w"))
    return words.select("doc", F.explode(ngrams(F.col("w"), most)).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def inverse_frequency(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """term, df, idf; docs counts all documents, also those without any term."""
    total = docs.agg(F.count(F.lit(1)).alias("_n"))  # one row
    return document_frequency(counts).join(F.broadcast(total), F.lit(True)).select("term", "df", smooth_idf(F.col("_n"), F.col("df")).alias("idf"))


def weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """doc, term, weight with unit length per document; terms outside the vocabulary are dropped before that.

    A term can stand in every document: rows of terms that make up a large share of all meet a broadcast of the few.
    """
    total = idf.agg(F.sum("df").alias("_all"))  # one row
    hot = idf.join(F.broadcast(total), F.col("df") * HOT_SHARE >= F.col("_all")).select("term")  # at most HOT_SHARE by counting
    raw = skew_lookup(counts, idf.select("term", "idf"), "term", hot, "inner").select("doc", "term", (sublinear_tf(F.col("n")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("w") / norm).alias("weight"))


def fit_transform(docs: DataFrame, most: int = 2) -> DataFrame:
    counts = cut(term_counts(docs, most))  # texts are split once
    return weights(counts, cut(inverse_frequency(counts, docs)))


def transform(fitted: DataFrame, docs: DataFrame, most: int = 2) -> DataFrame:
    """Weights of docs by the vocabulary and frequencies of `fitted` (doc, text)."""
    return weights(term_counts(docs, most), cut(inverse_frequency(term_counts(fitted, most), fitted)))


def vectors(weighted: DataFrame, vocabulary: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """doc, features (sparse vector) by a dense index of the vocabulary (term, index); docs without terms get a zero vector.

    The parts of the vectors are written as columns and read back as vectors, so that no row passes through Python.
    """
    from pyspark.ml.linalg import VectorUDT

    size = vocabulary.count()
    pairs = weighted.join(vocabulary, "term").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("index").cast("int").alias("i"), F.col("weight").alias("v")))).alias("p"))
    if docs is not None:
        pairs = docs.join(pairs, "doc", "left")
    spark = weighted.sparkSession
    part = lambda k, kind: F.coalesce(F.transform("p", lambda x: x[k]), F.array().cast(f"array<{kind}>")).alias({"i": "indices", "v": "values"}[k])
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    pairs.select("doc", F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), part("i", "int"), part("v", "double")).alias("features")).write.parquet(folder)
    return spark.read.schema(T.StructType([pairs.schema["doc"], T.StructField("features", VectorUDT())])).parquet(folder)


def vocabulary(counts: DataFrame) -> DataFrame:
    """term, index in lexicographic order, from 0; positions by ranges of terms, not by one sorting task."""
    terms = counts.select("term").distinct().withColumn("_g", F.lit(0)).withColumn("_one", F.lit(1)).withColumn("_b", F.conv(F.rpad(F.substring(F.hex(F.encode(F.substring("term", 1, 3), "utf-8")), 1, 6), 6, "0"), 16, 10).cast("long"))
    return prefix_sums(terms, ["_g"], ["term"], "_one", "_b", "index").select("term", "index")
