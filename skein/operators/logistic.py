"""Multinomial logistic regression over TF-IDF rows: coefficients stay with their terms, the driver holds a few numbers a document.

The penalty makes every step of the fit a mixture of documents: w = X'a with one number for each document and class. So L-BFGS
runs on a and on X w = X X'a, which is all that loss, gradient and inner products need. X X'a takes one pass over blocks of
terms a step, none for the line search; the fits of all folds share it. Terms of one document come to a single number for
that document, which is exact: among themselves they never meet.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import tokens
from skein.operators import features
from skein.runtime import cut

#: Words and pairs of words of a block of terms, and bytes of partial sums that the driver adds up itself.
BLOCK, DIRECT = 1_000_000, 64_000_000
#: Steps that L-BFGS remembers, as many as the usual solvers.
MEMORY = 10


def _grouped(batches):
    """Of a partition of (term, i, n) sorted by term: distinct terms, documents, times in the document, documents of each term."""
    import pyarrow as pa
    import pyarrow.compute as pc

    t = pa.Table.from_batches(batches)
    terms = t["term"].combine_chunks()
    starts = np.flatnonzero(np.append(True, pc.not_equal(terms.slice(1), terms.slice(0, len(terms) - 1)).to_numpy(zero_copy_only=False).astype(bool)))
    return terms.take(pa.array(starts)), t["i"].to_numpy(), t["n"].to_numpy(), np.diff(np.append(starts, len(terms)))


def _frequencies(rows, starts, fold_of, folds: int) -> np.ndarray:
    """Documents of each term (folds x terms) outside of each fold."""
    return np.array([np.add.reduceat((fold_of[rows] != f).astype(np.int64), starts) for f in range(folds)])


def _idf(df: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return np.where(df > 0, np.log((1 + docs[:, None]) / (1 + df)) + 1, 0.0)


class Corpus:
    """Documents (text, label, fold); a fit f leaves out the documents of fold f."""

    def __init__(self, docs: DataFrame, folds: int = 1, keep_terms: bool = False):
        self.spark, self.folds = docs.sparkSession, folds
        # places follow the partitions of what is materialised here
        kept = cut(docs.select("text", "label", "fold")).withColumn("_m", F.monotonically_increasing_id())
        t = kept.select("_m", "label", "fold", F.size(tokens(F.col("text"))).alias("words")).toArrow()
        marks = t["_m"].to_numpy()
        at = np.argsort(marks)
        labels = t["label"].to_pylist()
        self.classes = sorted(set(labels))
        place = {c: k for k, c in enumerate(self.classes)}
        self.n, self.y, self.fold_of = len(at), np.array([place[c] for c in labels], np.int32)[at], t["fold"].to_numpy()[at]
        self.docs_of = np.array([(self.fold_of != f).sum() for f in range(folds)], float)
        self.parts = max(1, -(-2 * int(t["words"].to_numpy().clip(0).sum(dtype=np.int64)) // BLOCK))
        before = np.searchsorted(marks[at] >> 33, np.arange(int(marks.max() >> 33) + 1 if len(marks) else 1))
        offset = F.element_at(F.array(*[F.lit(int(x)) for x in before]), F.shiftright("_m", 33).cast("int") + 1)
        i = (offset + F.col("_m").bitwiseAND((1 << 33) - 1)).cast("int")
        # counted where a term's rows meet, so that a word that stands everywhere brings a row a document into its block
        words = kept.select(i.alias("i"), tokens(F.col("text")).alias("w"))
        each = words.select(F.explode(features.ngrams(F.col("w"))).alias("term"), "i").repartition(self.parts, "term")
        entries = each.groupBy("term", "i").agg(F.count(F.lit(1)).cast("int").alias("n"))
        self._build(entries.sortWithinPartitions("term"), keep_terms)

    def _build(self, entries: DataFrame, keep_terms: bool) -> None:
        shared = self.spark.sparkContext.broadcast((self.fold_of, self.docs_of))
        folds = self.folds

        def build(batches) -> Iterator:
            import pickle

            import pyarrow as pa

            batches = [b for b in batches if b.num_rows]
            if not batches:
                return
            fold_of, docs_of = shared.value
            words, rows, n, sizes = _grouped(batches)
            idf = _idf(_frequencies(rows, np.cumsum(sizes) - sizes, fold_of, folds), docs_of)
            one = sizes == 1
            many, kind = np.repeat(~one, sizes), np.min_scalar_type(int(n.max()))
            n = n.astype(kind)
            block = rows[many], n[many], sizes[~one], idf[:, ~one], rows[~many], n[~many]
            kept = None
            if keep_terms:
                words = words.take(pa.array(np.append(np.flatnonzero(~one), np.flatnonzero(one))))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([("term", words.type)]), options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
                    w.write_batch(pa.record_batch([words], ["term"]))
                kept = sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(block, 5)], pa.binary()), "terms": pa.array([kept], pa.binary())})

        self.blocks = cut(entries.mapInArrow(build, "block binary, terms binary"))
        # length of each document by the terms that a fit knows; at the end, by the terms of no other document
        sums = self._sums(None, folds + 1)
        alone = _idf(np.ones((folds, 1)), self.docs_of)[:, 0] ** 2
        self.alone = np.array([sums[folds] * alone[f] * (self.fold_of != f) for f in range(folds)])
        norm = np.sqrt(sums[:folds] + self.alone)
        self.inverse = np.divide(1.0, norm, out=np.zeros_like(norm), where=norm > 0)
        shared.destroy()

    def _sums(self, given: np.ndarray | None, columns: int, fold: list[int] | None = None) -> np.ndarray:
        """columns x documents, added up over all blocks: T idf^2 T'x of each column x, or squared weights if none is given."""
        shared, n, folds = self.spark.sparkContext.broadcast((given, fold)), self.n, self.folds

        def add(batches) -> Iterator:
            import pickle

            import pyarrow as pa

            x, fold = shared.value
            out = np.zeros((columns, n))
            for b in batches:
                for raw in b["block"]:
                    rows, count, sizes, idf, single, times = pickle.loads(raw.as_buffer())
                    tf = 1 + np.log(count.astype(float))
                    if x is None:
                        out[folds] += np.bincount(single, (1 + np.log(times.astype(float))) ** 2, n)
                    if not len(rows):
                        continue
                    starts, idf2 = np.cumsum(sizes) - sizes, idf * idf
                    for c in range(folds if x is None else columns):
                        u = idf2[c] if x is None else np.add.reduceat(tf * x[c][rows], starts) * idf2[fold[c]]
                        out[c] += np.bincount(rows, (tf * tf if x is None else tf) * np.repeat(u, sizes), n)
            yield pa.RecordBatch.from_pydict({"c": pa.array(range(columns), pa.int32()), "part": pa.array([v.tobytes() for v in out], pa.binary())})

        def total(t):
            import pyarrow as pa

            return pa.table({"c": t["c"][:1], "part": pa.array([sum(np.frombuffer(v.as_buffer()) for v in t["part"]).tobytes()], pa.binary())})

        got = self.blocks.select("block").mapInArrow(add, "c int, part binary")
        if self.parts * columns * n * 8 > DIRECT:
            got = got.groupBy("c").applyInArrow(total, "c int, part binary")
        out = np.zeros((columns, n))
        t = got.toArrow()
        for c, part in zip(t["c"].to_pylist(), t["part"]):
            out[c] += np.frombuffer(part.as_buffer())
        shared.destroy()
        return out

    def products(self, each: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """X X'a for the a (classes x documents, its columns summing to 0) of each fit."""
        k = len(self.classes) - 1  # the last class follows from the others
        fold = [f for f in each for _ in range(k)]
        got = self._sums(np.concatenate([a[:k] * self.inverse[f] for f, a in each.items()]), len(fold), fold)
        out = {}
        for j, (f, a) in enumerate(each.items()):
            v = got[j * k : (j + 1) * k] * self.inverse[f] + a[:k] * self.alone[f] * self.inverse[f] ** 2
            out[f] = np.concatenate([v, -v.sum(axis=0, keepdims=True)])
        return out

    def fit(self, fits: list[int], max_iter: int, tol: float) -> dict[int, Descent]:
        with_terms = self.inverse > 0
        runs = {f: Descent(self.y, np.flatnonzero((self.fold_of != f) & with_terms[f]), len(self.classes)) for f in fits}
        active = {f: r for f, r in runs.items() if len(self.classes) > 1 and len(r.train)}
        while active:
            images = self.products({f: r.slope() for f, r in active.items()})
            active = {f: r for f, r in active.items() if r.step(images[f], max_iter, tol)}
        return runs

    def coefficients(self, run: Descent) -> DataFrame:
        """term, df, idf and the coefficient for each class, of a fit over all documents (fold -1)."""
        shared = self.spark.sparkContext.broadcast((run.at[0] * self.inverse[0], _idf(np.ones((1, 1)), self.docs_of)[0, 0]))

        def terms(batches) -> Iterator:
            import pickle

            import pyarrow as pa

            a, alone = shared.value
            for b in batches:
                for raw, words in zip(b["block"], b["terms"]):
                    rows, n, sizes, idf, single, times = pickle.loads(raw.as_buffer())
                    tf, idf = 1 + np.log(n.astype(float)), np.append(idf[0], np.full(len(single), alone))
                    many = [np.add.reduceat(tf * v[rows], np.cumsum(sizes) - sizes) if len(rows) else rows[:0] for v in a]
                    w = np.array([np.append(m, (1 + np.log(times.astype(float))) * v[single]) for m, v in zip(many, a)]) * idf
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(idf) + 1) * len(a), pa.int32()), pa.array(w.T.ravel()))
                    words = pa.ipc.open_stream(words.as_buffer()).read_all()["term"]
                    t = pa.table({"term": words, "df": np.append(sizes, np.ones(len(single), int)), "idf": idf, "w": lists})
                    yield from t.to_batches(max_chunksize=10_000)

        return self.blocks.mapInArrow(terms, "term string, df long, idf double, w array<double>")


class Descent:
    """L-BFGS of one fit. Vectors are kept as a, X X'a and their part for the intercepts; they lie in a file, not in memory."""

    def __init__(self, y: np.ndarray, train: np.ndarray, classes: int):
        self.y, self.train, self.lam = y[train], train, 1.0 / max(1, len(train))
        self.b = np.log1p(np.bincount(self.y, minlength=classes).astype(float))
        self.b -= self.b.mean()
        self.file = tempfile.TemporaryFile()
        #: 0, 1: a and X X'a; 2, 3: of the gradient; 4, 5: of the step; then those of past steps and changes of the gradient
        self.at = np.memmap(self.file, np.float64, "w+", shape=(6 + 4 * MEMORY, classes, len(y))) if len(y) else np.zeros((6, classes, 0))
        self.gb = self.db = np.zeros(classes)
        self.past: list[tuple[int, np.ndarray, np.ndarray, float]] = []
        self.values: list[float] = []
        self.steps = 0

    def _loss(self, z: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss of margins (classes x training documents) and its slope."""
        top = z.max(axis=0)
        p = np.exp(z - top)
        total = p.sum(axis=0)
        each = np.arange(len(self.y))
        value = float((top + np.log(total) - z[self.y, each]).sum()) * self.lam
        p /= total
        p[self.y, each] -= 1
        return value, p * self.lam

    def slope(self) -> np.ndarray:
        value, p = self._loss(self.at[1][:, self.train] + self.b[:, None])
        self.values.append(value + self.lam / 2 * float(np.vdot(self.at[0], self.at[1])))
        self.inner_slope = np.zeros(self.at.shape[1:])
        self.inner_slope[:, self.train] = p
        self.new_gb = p.sum(axis=1)
        return self.inner_slope

    def step(self, image: np.ndarray, max_iter: int, tol: float) -> bool:
        """Takes the image of the slope and makes one step; False if the fit is at its end."""
        at, dot = self.at, lambda a, b: float(np.vdot(a, b))
        ga, gi = self.inner_slope + self.lam * at[0], image + self.lam * at[1]
        del self.inner_slope
        if self.steps:
            k = 6 + 4 * ((self.steps - 1) % MEMORY)
            at[k], at[k + 1], at[k + 2], at[k + 3] = at[4], at[5], ga - at[2], gi - at[3]
            sb, yb = self.db, self.new_gb - self.gb
            sy = dot(at[k], at[k + 3]) + dot(sb, yb)
            self.past = [x for x in self.past if x[0] != k]
            if sy > 0:
                self.past.append((k, sb, yb, sy))
        at[2], at[3], self.gb = ga, gi, self.new_gb
        size = np.sqrt(max(0.0, dot(ga, gi) + dot(self.gb, self.gb)))
        v = self.values
        if self.steps >= max_iter or size <= max(tol * abs(v[-1]), 1e-8) or len(v) > MEMORY and max(v[-MEMORY - 1 :]) - v[-1] <= tol * v[0]:
            return False
        qa, qi, qb, back = -ga, -gi, -self.gb, []
        for k, sb, yb, sy in reversed(self.past):
            r = (dot(at[k], qi) + dot(sb, qb)) / sy
            qa -= r * at[k + 2]
            qi -= r * at[k + 3]
            qb = qb - r * yb
            back.append(r)
        if self.past:
            k, _, yb, sy = self.past[-1]
            scale = sy / (dot(at[k + 2], at[k + 3]) + dot(yb, yb))
            qa, qi, qb = qa * scale, qi * scale, qb * scale
        for (k, sb, yb, sy), r in zip(self.past, reversed(back)):
            r -= (dot(at[k + 2], qi) + dot(yb, qb)) / sy
            qa += r * at[k]
            qi += r * at[k + 1]
            qb = qb + r * sb
        t = self._along(qa, qi, qb, 1.0 if self.past else 1.0 / size)
        if not t:
            return False
        at[4], at[5], self.db = t * qa, t * qi, t * qb
        at[0] += at[4]
        at[1] += at[5]
        self.b = self.b + self.db
        self.steps += 1
        return True

    def _along(self, qa: np.ndarray, qi: np.ndarray, qb: np.ndarray, t: float) -> float:
        """Length of the step: where the slope along it, which only rises, is a tenth of that at 0 or less."""
        z, dz = self.at[1][:, self.train] + self.b[:, None], qi[:, self.train] + qb[:, None]
        wd, dd = float(np.vdot(self.at[0], qi)), float(np.vdot(qa, qi))
        rise = lambda t: float(np.vdot(self._loss(z + t * dz)[1], dz)) + self.lam * (wd + t * dd)
        first = rise(0.0)
        if not first < 0:
            return 0.0
        low, high, at_low, at_high = 0.0, None, first, 0.0
        for _ in range(50):
            s = rise(t)
            if abs(s) <= -0.1 * first:
                return t
            if s < 0:
                low, at_low = t, s
            else:
                high, at_high = t, s
            guess = low + (high - low) * at_low / (at_low - at_high) if high is not None else 0.0
            t = 4 * t if high is None else min(max(guess, low + 0.05 * (high - low)), high - 0.05 * (high - low))
        return t

    def margins(self) -> np.ndarray:
        return self.at[1] + self.b[:, None]
