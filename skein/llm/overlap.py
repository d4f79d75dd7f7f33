"""Same or near-same records across splits.

Two texts overlap when they share at least SHARE of all their distinct words. Evaluation texts are dealt to shards. Each
shard has one Aho-Corasick automaton over the normalised passages of its evaluation texts: their single words, and runs
of PASSAGE words. It scans the training texts of its shard whole; every match is an interval that covers a word of the
evaluation records which hold it, and the merged intervals give the words of each record that the training text covers.
That coverage and the sizes of both texts decide a pair exactly. The runs give the coverage in passages of the report.

Which shards must scan a training text is settled by an exact filter, so that not every automaton has to read every text:
with all words in one order, rare ones first, two texts that overlap share a word among the first few of each
(prefix_keys). Every such word is a key whatever the length of the text and however many texts hold it; keys with very
many texts are met in blocks. A shard with many training texts is split by them.

A bitmap of fixed size drops training keys that no evaluation text has; when the data outgrow it, it only drops
less. Copies within a task give keys once. While keys meet, a parity sketch prunes: bit j tells whether an odd number of
a text's words fall on j, so the bits in which two texts differ are never more than the words they don't share; this
can't lose a pair.

Defined cases: texts without words overlap nothing; rows without a known day, acknowledgements and null ids are left
out; null gold counts as not gold; repeated ids give one pair; a pair's smaller id comes first; the text is the field
`text` of a JSON object, else the whole message; whole texts are read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import RUNTIMES, trim_ws
from skein.functions.timefn import day_of
from skein.llm.bitmap import BITS, bitmap, in_bitmap, rows_with
from skein.llm.merkle import ACKNOWLEDGED
from skein.runtime import cut, ship, skew_lookup

SHARE = 0.7
#: Sizes of texts fall into classes; each class begins at so many times the one before.
CLASS_STEP = 1.15
#: Words are counted in 2**COUNT_BITS places and in one of COUNT_EVERY texts, for the order of words only.
COUNT_BITS, COUNT_EVERY = 18, 8
#: A key that brings together more pairs than the square of this is joined in blocks of about so many rows a side.
BLOCK = 4096
#: Passages of the automata, in words, beside single words.
PASSAGE = 3
#: Evaluation texts of a shard, and training texts that one task of a shard scans (about).
SHARD, SCANNED = 64, 1024
#: The copies of a text meet its links in parts of about so many.
COPIES = 4096
_WORD = re.compile(r"[^\W_]+")


def text_of(content: Column) -> Column:
    return F.coalesce(F.when(content.rlike(r"^\s*\{"), F.get_json_object(content, "$.text")), content)


def training_side(training: DataFrame, split_days: DataFrame) -> DataFrame:
    """id, split, runtime, text of training_rows with a known day."""
    days = split_days.groupBy(day_of(F.col("split_day")).alias("day")).agg(F.min("split_name").alias("split"))
    user = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    rt = F.lower(trim_ws(F.get_json_object("metadata", "$.runtime")))
    r = training.where("id is not null").select("id", day_of(F.col("split_day")).alias("day"), rt.alias("runtime"), text_of(user).alias("text"))
    # the calendar of splits has a row for each day and doesn't grow with the data
    return r.join(F.broadcast(days), "day").select("id", "split", "runtime", "text")


def goal_side(goals: DataFrame) -> DataFrame:
    """id, split (gold or train), runtime, text of goal_rows without acknowledgements."""
    g = goals.where(F.col("goal_id").isNotNull() & ~F.col("goal_source").eqNullSafe(ACKNOWLEDGED))
    split = F.when(F.coalesce("gold", F.lit(False)), F.lit("gold")).otherwise(F.lit("train"))
    return g.select(F.col("goal_id").alias("id"), split.alias("split"), F.lower(trim_ws(F.col("runtime"))).alias("runtime"), text_of(F.col("message")).alias("text"))


def words_of(text: str) -> list[str]:
    """All runs of letters and digits, case ignored."""
    return _WORD.findall(text.lower())


def _word_hash(w: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(w)


def _classes() -> np.ndarray:
    out = [1]
    while out[-1] < 2**40:
        out.append(max(out[-1] + 1, int(out[-1] * CLASS_STEP)))
    return np.array(out, np.int64)


#: Smallest size of each class.
CLASSES = _classes()


def _flat(texts: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and the number of words of each text."""
    flat: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    get = known.get
    for i, t in enumerate(texts):
        w = _WORD.findall(t.lower()) if t else ()
        sizes[i] = len(w)
        for x in w:
            h = get(x)
            if h is None:
                if len(known) > 300_000:
                    known.clear()
                known[x] = h = _word_hash(x)
            flat.append(h)
    return np.array(flat, np.uint64), sizes


def _place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def prefix_keys(h: np.ndarray, doc: np.ndarray, n: np.ndarray, counts: np.ndarray, train: bool) -> tuple[np.ndarray, np.ndarray]:
    """(doc, key): keys of the distinct words h of the texts doc, which have n words; none that a pair needs is left out.

    Two texts of n and m words that overlap share at least SHARE / (1 + SHARE) x (n + m) words, so in any common order of
    words one of the first n - that + 1 words of the one is among the first m - that + 1 of the other. A key is a word
    with the size classes of both sides, so that a text has for each class it can overlap as few words as that allows.
    """
    o = np.lexsort((h, counts[_place(h)], doc))
    h, doc = h[o], doc[o]
    rank = np.arange(len(h)) - np.concatenate([[0], np.cumsum(n)[:-1]])[doc]
    own = np.searchsorted(CLASSES, n, side="right") - 1
    least, most = np.ceil(n * SHARE - 1e-9).astype(np.int64), np.floor(n / SHARE + 1e-9).astype(np.int64)
    low, high = (np.searchsorted(CLASSES, x, side="right") - 1 for x in (least, most))
    where, keys = [], []
    for d in range(int((low - own).min()), int((high - own).max()) + 1):
        other = own + d
        m = np.maximum(CLASSES[np.maximum(other, 0)], least)
        first = np.where((other >= low) & (other <= high), n - np.ceil((n + m) * (SHARE / (1 + SHARE)) - 1e-9).astype(np.int64) + 1, 0)
        use = rank < first[doc]
        e, t = (other, own) if train else (own, other)
        with np.errstate(over="ignore"):
            keys.append(_mix(h[use] + (e * 1024 + t + 1)[doc[use]].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        where.append(doc[use])
    return np.concatenate(where), np.concatenate(keys)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def signatures(texts: list[str], known: dict[str, int], held: np.ndarray | None, met: set[tuple[int, int]], counts: np.ndarray) -> dict[str, np.ndarray | tuple]:
    """For each text with words: its place, r1, r2 (hashes of its word sequence), n (distinct words), two sketches, keys
    (all in a row, with where each text's begin).

    held: bitmap of the evaluation keys, for training texts; keys it doesn't hold are dropped. Texts met before have none.
    """
    h, sizes = _flat(texts, known)
    full = np.flatnonzero(sizes)
    if not len(full):
        none = np.zeros(0, np.int64)
        return {k: none for k in ("at", "r1", "r2", "n", "sketch", "sketch2")} | {"keys": (np.zeros(1, np.int64), none)}
    sizes = sizes[full]
    doc = np.repeat(np.arange(len(full)), sizes)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = (np.arange(len(h)) - start[doc]).astype(np.uint64)
    one, low = np.uint64(1), np.uint64(63)
    with np.errstate(over="ignore"):
        r1, r2 = (np.add.reduceat(_mix(h + place * np.uint64(k)), start).astype(np.int64) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
        order = np.lexsort((h, doc))
        hs, ds = h[order], doc[order]
        first = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])])
        hs, ds = hs[first], ds[first]
        begins = np.searchsorted(ds, np.arange(len(full)))
        n = np.diff(np.concatenate([begins, [len(ds)]]))
        half = (hs >> np.uint64(14)) & one
        bit = one << ((hs >> np.uint64(7)) & low)
        sketches = [np.bitwise_xor.reduceat(np.where(half == np.uint64(k), bit, np.uint64(0)), begins).astype(np.int64) for k in (0, 1)]
        fresh = np.zeros(len(full), bool)
        for i, r in enumerate(zip(r1.tolist(), r2.tolist())):
            if r not in met:
                fresh[i] = True
                if len(met) < 500_000:
                    met.add(r)
        where, key = prefix_keys(hs, ds, n, counts, held is not None)
    key = key.astype(np.int64)
    use = fresh[where] if held is None else fresh[where] & _held(held, key)
    where, key = where[use], key[use]
    o = np.lexsort((key, where))
    where, key = where[o], key[o]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (where[1:] != where[:-1])
    where, key = where[once], key[once]
    cuts = np.searchsorted(where, np.arange(len(full) + 1))
    return {"at": full, "r1": r1, "r2": r2, "n": n, "sketch": sketches[0], "sketch2": sketches[1], "keys": (cuts, key)}


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - BITS)


def _held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return in_bitmap(bits, _slot(keys))


def _counts(rows: DataFrame) -> np.ndarray:
    """How many of the counted texts hold the words of each of 2**COUNT_BITS places.

    Any order of words finds all pairs as long as it is the same for all texts; the counts decide the cost, not the result.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, out = {}, np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            h, sizes = _flat(list(b["text"]), known)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            o = np.lexsort((h, doc))
            h, doc = h[o], doc[o]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            out += np.bincount(_place(h[first]), minlength=1 << COUNT_BITS)
        at = np.flatnonzero(out)
        yield pd.DataFrame({"at": at, "n": out[at]})

    some = rows.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(COUNT_EVERY)) == 0))
    got = some.select("text").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNT_BITS, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out


def _signed(rows: DataFrame, bits: np.ndarray | None, counts: np.ndarray) -> DataFrame:
    """id, split, runtime, r1, r2, n, sketches, keys; keys only once for the copies a task meets, and only held ones."""
    load = ship(rows.sparkSession, (bits, counts))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (held, counted), known, met = load(), {}, set()
        for b in batches:
            got = signatures(b.column("text").to_pylist(), known, held, met, counted)
            at, (offsets, keys) = pa.array(got.pop("at")), got.pop("keys")
            out = {k: b.column(k).take(at) for k in ("id", "split", "runtime")} | {k: pa.array(v, pa.int64()) for k, v in got.items()}
            yield pa.RecordBatch.from_pydict(out | {"keys": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.int64()))})

    schema = "id string, split string, runtime string, r1 long, r2 long, n long, sketch long, sketch2 long, keys array<long>"
    return rows.select("id", "split", "runtime", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sign, schema)


def _keys(signed: DataFrame, side: str) -> DataFrame:
    return signed.select(F.explode("keys").alias("f"), *[F.col(c).alias(f"{side}{k}") for c, k in (("r1", "r"), ("n", "n"), ("sketch", "s"), ("sketch2", "z"))])


def candidates(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """er, tr: texts (by r1) that share a key and may share enough words. No key is left out, however many texts hold it."""
    e, t = _keys(evaluation, "e"), _keys(training, "t")
    # which keys are met in blocks decides the cost and not the result, so some of the texts tell
    some = lambda x, r, c: x.where(F.pmod(F.xxhash64(r), F.lit(COUNT_EVERY)) == 0).groupBy("f").agg((F.count(F.lit(1)) * COUNT_EVERY).alias(c))
    per = some(e, "er", "_e").join(some(t, "tr", "_t"), "f", "full").select("f", F.coalesce("_e", F.lit(1)).alias("_e"), F.coalesce("_t", F.lit(1)).alias("_t"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    # each of them has BLOCK rows at least, so there are few
    heavy = cut(per.where(F.col("_e") * F.col("_t") > BLOCK * BLOCK).select("f", blocks("_e").alias("_eb"), blocks("_t").alias("_tb")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda r, c: F.pmod(F.xxhash64(r), F.col(c)).cast("int")
    most = F.floor((F.col("en") + F.col("tn")) * F.lit((1 - SHARE) / (1 + SHARE)) + F.lit(1e-9))
    apart = F.bit_count(F.col("es").bitwiseXOR(F.col("ts"))) + F.bit_count(F.col("ez").bitwiseXOR(F.col("tz")))
    near = (apart <= most) & (F.least("en", "tn") >= F.greatest("en", "tn") * F.lit(SHARE - 1e-9)) & (F.col("er") != F.col("tr"))
    if not heavy.take(1):
        return e.join(t, "f").where(near).select("er", "tr").distinct()
    mark = F.broadcast(heavy)
    light = e.join(mark, "f", "left_anti").join(t.join(mark, "f", "left_anti"), "f").where(near).select("er", "tr")
    el = e.join(mark, "f").withColumn("_i", own("er", "_eb")).withColumn("_j", every("_tb")).drop("_eb", "_tb")
    tl = t.join(mark, "f").withColumn("_j", own("tr", "_tb")).withColumn("_i", every("_eb")).drop("_eb", "_tb")
    return light.unionByName(el.join(tl, ["f", "_i", "_j"]).where(near).select("er", "tr")).distinct()


class Shard:
    """One automaton over the passages of some evaluation texts."""

    def __init__(self, ids: list[str], texts: list[str]):
        import ahocorasick

        self.ids, self.words = ids, [words_of(t) for t in texts]
        self.auto = ahocorasick.Automaton()
        place: dict[str, int] = {}
        cells = [(place.setdefault(w, len(place)), j) for j, ws in enumerate(self.words) for w in set(ws)]
        self.holds = np.zeros((len(place) + 1, len(ids)), np.uint8)  # the last row stays empty
        if cells:
            self.holds[tuple(np.array(cells).T)] = 1
        self.n = self.holds.sum(axis=0, dtype=np.int64)
        self.auto.add_word("  ", -1)  # matches nothing: words stand one blank apart
        for w, i in place.items():
            self.auto.add_word(f" {w} ", i)
        for ws in self.words:
            for p in _runs(ws):
                if len(p) > 1:
                    self.auto.add_word(_passage(p), p)
        self.auto.make_automaton()

    def scan(self, text: str) -> Iterator[tuple[str, float, float]]:
        """(id, share of all words, coverage in passages) of the evaluation texts that overlap a training text."""
        words = words_of(text)
        met, runs = set(), set()
        for _, hit in self.auto.iter(_passage(words)):
            (runs if isinstance(hit, tuple) else met).add(hit)
        both = self.holds[[*met, -1]].sum(axis=0, dtype=np.int64)
        share = both / np.maximum(1, self.n + len(set(words)) - both)
        for j in np.flatnonzero((share >= SHARE - 1e-9) & (both > 0)):
            yield self.ids[j], float(share[j]), self._covered(self.words[j], runs)

    @staticmethod
    def _covered(words: list[str], runs: set[tuple[str, ...]]) -> float:
        """Share of the words of an evaluation text under merged intervals of matched runs."""
        if len(words) < 2:
            return 1.0
        covered = end = 0
        for i, p in enumerate(_runs(words)):
            if p in runs:
                stop = i + len(p)
                covered, end = covered + stop - max(i, end), stop
        return covered / len(words)


def _passage(words) -> str:
    return f" {' '.join(words)} "


def _runs(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + PASSAGE]) for i in range(max(1, len(words) - PASSAGE + 1))]


def _scan(group: pd.DataFrame) -> pd.DataFrame:
    """Links of one part of a shard: rows are its evaluation texts and the training texts to scan."""
    ev = group[~group["train"]].drop_duplicates("id")
    shard = Shard(list(ev["id"]), list(ev["text"]))
    out = [(e, t, share, cover) for t, text in zip(group["id"][group["train"]], group["text"][group["train"]]) for e, share, cover in shard.scan(text)]
    return pd.DataFrame(out, columns=["eid", "tid", "share", "coverage"])


def scanned(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """eid, tid, share, coverage of the links among the shards and training texts that pairs (eid, tid) route.

    rows: id, text.
    """
    eids = pairs.select("eid").distinct()
    shards = max(1, -(-eids.count() // SHARD))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int").alias("shard")
    routed = cut(pairs.select(at("eid"), F.col("tid").alias("id")).distinct())
    # shards that many training texts reach are split by them
    split = cut(routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SCANNED).cast("int").alias("parts")).where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    train = routed.join(split, "shard", "left").select("shard", F.pmod(F.xxhash64("id", F.lit(1)), parts).cast("int").alias("part"), "id", F.lit(True).alias("train"))
    ev = eids.select(at("eid"), F.col("eid").alias("id")).join(split, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "id", F.lit(False).alias("train"))
    both = cut(train.unionByName(ev))
    texts = rows_with(rows.select("id", "text"), both.select("id").distinct(), "id").dropDuplicates(["id"])
    mine = both.join(texts, "id")
    return mine.groupBy("shard", "part").applyInPandas(_scan, "eid string, tid string, share double, coverage double")


def linked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, members, copied): eid, tid, share, coverage of linked texts, each under one of its ids, and the ids of each text.

    members: id, split, runtime, train, one (the id its text goes by on its side), parts; copied: train, one, _parts of texts
    with more than COPIES copies.
    """
    counts = _counts(rows)
    ev = cut(_signed(rows.where("split != 'train'"), None, counts))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def slots(keys: pd.Series) -> pd.Series:
        return pd.Series([_slot(k).astype(np.int64) for k in keys])

    held = bitmap(ev.select(F.explode(slots("keys")).alias("slot")))
    tr = cut(_signed(rows.where("split = 'train'"), held, counts))
    text = ["r1", "r2"]
    # each text of a side once, under its smallest id
    named = {train: cut(x.groupBy(*text).agg(F.min("id").alias("one"), F.count(F.lit(1)).alias("_n"))) for train, x in ((True, tr), (False, ev))}
    pairs = cut(candidates(ev, tr))
    # equal hashes name all texts that have them; the automata decide
    ids = pairs.join(named[False].select(F.col("r1").alias("er"), F.col("one").alias("eid")), "er").join(named[True].select(F.col("r1").alias("tr"), F.col("one").alias("tid")), "tr")
    same = named[False].select(*text, F.col("one").alias("eid")).join(named[True].select(*text, F.col("one").alias("tid")), text)
    links = cut(scanned(cut(ids.select("eid", "tid").unionByName(same.select("eid", "tid"))), rows))
    parts, copied = [], []
    for train, signed in ((True, tr), (False, ev)):
        big = named[train].where("_n > 1")
        m = signed.select("id", "split", "runtime", *text).join(big, text, "left")
        parts.append(m.select("id", "split", "runtime", F.lit(train).alias("train"), F.coalesce("one", "id").alias("one"), F.ceil(F.coalesce("_n", F.lit(1)) / COPIES).cast("int").alias("parts")))
        copied.append(big.where(F.col("_n") > COPIES).select(F.lit(train).alias("train"), "one", F.ceil(F.col("_n") / COPIES).cast("int").alias("_parts")))
    return links, parts[0].unionByName(parts[1]), copied[0].unionByName(copied[1])


def pairs_of(rows: DataFrame) -> DataFrame:
    """id_a, id_b of all rows whose texts are linked."""
    links, members, copied = linked(rows)
    p = links.select("eid", "tid")
    many = cut(copied)
    split = bool(many.take(1))  # texts with many copies meet their links in parts
    for side, train in (("eid", False), ("tid", True)):
        mine = members.where(F.col("train") == F.lit(train)).select(F.col("one").alias(side), F.col("id").alias(side[0]), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("_s"))
        if split:
            p = p.join(many.where(F.col("train") == F.lit(train)).select(F.col("one").alias(side), "_parts"), side, "left")
            p = p.withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts").join(mine, [side, "_s"]).drop("_s")
        else:
            p = p.join(mine.drop("_s"), side)
    p = p.where("e != t")
    return p.select(F.least("e", "t").alias("id_a"), F.greatest("e", "t").alias("id_b")).distinct()


def found(training: DataFrame, split_days: DataFrame, goals: DataFrame) -> DataFrame:
    return pairs_of(training_side(training, split_days)).unionByName(pairs_of(goal_side(goals)))


def report(rows: DataFrame, table: str) -> DataFrame:
    """table, split, runtime, records, overlapping, mean coverage of the overlapping ones."""
    links, members, _ = linked(rows)
    best = links.groupBy(F.col("eid").alias("one")).agg(F.max("coverage").alias("coverage"))
    ev = skew_lookup(members.where("not train"), best, "one")
    rt = F.when(F.col("runtime").isin(*RUNTIMES), F.col("runtime")).otherwise(F.lit("other"))
    return ev.groupBy("split", rt.alias("runtime")).agg(
        F.count(F.lit(1)).alias("records"), F.count("coverage").alias("overlapping"), F.round(F.avg("coverage"), 6).alias("mean_coverage")
    ).select(F.lit(table).alias("table_name"), "split", "runtime", "records", "overlapping", "mean_coverage")
