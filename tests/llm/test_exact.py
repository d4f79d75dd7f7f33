"""Operators with exact results against plain versions in Python, and their defined cases."""

import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from skein.llm import bpe, grouped_split, merkle, mixing, overlap, stable_sample, survivors

LABEL = "label_id long, ts string, session_id string, runtime string, aspect string, value string, note string, source string, mask int, trust string, rank string, n int"
TRAIN = "id string, split_day string, messages array<struct<role:string,content:string>>, metadata string, session string, split string, n int"
GOAL = "goal_id string, session_id string, runtime string, message string, goal string, goal_source string, gold boolean, digest string, form string, first_id string, words string, text string"


def rows(df):
    return {tuple(r) for r in df.collect()}


def label(i, ts="2026-01-01", s="ab12cd34ef5678", rt="omp", a="topic", v="x", n=None, src="human"):
    return (i, ts, s, rt, a, v, n, src, 1, "t", "r", 0)


@pytest.fixture(scope="module")
def trust(spark):
    return spark.createDataFrame([("manual", 4), ("human", 3), ("model", 1)], "source_kind string, trust long")


def test_survivors_policy(spark, trust):
    data = [
        label(1, "2026-01-01T00:00:00Z", v="old", n="note"), label(2, "2026-01-01T02:00:00+02:00", v="None", src=" MANUAL:w1"), label(3, "bad", v="", rt=None, n="  ", src="model"),
        label(4, "2026-02-01", "OMP/AB12CD34EF5678\n", v="new", rt=" "), label(5, a="one"), label(6, s=" ", a="blank"), label(7, s=None, a="blank"), label(8, a=None), label(9, a=None), label(10, a="none", v=None, rt="None", n=""), label(11, a="none", v=" ", rt=None, src=None),
        label(12, a="tie", v="a"), label(13, a="tie", v="b"), label(14, None, a="nots"), label(15, "", a="nots", src="who"),
    ]
    df = spark.createDataFrame(data, LABEL)
    assert rows(survivors.found(df, trust)) == {
        ("ab12cd34ef5678", "topic", 4, 1, 2), ("ab12cd34ef5678", "none", -1, -1, -1), ("ab12cd34ef5678", "tie", 13, -1, 13), ("ab12cd34ef5678", "nots", 14, -1, 14),
    }
    assert rows(survivors.found(df.unionByName(df), trust)) == rows(survivors.found(df, trust))  # repeated rows
    assert survivors.found(df.limit(0), trust).count() == 0
    got = {r["aspect"]: r for r in survivors.merged(df, trust).collect()}
    assert (got["topic"]["value"], got["topic"]["note"], got["topic"]["runtime"], got["topic"]["best_label"]) == ("new", "note", "omp", 2)


def test_survivors_layers_are_pareto(spark, trust):
    random.seed(4)
    data = [label(i, f"2026-01-{random.randint(1, 28):02d}", v=random.choice(["x", None]), n=random.choice(["y", ""]), rt=random.choice(["omp", "None"]), src=random.choice(["manual", "human", "model", "?"])) for i in range(60)]
    layers = survivors.skyline(spark.createDataFrame(data, LABEL), trust).first()["layers"]
    beats = lambda a, b: a["mask"] & b["mask"] == b["mask"] and a["trust"] >= b["trust"] and a["rank"] >= b["rank"] and (a["mask"], a["trust"], a["rank"]) != (b["mask"], b["trust"], b["rank"])
    for x in layers:
        over = [a["layer"] for a in layers if beats(a, x)]
        assert x["layer"] == (max(over) + 1 if over else 1)


def frozen(spark, data):
    return spark.createDataFrame(data, "frozen_id long, job string, fraction double, seed long, created_at string, session_ids array<string>, prev_id long, month int, code string")


def test_feistel_is_a_stable_permutation(spark):
    x = spark.range(5000).select((F.xxhash64("id").bitwiseAND(F.lit(stable_sample.DOMAIN - 1))).alias("x"))
    p = x.select("x", stable_sample.permute(F.col("x"), F.lit(7)).alias("p")).withColumn("b", stable_sample.invert(F.col("p"), F.lit(7)))
    assert p.where("x != b").count() == 0 and p.select("p").distinct().count() == x.distinct().count() and p.where((F.col("p") < 0) | (F.col("p") >= stable_sample.DOMAIN)).count() == 0
    share = p.where(stable_sample.selected(F.col("x"), F.lit(7), F.lit(0.3))).count() / 5000
    assert 0.27 < share < 0.33


def test_sample_grows_only(spark):
    ids = [f"{random.Random(i).getrandbits(56):014x}" for i in range(400)]
    df = spark.createDataFrame([label(i, s=s) for i, s in enumerate(ids)] + [label(999, s="zz"), label(998, s=None)], LABEL)
    spec = spark.createDataFrame([("topic", "topic-1", 5, 0.25), ("other", "o", None, 0.5)], "aspect string, job string, seed long, fraction double")
    few, many = (rows(stable_sample.sample(d, spec)) for d in (df.where("label_id < 200"), df.repartition(3)))
    assert few < many and 60 < len(many) < 140
    assert stable_sample.sample(df.limit(0), spec).count() == 0


def test_each_job_of_an_aspect_has_its_sample(spark):
    ids = [f"{random.Random(i).getrandbits(56):014x}" for i in range(400)]
    df = spark.createDataFrame([label(i, s=s) for i, s in enumerate(ids)], LABEL)
    old = frozen(spark, [(1, "topic-000-0001", 0.2, 5, "2026-01-01", [], 0, 0, ""), (2, "topic-000-0001", 0.2, 6, "2026-02-01", [], 0, 0, ""), (3, "topic-000-0001", 0.2, 5, "2026-03-01", [], 0, 0, "")])
    new = old.unionByName(frozen(spark, [(4, "topic-000-0002", 0.3, 9, "2026-04-01", [], 0, 0, "")]))
    before, after = (rows(stable_sample.sample(df, stable_sample.job_specs(f))) for f in (old, new))
    assert {r[:4] for r in after} == {("topic", "topic-000-0001", 5, 0.2), ("topic", "topic-000-0001", 6, 0.2), ("topic", "topic-000-0002", 9, 0.3)}
    x = spark.createDataFrame([(int(i, 16), i) for i in ids], "x long, i string")
    want = {("topic", j, s, f, r["i"]) for j, s, f in (("topic-000-0001", 5, 0.2), ("topic-000-0001", 6, 0.2), ("topic-000-0002", 9, 0.3)) for r in x.where(stable_sample.selected(F.col("x"), F.lit(s).cast("long"), F.lit(f))).collect()}
    assert before < after == want


def test_broken_records(spark):
    a, b, c, d = (f"{i:014x}" for i in range(1, 5))
    f = frozen(spark, [
        (1, "j", 0.2, 5, "2026-01-01T00:00:00Z", [a, f"omp/{b}", c, "junk", None], 0, 0, ""), (2, "j", 0.2, 5, "2026-01-01T02:00:00+02:00", [a.upper(), d, d], 0, 0, ""), (3, "j", 0.3, 5, "2026-05-01", [], 0, 0, ""), (4, "j", 0.2, 5, "2026-06-01T00:00:00Z", None, 0, 0, ""),
        (5, "k", None, None, "bad", [a], 0, 0, ""), (6, "k", None, None, None, [b], 0, 0, ""), (None, "k", None, None, None, [b], 0, 0, ""),
    ])
    labels = spark.createDataFrame([label(i, s=s) for i, s in enumerate((a, b, d))], LABEL)
    assert rows(stable_sample.broken_records(f, labels)) == {(2, b), (4, a), (4, d), (6, a)}
    assert stable_sample.broken_records(f.limit(0), labels).count() == 0 and stable_sample.broken_records(f, labels.limit(0)).count() == 0


def goal(i, m, g="Fix it", src=None, gold=None):
    return (i, "s", "omp", m, g, src, gold, "d", "f", "x", "w", "t")


def test_merkle_classes(spark):
    j = {"text": "Hello, World", "n": 1.5, "in": {"b": [1, 2], "a": None}}
    data = [
        goal("1", "Straße frei!"), goal("2", "  STRASSE​  frei"), goal("3", "strasse frei", "fix-IT."), goal("4", "strasse 1 frei"), goal("5", json.dumps(j)), goal("6", json.dumps({k: j[k] for k in ("in", "n", "text")}, indent=2).replace("Hello, World", "hello   WORLD…")),
        goal("7", json.dumps(j | {"n": 2.5})), goal("8", json.dumps(j | {"in": {"b": [2, 1], "a": None}})), goal("9", None, None), goal("a", "", " "), goal("b", "ok", None, "contract:no-task-v1"), goal("c", "OK", None, "contract:no-task-v1"), goal(None, "Straße frei!"), goal("d", "{not json}"), goal("e", "not JSON"),
    ]
    df = spark.createDataFrame(data, GOAL)
    want = {("1", "2"), ("1", "3"), ("5", "6"), ("9", "a"), ("d", "e")}
    assert rows(merkle.found(df)) == want and rows(merkle.found(df.unionByName(df))) == want
    assert {r["goal_id"]: r["copies"] for r in merkle.collapsed(df).collect()}["1"] == 3
    assert merkle.found(df.limit(0)).count() == 0


def test_merkle_sees_through_any_formatting(spark):
    """Blanks, invisible and other signs and case put in or swapped anywhere, composed and decomposed letters."""
    rng = random.Random(12)
    texts = ["Keep über_alles.md", "see 3.2.7 of a/b-c", "café Zażółć gęślą", "don't stop", '{"b": "x y", "a": ["p. q", 1]}']

    def disguise(t):
        if t.startswith("{"):
            x = json.loads(t)
            return json.dumps({k: [disguise(x["a"][0]), 1] if k == "a" else disguise(x["b"]) for k in rng.sample(["a", "b"], 2)}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        out = "".join(rng.choice(["", "", "", " ", "\u200b", "\u3000", ", ", "*", "\u00ad", "'"]) + (c.upper() if rng.random() < 0.5 else c) for c in t if c.isalnum())
        return unicodedata.normalize(rng.choice(["NFC", "NFD"]), out)

    data = [goal(f"{i}", t) for i, t in enumerate(texts)] + [goal(f"{i}-{j:03d}", disguise(t)) for i, t in enumerate(texts) for j in range(40)]
    df = spark.createDataFrame(data, GOAL)
    assert rows(merkle.found(df)) == {(f"{i}", f"{i}-{j:03d}") for i in range(len(texts)) for j in range(40)}


def test_merkle_compares_forms_when_digests_collide(spark, monkeypatch):
    monkeypatch.setattr(merkle.F, "sha2", lambda c, n: F.lit("5a3e"))
    df = spark.createDataFrame([goal("1", "a"), goal("2", "b"), goal("3", "B."), goal("4", "c")], GOAL)
    assert rows(merkle.found(df)) == {("2", "3")}


def train(i, meta, day="2026-01-01", text="x"):
    return (i, day, [("user", text)], meta if meta is None or isinstance(meta, str) else json.dumps(meta), "q", "q", 1)


def test_components_against_union_find(spark):
    random.seed(9)
    data, parent = [], {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    by: dict = {}
    for i in range(400):
        s, a = f"{random.randint(1, 260):014x}", random.choice(["hub"] * 6 + [f"p{random.randint(1, 120)}"] * 8 + [None, "", "unknown"])
        data.append(train(str(i), {"session_id": random.choice([s, f"omp/{s.upper()} "]), "author": random.choice([a, f" @{a.upper()} "]) if a and a != "unknown" else a, "runtime": "omp"}))
        find(s)
        if a and a != "unknown":
            by.setdefault(a, []).append(s)
    for group in by.values():
        for x, y in zip(group, group[1:]):
            p, q = sorted((find(x), find(y)))
            parent[q] = p
    df = spark.createDataFrame(data + [train("n1", None), train("n2", "not json"), train("n3", {"author": "hub"}), train("n4", {"session_id": " "})], TRAIN)
    assert rows(grouped_split.found(df)) == {(find(x), x) for x in parent if find(x) != x}
    got = grouped_split.assign(df)
    assert got.count() == 404
    root = {r["session"]: r["split"] for r in got.where("session is not null").collect()}
    assert all(root[x] == root[find(x)] for x in parent)
    assert grouped_split.found(df.limit(0)).count() == 0 and grouped_split.assign(df.limit(0)).count() == 0


def test_chain_contracts(spark):
    order = random.Random(3).sample(range(300), 300)
    edges = spark.createDataFrame([(f"{a:04d}", f"{b:04d}") for a, b in zip(order, order[1:])] + [(None, "1"), ("1", "1")], "a string, b string")
    assert {r["root"] for r in grouped_split.components(edges).collect()} == {"0000"}


def test_split_shares(spark):
    random.seed(1)
    data = [train(str(i), {"session_id": f"{random.randint(0, 900):014x}", "runtime": random.choice(["omp", "omp", "claude", "kimi", None])}) for i in range(3000)]
    for r in grouped_split.shares_report(grouped_split.assign(spark.createDataFrame(data, TRAIN))).collect():
        assert abs(r["share"] - {"train": 0.8, "validation": 0.1, "test": 0.1}[r["split"]]) < 0.03


def test_authors_without_sessions_and_large_groups(spark):
    """Rows of an author stay together with or without session; one group of half of the rows leaves the shares right."""
    random.seed(3)
    data = [train(f"h{i}", {"author": "Hub", "session_id": f"{i % 5:014x}" if i % 2 else None, "runtime": "omp"}) for i in range(1000)]
    data += [train(f"l{i}", {"author": f"a{i % 300}", "runtime": ["omp", "kimi"][i % 2]}) for i in range(1000)]
    got = {r["id"]: r["split"] for r in grouped_split.assign(spark.createDataFrame(data, TRAIN)).collect()}
    assert len(got) == 2000 and len({v for k, v in got.items() if k[0] == "h"}) == 1
    for i in range(300):
        assert len({got[f"l{k}"] for k in range(i, 1000, 300)}) == 1
    share = lambda x: sum(v == x for v in got.values()) / 2000
    assert abs(share("train") - 0.8) < 0.02 and abs(share("test") - 0.1) < 0.02


def test_labels_follow(spark):
    a = spark.createDataFrame([("1", "ab12cd34ef5678", "omp", "test")], "id string, session string, runtime string, split string")
    got = {r["label_id"]: r["split"] for r in grouped_split.follow(spark.createDataFrame([label(1, s="OMP/ab12cd34ef5678"), label(2, s="0" * 14), label(3, s="0" * 14), label(4, s=None)], LABEL), a).collect()}
    assert got[1] == "test" and got[2] == got[3] and len(got) == 4


def brute(side):
    w = lambda t: set(re.findall(r"[^\W_]+", (t or "").lower()))
    out = set()
    for i, s, t in side:
        for k, p, u in side:
            if s != "train" and p == "train" and i != k and (a := w(t)) and (b := w(u)) and len(a & b) >= 0.7 * len(a | b) - 1e-9:
                out.add((min(i, k), max(i, k)))
    return out


def test_overlaps_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    side = []
    for i in range(120):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(15, 60))]
        side.append((f"t{i:03d}", "train", " ".join(t)))
        for k in range(rng.choice((0, 1, 2))):
            u = [x if rng.random() > 0.12 else rng.choice(vocabulary) for x in t]
            side.append((f"e{i:03d}{k}", rng.choice(("test", "validation")), rng.choice((" ".join(u), ", ".join(u).upper(), " ".join(t)))))
    side += [("e900", "test", ""), ("e901", "test", None), ("t900", "train", "!!"), ("t901", "train", "one two"), ("e902", "test", "Two, one"), ("t902", "train", "x " * 20000 + "y"), ("e903", "test", "y x"), ("t900", "train", "dup id"), ("t903", "train", side[0][2])]
    df = spark.createDataFrame([(i, s, "omp", t) for i, s, t in side], "id string, split string, runtime string, text string")
    assert rows(overlap.pairs_of(df)) == brute(side)
    assert rows(overlap.pairs_of(df.unionByName(df))) == brute(side)
    assert overlap.pairs_of(df.limit(0)).count() == 0
    assert overlap.report(df, "t").groupBy().agg(F.sum("overlapping")).first()[0] == len({p for a, b in brute(side) for p in (a, b) if p[0] == "e"})


def test_overlaps_of_a_large_group_of_near_copies(spark, monkeypatch):
    for name, few in (("BLOCK", 8), ("SCANNED", 16), ("COPIES", 4)):
        monkeypatch.setattr(overlap, name, few)
    base = [f"word{i}" for i in range(10)]
    side = [(f"{s[1]}{i:03d}", s, " ".join([*base, f"own{s}{i}"])) for s, n in (("train", 280), ("test", 12)) for i in range(n)]
    side += [(f"{s[1]}c{i}", s, " ".join(base)) for s in ("train", "test") for i in range(9)]
    side += [(f"{s[1]}x{i}", s, " ".join([*base[:6], f"far{s}{i}", f"off{s}{i}"])) for s in ("train", "test") for i in range(3)]
    df = spark.createDataFrame([(i, s, "omp", t) for i, s, t in side], "id string, split string, runtime string, text string")
    want = brute(side)
    assert len(want) >= 280 * 12 and rows(overlap.pairs_of(df)) == want


def test_overlaps_of_short_texts(spark):
    rng = random.Random(8)
    side = [("t1", "train", "fix the login form"), ("e1", "test", "please fix the login form"), ("e2", "test", "fix login form"), ("e3", "test", "login"), ("t3", "train", "Login!")]
    for i in range(500):
        t = rng.sample([f"w{k}" for k in range(60)], rng.randint(1, 10))
        u = [x for x in t if rng.random() > 0.12] + [f"w{rng.randrange(60)}"][: rng.randint(0, 1)]
        side += [(f"t{i:03d}x", "train", " ".join(t)), (f"e{i:03d}x", "test", " ".join(rng.sample(u, len(u))))]
    df = spark.createDataFrame([(i, s, "omp", t) for i, s, t in side], "id string, split string, runtime string, text string")
    got = rows(overlap.pairs_of(df))
    assert {("e1", "t1"), ("e2", "t1"), ("e3", "t3")} <= got and got == brute(side)


def test_overlap_sides(spark):
    days = spark.createDataFrame([("2026-01-01", "train"), ("2026-01-02", "test")], "split_day string, split_name string")
    t = "the same words in both of these rows for once"
    tr = spark.createDataFrame([train("1", None, " 2026/01/01", json.dumps({"n": 1, "text": t})), train("2", None, "20260102", t.upper()), train("3", None, "undated", t), train("4", None, None, t), train(None, None, "20260102", t), ("5", "20260102", None, None, "", "", 1)], TRAIN)
    g = spark.createDataFrame([goal("g2", t, gold=True), goal("g1", t + "!"), goal("g3", t, src="contract:no-task-v1"), goal("g4", None, gold=True)], GOAL)
    assert rows(overlap.found(tr, days, g)) == {("1", "2"), ("g1", "g2")}
    alike = spark.createDataFrame([goal("2", t, gold=True), goal("1", t + "!")], GOAL)  # ids and texts of the other table
    assert sorted(tuple(x) for x in overlap.found(tr, days, alike).collect()) == [("1", "2"), ("1", "2")]


def test_a_shard_scans():
    e = "a b c d e f g h".split()
    shard = overlap.Shard(["one", "two", "none", "w"], [" ".join(e), "A, b c d e f g x", "q r s", "solo"])
    assert list(shard.scan("a b c d e f g h")) == [("one", 1.0, 1.0), ("two", 7 / 9, 7 / 8)]
    assert list(shard.scan("h g f e d c b a")) == [("one", 1.0, 0.0), ("two", 7 / 9, 0.0)]
    assert list(shard.scan("solo Solo")) == [("w", 1.0, 1.0)] and not list(shard.scan("")) and not list(shard.scan("--")) and not list(shard.scan("ab cd"))
    assert list(overlap.Shard([], []).scan("a b")) == []


def template(trains: int):
    """20 evaluation and `trains` training rows of one template of 66 words, edited every 11 words."""
    rng = random.Random(4)
    base = [f"word{i}" for i in range(66)]

    def edited(i):
        w = list(base)
        for k in range(0, 66, 11):
            w[k + rng.randrange(11)] = f"x{rng.randrange(30)}"
        return w

    return [(f"{s[1]}{i:05d}", s, " ".join(edited(i))) for s, n in (("train", trains), ("test", 20)) for i in range(n)]


@pytest.mark.parametrize("trains", [100, 400, 5000])
def test_overlaps_of_a_template(spark, trains):
    side = template(trains)
    df = spark.createDataFrame([(i, s, "omp", t) for i, s, t in side], "id string, split string, runtime string, text string")
    got = rows(overlap.pairs_of(df))
    assert len(got) > trains and got == brute(side)


def test_the_automata_find_the_overlaps(spark, monkeypatch):
    monkeypatch.setattr(overlap.Shard, "scan", lambda self, text: iter(()))
    df = spark.createDataFrame([(i, s, "omp", t) for i, s, t in template(50)], "id string, split string, runtime string, text string")
    assert overlap.pairs_of(df).count() == 0



def test_bpe_against_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks(bpe.VOCABULARY)
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello  world's\n\tend ", "<|endoftext|> plain", "zażółć gęślą jaźń", "日本語のテキスト" * 60, "👩‍💻 é", "a" * 3000, "x1y2" * 500, "", None, " ", "﻿​", "don't can't WE'LL"]
    df = spark.createDataFrame([(i, t, [9]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in bpe.corpus_ids(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (enc.encode_ordinary(t) if t else [])
        assert enc.decode(got[i]) == (t or "")
    rng = random.Random(1)
    for n in (2, 3, 50, 400):
        w = bytes(rng.choice(b"abcdehilnorst ") for _ in range(n))
        assert bpe.merge_long(w, ranks) == bpe.merge_short(w, ranks)
    assert bpe.corpus_ids(df.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(2)
    words = "river table green window letter market garden silver".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 120))), rng.choice(["a"] * 8 + ["b"] * 2 + ["c", None, "x"])) for i in range(800)]
    docs += [(5000, docs[0][1], docs[0][2]), (5001, "", "a"), (5002, None, "a"), (None, "text", "a")]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, source string, tokens int, h string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("gone", 0.05, 3)], "source string, target_share double, max_repeats long")
    texts = mixing.sized_texts(df, t).cache()
    assert texts.select("doc_id").distinct().count() == texts.count() and texts.where("doc_id = 5000").count() == 0
    m = mixing.mix(texts, t).cache()
    for r in mixing.shares(m, t).collect():
        assert r["most_copies"] <= r["max_repeats"] and abs(r["actual_share"] - (0 if r["source"] == "gone" else r["target_share"] / 0.95)) < 0.02
    assert rows(m) == rows(mixing.mix(texts.repartition(7), t))
    near = spark.createDataFrame([("a", 0.5, 1), ("b", 0.001, 1)], "source string, target_share double, max_repeats long")
    for r in mixing.shares(mixing.mix(texts, near, full_weight=1), near).collect():  # chances near 1 and near 0
        assert abs(r["actual_share"] - r["target_share"] / 0.501) < 0.02
    assert mixing.mix(mixing.sized_texts(df.limit(0), t), t).count() == 0
    assert mixing.sized_texts(df, t.limit(0)).count() == 0
