"""Text operators: held-out accuracy on composed cases, and their defined cases."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.llm import boosting, crf, pairs, pii, residue


def test_field_learns_a_chain():
    rng = random.Random(1)
    x, y = [], []
    for _ in range(300):
        tags = [rng.choice("ab")]
        for _ in range(5):
            tags.append(tags[-1] if rng.random() < 0.9 else "ab"[tags[-1] == "a"])
        x.append([[f"o={t if rng.random() < 0.75 else rng.choice('ab')}"] for t in tags])
        y.append(tags)
    f = crf.LinearChainCRF("ab", epochs=10).fit(x[:200], y[:200])
    right = sum(p == q for s, t in zip(x[200:], y[200:]) for p, q in zip(f.tag(s), t)) / 600
    assert right > 0.85 and f.tag([]) == [] and f.tag([["unseen"]])[0] in "ab"


def test_boosting_learns_a_rule():
    import numpy as np

    r = np.random.RandomState(0)
    x = r.rand(1500, 5)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = boosting.Boosted(rounds=30).fit(x[:1000], y[:1000])
    p = m.predict(x[1000:])
    assert ((p > boosting.best_threshold(p, y[1000:])) == y[1000:]).mean() > 0.95


VERBS = {"en": ["Fix", "Sort", "Test", "Move", "Clean"], "pl": ["Napraw", "Posortuj", "Sprawdź", "Przenieś"], "de": ["Repariere", "Sortiere", "Prüfe", "Verschiebe"], "es": ["Corrige", "Ordena", "Revisa", "Mueve"]}
THINGS = {"en": ["the login form", "the search sidebar", "the upload queue"], "pl": ["formularz zaproszeń", "licznik prób", "dziennik błędów"], "de": ["das Suchfeld", "das Startskript", "das Protokoll"], "es": ["el menú lateral", "el gestor de colas", "el archivo de ajustes"]}
FRAMES = {
    "en": "Could you please {v} {t} because it stops after 12 minutes and the team is waiting for it. The last run of the job was not good so do not change the rest.",
    "pl": "Proszę {v} {t} bo zatrzymuje się po 12 minutach i nikt nie wie dlaczego. Ostatnie uruchomienie nie było dobre, więc nie zmieniaj reszty.",
    "de": "Bitte {v} {t} weil es nach 12 Minuten stehen bleibt und wir nicht wissen warum. Der letzte Lauf war nicht gut, also bitte nichts anderes ändern.",
    "es": "Por favor {v} {t} porque se detiene tras 12 minutos y nadie sabe por qué. La última ejecución no fue buena, así que no cambies lo demás.",
}
REFUSALS = ["I'm sorry, but I can't help with that.", "I cannot do this", "Niestety nie mogę w tym pomóc", "Leider kann ich dabei nicht helfen", "Lo siento, no puedo ayudar con eso", "As a language model I have no access to files"]


def prediction_rows(n=500):
    rng = random.Random(3)
    out, truth = [], set()
    for i in range(n):
        lang = rng.choice(list(VERBS))
        v, t = rng.choice(VERBS[lang]), rng.choice(THINGS[lang])
        m, good = FRAMES[lang].format(v=v.lower(), t=t), f"{v} {t}"
        kind = rng.choice(["ok"] * 7 + list(pairs.DEFECTS))
        other = rng.choice([x for x in VERBS if x != lang])
        a = {"ok": f"<goal>{good}</goal>" if rng.random() < 0.7 else good, "empty": rng.choice(["", None, "<goal/>", "...", "<goal>  </goal>"]), "refusal": rng.choice(REFUSALS), "copy": rng.choice([m, f"Message: {m}", m.upper()]), "truncated": rng.choice([f"<goal>{good[:-3]}", f"<goal>{good}</go"]), "language": f"<goal>{rng.choice(VERBS[other])} {rng.choice(THINGS[other])}</goal>"}[kind]
        out.append((i, "s", m, f"<goal>{good}</goal>", a, "x"))
        if kind != "ok":
            truth.add((i, "student", kind))
    return out, truth


PRED = "pred_id long, session_id string, message string, goal string, student string, defect string"


def test_pair_defects(spark):
    data, truth = prediction_rows()
    extra = [(9000, "s", "ok", "<goal/>", "", "x"), (9001, "s", "thanks", "<goal></goal>", None, "x"), (9002, None, None, None, None, None), (9003, "s", "", "x", "y z", ""), (None, "s", "m", "", "", "")]
    df = spark.createDataFrame(data + extra, PRED)
    got = {tuple(r) for r in pairs.found(df).collect()}
    student = {g for g in got if g[0] < 9000 and g[1] == "student"}
    assert len(student & truth) / len(truth) > 0.93 and len(student & truth) / len(student) > 0.93
    assert not {g for g in got if g[0] in (9000, 9001, 9002)}
    assert pairs.found(df.limit(0)).count() == 0
    assert {tuple(r) for r in pairs.found(df.unionByName(df)).collect()} >= set()


def test_pair_defects_of_other_wording(spark):
    """Refusals, languages and endings that no list has, by a field fitted on the composed rows."""
    data, _ = prediction_rows()
    m = "Could you please fix the login form because it loses the name that was entered and the team is waiting for it."
    cases = [
        ("Count me out of this one", "refusal"), ("Nope, not going there", "refusal"), ("This topic is off the table for me", "refusal"), ("Renommer la bannière de facturation avant la publication", "language"),
        ("Rinomina il banner di fatturazione prima della versione", "language"), ("Почини форму входа", "language"), ("Fix the login form", None), ("Fix the entered name", None), ("Fix the login fo", "truncated"), ("<goal>Fix the login form", "truncated"),
    ]
    df = spark.createDataFrame(data + [(9000 + i, "s", m, "<goal>Fix the login form</goal>", a, "x") for i, (a, _) in enumerate(cases)], PRED)
    got = {(r["pred_id"], r["defect"]) for r in pairs.found(df).where("pred_id >= 9000").collect()}
    want = {(9000 + i, d) for i, (_, d) in enumerate(cases) if d}
    assert len(got ^ want) <= 1, got ^ want


NAMES = [("Anna", "given"), ("Björn", "given"), ("Will", "given"), ("Rose", "given"), ("Talgradby", "family"), ("Ostlinson", "family"), ("Bellinwicz", "family"), ("Kafenez", "family")] + [(f"{a}{b}", "family") for a in ("Grat", "Mornel", "Vastrun", "Dolfin", "Hespar", "Lindor") for b in ("by", "wicz", "son", "ez", "ford")]
CASES = [
    ("Call Anna Talgradby at +44 7700 900123 now", {("name", 6), ("phone", 24)}),
    ("mail anna.talgradby@post.nord.example or b (at) x.org", {("email", 6), ("email", 42)}),
    ("reach j_k at mail dot nord dot example", {("email", 7)}),
    ("PESEL 44051401359 and 44051401358", {("idnum", 7)}),
    ("documento QQ123456C, in 326685a of the commit", {("idnum", 11)}),
    ("ul. Lipowa 5/7, 00-001 Stadtau; Lindenstraße 12; 12 Elm Close.", {("address", 1), ("address", 33), ("address", 50)}),
    ("signed B. OSTLINSON and bellinwicz, björn", {("name", 8), ("name", 25)}),
    ("press Will Return twice, the Rose Theme is off", set()),
    ("at 2026-05-01T10:00:00Z bind 10.0.0.1:8080, version 3.27.6, epoch 4344016953", set()),
    ("pin cursor-kit@3.27.6 and @session_scope", set()),
    ("(617) 555-0119 or 020 7946 0833", {("phone", 1), ("phone", 19)}),
    (json.dumps({"text": "by Björn Kafenez"}), {("name", 14)}),
    ("", set()), (None, set()), ("   ", set()),
]


@pytest.fixture(scope="module")
def finder(spark):
    corpus = [f"the {w} panel shows {i} rows and the last run went quiet before noon" for i, w in enumerate(["river", "table", "window", "letter", "market"] * 40)]
    return pii.train({n.lower() for n, k in NAMES if k == "given"}, {n.lower() for n, k in NAMES if k == "family"}, corpus)


def test_personal_information(finder):
    wrong = []
    for (text, want), got in zip(CASES, finder.find_all([t for t, _ in CASES])):
        if {(k, a + 1) for k, a, _ in got} != want:
            wrong.append((text, want, got))
    assert len(wrong) <= 1, wrong


def test_held_out_spans(finder):
    rng = random.Random(77)
    made = pii.invented(["Anna", "Björn", "Rose"], [n for n, k in NAMES if k == "family"], ["river", "table", "window", "letter"], rng)
    rng.shuffle(made)
    tp = fp = fn = 0
    for (text, items), got in zip(made[:1500], finder.find_all([t for t, _ in made[:1500]])):
        g = {(k, a) for k, a, _ in got}
        tp, fp, fn = tp + len(g & set(items)), fp + len(g - set(items)), fn + len(set(items) - g)
    assert tp / (tp + fp) > 0.93 and tp / (tp + fn) > 0.93


def test_redaction_and_edges(spark, finder):
    long = "x " * 50_000 + "mail a.b@c.example end"
    df = spark.createDataFrame([("1", "to a.b@c.example, Anna Talgradby!"), ("2", None), ("3", ""), ("4", long), (None, "a.b@c.example")], "row_id string, text string")
    got = {r["row_id"]: r for r in pii.redacted(df.where("row_id is not null"), finder).collect()}
    assert got["1"]["text"] == "to [EMAIL], [NAME]!" and got["2"]["text"] is None and got["4"]["text"].endswith("mail [EMAIL] end")
    assert {tuple(r) for r in pii.spans(df.where("row_id = '4'"), finder).select("kind", "start_pos").collect()} == {("email", 100_006)}
    texts = spark.createDataFrame([("t1", "s", "r", "a.b@c.example", "z")], "text_id string, session_id string, runtime string, text string, kind string")
    goals = spark.createDataFrame([("g1", None), (None, "a.b@c.example")], "goal_id string, message string")
    none = spark.createDataFrame([], "name_text string, name_kind string")
    assert [tuple(r) for r in pii.found(texts, goals, none).collect()] == [("t1", "email", 1)]
    assert pii.found(texts.limit(0), goals.limit(0), none).count() == 0


@pytest.mark.parametrize("text, n", [("x " * 50_000 + "Gr\\u00fc\\u00dfe \\u0041 a.b@c.example", 20), ("(617) 555-0119, " * 500, 160)])
def test_memory_of_a_batch(finder, text, n):
    """Escapes and candidates of a whole batch aren't held at once; items stand where they stood."""
    import tracemalloc

    finder.find_all([text])  # builds the automaton
    tracemalloc.start()
    try:
        got = finder.find_all([text] * n)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40e6, peak
    want = [("email", text.index("a.b@"), len(text))] if "@" in text else [("phone", 16 * i, 16 * i + 14) for i in range(500)]
    assert got == [want] * n


@pytest.mark.parametrize("text", ["dot " + "x." * 10_000 + "@ ", "@ " + "ab" * 10_000 + " "])
def test_runs_of_letters_take_time_in_proportion(finder, text):
    import time

    began = time.process_time()
    assert pii._cleared(text) == text and finder.find_all([text]) == [[]]
    assert time.process_time() - began < 2


def _composed(n):
    rng = random.Random(5)
    bits = ["@", ".", " ", "at", " At ", " dot ", "(at)", "[at]", "( at ", "[dot]", " [ dot ] ", "dot", "a", "Xyz", "7", "_", "+", "-", "é", "Anna", "J. ", "K.", "\n", "'", "’", "/", ",", "12", "123456", "12 34 56 ", "QQ", "QQ123456", "AB ", "C", "a ", ":", "(", ")", "+49 30 ", "123-45-6789", "555 123 4567", "٣", "Ⅷ", "²"]
    for _ in range(n):
        some = rng.sample(bits, rng.randint(3, 14))
        yield "".join(rng.choice(some) for _ in range(rng.randint(1, 40)))


def test_scans_find_what_the_whole_patterns_find():
    """Signs, dots and digits that the scans start from lose nothing against patterns tried at each character."""
    email = re.compile(rf"[^\W_](?:[\w.+%-]*[\w+%-])?(?:{pii._HOST.pattern})", re.I)
    lettered = re.compile(r"(?<=[A-Za-z]{2})(?:\d{6}| \d{6} | \d\d \d\d \d\d )[A-Da-d](?!\w)")
    initial = re.compile(r"(?<![\w.])[^\W\d_]\.\s?(?=[^\W\d_]{4,})")
    seen = [0, 0, 0, 0]
    for t in _composed(20_000):
        mails = [m.span() for m in email.finditer(t)]
        assert list(pii._emails(t, t.lower())) == mails, t
        ids = [(m.start() - 2, m.end()) for m in lettered.finditer(t) if m.start() == 2 or not t[m.start() - 3].isalnum()]
        spans = list(pii._digit_spans(t))
        assert [(a, b) for k, a, b, _ in spans if k == "idnum" and t[b - 1].isalpha()] == ids, t
        phones = [m.start() for m in pii._DIGITS.finditer(t) if m.group().count("(") == m.group().count(")") and 9 <= sum(c.isdigit() for c in m.group()) <= 15]
        assert [a for k, a, b, _ in spans if k == "phone" and a in phones] == phones, t
        initials = [m.span() for m in initial.finditer(t)]
        assert [(m.start() - 1, m.end()) for m in pii._INITIAL.finditer(t)] == initials, t
        seen = [n + len(x) for n, x in zip(seen, (mails, ids, phones, initials))]
    assert min(seen) > 50, seen


def test_counts_of_words_and_neighbours():
    given, family, texts = {"anna", "a"}, {"xyz", "k"}, list(_composed(3_000))
    every, beside = Counter(), {"given": Counter(), "family": Counter()}
    counts = pii.Counts(given, family, True)
    for t in texts:
        d = pii._cleared(t)
        every.update(pii._WORD.findall(d))
        for k, w in pii._neighbours(d, given, family):
            beside[k][w] += 1
        counts.add(t)
    assert all(beside.values()) and counts.take() == beside | {"every": every}
    assert len(counts) == 0 and not any(counts.take().values())


RESIDUE = [
    ("404 Not Found", "error_page"), ('{"error": {"code": 503, "message": "Service Unavailable"}}', "error_page"), ("Access denied. Your role may not open /a/b. Case 82daddd0ab43", "error_page"), ("HTTP/1.1 503 Service Unavailable\r\nContent-Length: 0", "error_page"),
    ("<html><head><title>502 Bad Gateway</title></head><body><h1>Bad Gateway</h1><hr></body></html>", "error_page"), ("Wystąpił błąd serwera. Spróbuj ponownie później.", "error_page"),
    ("Menu | Search | Sign in\n\nJavaScript is disabled. Turn it on and reload the page.\n\n© 2026", "script_notice"), ("Bitte aktivieren Sie JavaScript, um diese Sitzung zu sehen.", "script_notice"),
    ("Lorem ipsum dolor sit amet tempor. Magna aliqua labore nostrud enim quis.", "filler"), ("foo bar baz foo test asdf", "filler"), ("Heading 1\nBody copy\nTitle 2\nSome text", "filler"), ("Your text goes here.\n\nContent coming soon", "filler"),
    ("Dear {{ user }}, run <<RUN_ID>> ended with %STATE%.", "placeholder"), ("All good. Goal: [INSERT GOAL]. Owner: $OWNER$.", "placeholder"),
    ('Our own page says "404 Not Found" when a/b.html is missing.', None), ("The template `{{ name }}` renders well.", None), ("```\nHTTP/1.1 503 Service Unavailable\n``` is what it gets at night.", None), ("The preview uses lorem ipsum as its sample, fooBarBaz replaces it.", None),
    ("Users without JavaScript see an empty pageOne, so a/b.html carries a list.", None), ("ok", None), ("", None), (None, None), ("   ", None), ("[user] Fix the form\n[assistant] Done, the form works again.", None),
]


def test_residue(spark):
    data = [(i, t, "src", "k") for i, (t, _) in enumerate(RESIDUE)]
    df = spark.createDataFrame(data + [(None, "404 Not Found", "s", "k"), (900, "word " * 200_000, None, "k")], "doc_id long, text string, source string, kind string")
    want = {(i, k) for i, (_, k) in enumerate(RESIDUE) if k}
    assert {tuple(r) for r in residue.found(df).collect()} == want
    assert residue.kept(df).count() == len(RESIDUE) + 1 - len(want)
    assert residue.found(df.limit(0)).count() == 0
    pages = spark.createDataFrame([(i, "Return to the list.", f"s{i % 4}") for i in range(9)] + [(99, "Wait a minute and try once more.", "s1")], "doc_id long, text string, source string")
    assert {r["doc_id"] for r in residue.found(pages).collect()} == set(range(9))
    assert [(r["docs"], r["sources"]) for r in residue.recurring(pages).orderBy("docs").collect()] == [(9, 4)]


def test_recurring_pages_that_no_phrase_lists(spark, monkeypatch):
    oops, lone = "Oops! That page can't be found.", "That page can't be reached."
    data = [(900, lone, "s1"), (901, f"{oops} The form saves again and the tests pass, so the list of notes has all of its rows.", "s1")]
    data += [(1000, "error: internal server error " + "x y z " * 800, "s1"), (1001, f"The {oops.lower()} text is gone.", None)]
    short = spark.createDataFrame([(i, oops, f"s{i % 5}") for i in range(250)] + data, "doc_id long, text string, source string")
    got = {r["doc_id"] for r in residue.found(short).collect()}
    assert {*range(250), 1000} <= got and not got & {900, 901, 1001}
    monkeypatch.setattr(residue, "WIDE_SOURCES", 10**9)
    assert not {r["doc_id"] for r in residue.found(short).collect()} & {*range(250)}


def test_names_are_learned_from_all_texts(spark):
    """A name of one text among more than 20,000, or in a text of more than 20,000 characters, is learned."""
    parts = spark.createDataFrame(NAMES, "name_text string, name_kind string")
    given = next(n for n, k in NAMES if k == "given")
    family = [n for n, k in NAMES if k == "family"]
    new = [f"{a[:-2]}{b[-3:]}".lower() for a, b in zip(family, family[1:])]
    new = sorted(set(new) - {f.lower() for f in family})
    plain = spark.range(21_000).select(F.concat(F.lit("p"), "id").alias("row_id"), F.lit("the window and the river table letter market").alias("text"))
    own = spark.createDataFrame([(f"n{i}", "river table " * (2_000 * (i % 2)) + f"ask {given} {w.title()} today") for i, w in enumerate(new)], "row_id string, text string")
    finder = pii.fit(plain.unionByName(own), parts)
    like = {w for w in new if finder.names.like(w) > 0.2}
    assert {new.index(w) % 2 for w in like} == {0, 1} and like <= finder.names.family
