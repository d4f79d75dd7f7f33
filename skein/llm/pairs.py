"""Defects of prompt and response pairs: clauses tagged by a conditional random field.

An answer is cut into clauses; a linear-chain field tags each as answer, refusal, echo, foreign or unfinished from
features that compare it with the message (shared words and runs, refusal cues, language of both, how it ends). The
share of the answer under each tag, and the share of the message that echoed clauses cover, give the defect; at most one,
the first of DEFECTS.

The field is trained here on at most SAMPLE rows of the table: their sound answers, and the same answers damaged on
purpose (cut off within a word, replaced by a refusal put together from parts, by the message or most of it, by an answer
to a message in another language). Only this fit uses the sample. What words there are, how often each stands inside a text
and not at its end (fragments of words stand only at ends), and the words and letter triples of each language (of messages
that their function words tell) are counted over all rows; words of at least COMMON of all words come to the fit.

Defined cases: a null or blank answer is empty where the message states a task; a null or blank message states none and
can't be copied; `<goal/>` and an empty pair of tags are right answers to a mere acknowledgement; answers with no tags are
fine; an answer of no known language is not foreign; texts of any length are read whole; null ids are left out; repeated
rows give their defects once; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import cycle, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.crf import LinearChainCRF
from skein.runtime import cut, ship

DEFECTS = ("empty", "refusal", "copy", "truncated", "language")
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
SAMPLE = 4_000
#: So many times a sound answer is used with a damaged one beside it.
TRAINING = 2_000
SEED = 5
#: Words that make up at least this share of all words are known one by one, so there are never more than 1 / COMMON.
COMMON = 2e-6
#: Words that a task counts before it passes its counts on.
COUNTED = 200_000
#: Share of the message's words that an echo must cover to repeat "most" of it.
MOST = 0.5

# --- fixed values: words of the four languages ---
_FUNCTION = {
    "en": "the and of to is it in that for with this on are be not have from you we when then yet because so before at by which as leaving today until if but only has".split(),
    "pl": "i w na z do nie że się jest to a jak po co tak ale o od przez dla gdy tylko oraz lub już potem tego więc bo nikt aż przed kiedy jednak żeby czy będzie".split(),
    "de": "der die das und ist nicht ein eine zu den von mit auf für im dem es sich auch nach bei noch nur wenn dann damit ohne weil trotzdem aber bis seit bitte wir beide".split(),
    "es": "el la de que y en los las por con para una un no es se del al lo como más pero sus ya o cuando tiene está sin antes hasta desde después porque solo".split(),
}
#: Further languages, told only by their function words.
_FURTHER = {
    "fr": "le la les des du un une et est dans pour avec sur que qui ne pas vous nous au aux ce cette avant après leur sont".split(),
    "it": "il lo gli le di che e è un una per con del della nel nella sono non si anche prima dopo più questo questa alla".split(),
    "pt": "o os as um uma de do da dos das e em no na para com não que se por mais antes depois ao à este esta são".split(),
    "nl": "de het een en van in op te dat is niet voor met zijn aan er maar om ook als bij naar deze dit wordt".split(),
}
_CONNECTORS = set(
    "and or but because of so that the a an to with for by from in on at which until before after while as if when than into its his their "
    "oraz i lub ale ponieważ bo żeby aby dla z ze w we na do od po przez przed który która że tak "
    "und oder aber weil damit für mit von zu der die das ein eine dem den im am bis nach bei ohne dass sowie "
    "y o u pero porque para con de del la el los las un una en por que sin hasta desde como e".split()
)
_ACK = set(
    "ok okay okej oki yes yep yeah sure thanks thank thx you great good perfect nice cool done fine right got it go ahead do that this please continue proceed carry on next looks lgtm agreed correct exactly no nope "
    "tak jasne dzięki dziękuję dobra dobrze super kontynuuj dalej zrób to proszę zgoda pewnie nie świetnie idź "
    "ja danke gut passt weiter mach bitte genau klar super prima einverstanden richtig nein los "
    "sí si gracias vale sigue adelante bien claro perfecto hazlo continúa de acuerdo no por favor".split()
)
_CUES = {
    "sorry": r"\b(?:sorry|apolog\w+|unfortunately|regret|przepraszam|przykro|niestety|wybacz\w*|leider|entschuldig\w+|tut mir leid|bedau\w+|lo siento|disculp\w+|por desgracia|lamento|lamentablemente|perdón)\b",
    "cannot": r"\b(?:can(?:not|'t|’t| not)|could not|unable|not able|not possible|isn'?t possible|impossible|not allowed|may not|nie (?:mogę|wolno|jestem w stanie|potrafię|mam dostępu|widzę|da się|podam)|kann (?:\w+ ){0,4}nicht|darf (?:\w+ ){0,4}nicht|nicht in der lage|keinen zugriff|no puedo|no me (?:está|es)|no tengo acceso|imposible|no (?:daré|voy))\b",
    "decline": r"\b(?:decline|refuse|won'?t|will not|would rather not|rather not|no goal will|odmawiam|odmówi\w*|nie będę|nie zamierzam|lehne|weigere|möchte (?:\w+ ){0,3}nicht|gebe (?:\w+ ){0,3}keine|keine auskunft|me niego|prefiero no|rechazo|ningún|keine? \w+ (?:geben|nennen))\b",
    "withheld": r"\b(?:(?:no|nothing) (?:\w+ )?will be (?:given|named|provided|said)|(?:have|having|got) no access|(?:nie podam|nie będzie podan\w+|wird nicht genannt|no se (?:dará|indicará)))\b",
    "policy": r"\b(?:guidelines?|policy|policies|comfortable|language model|as an ai|as a model|beyond (?:what|my)|outside (?:what|my)|permitted|supposed to|comply|model językowy|jako model|zasad\w*|wytyczn\w*|sprachmodell|richtlinien|modelo de lenguaje|como modelo|permitido|normas)\b",
    "self": r"\b(?:i|i'm|i’m|me|my|mi|mnie|mogę|jestem|mam|odmawiam|widzę|podam|ich|mir|meine|puedo|tengo|prefiero|siento|daré|soy)\b",
    "no": r"\b(?:no|not|nope|never|nothing|none|nor|off|out|nie|nigdy|nic|nein|nicht|nichts|kein\w*|nunca|nada|ni|tampoco)\b|\w+n[’']t\b",
    "help": r"\b(?:help|assist|answer|respond|reply|pomóc|odpowiada\w*|odpowiedzieć|helfen|beantworten|antworten|ayudar|responder|contestar)\b",
}
# --- end of fixed values ---
_CUE = {k: re.compile(v, re.I) for k, v in _CUES.items()}
_ANY_CUE = re.compile("|".join(f"(?:{v})" for v in _CUES.values()), re.I)
_TAG = re.compile(r"</?goal\s*/?>", re.I)
_OPEN, _CLOSE, _BROKEN = re.compile(r"<goal\s*>", re.I), re.compile(r"</goal\s*>", re.I), re.compile(r"<(?:/(?:g(?:o(?:a(?:l\s*)?)?)?)?|g(?:o(?:a(?:l\s*/?)?)?)?)?\s*$", re.I)
_QUOTED = re.compile(r"[“„«\"][^”“»\"\n]{1,120}[”“»\"]")
_CODE = re.compile(r"\S*[\d_/\\@#<>{}=$]\S*|\b\w+(?:-\w+){2,}\b|\b[a-z]+[A-Z]\w*|\b[A-Z]{2,}\w*\b|\b(?:[A-Z][a-z]+){2,}\b")
_CLAUSE = re.compile(r"(?<=[.!?;:,])\s+|\n+")
_WORDS = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")


_PLAIN: dict[str, tuple[str, ...]] = {}


def plain_words(text: str) -> list[str]:
    """Lower-case words of prose: no quoted names, code or numbers."""
    if len(_PLAIN) > 300_000:
        _PLAIN.clear()
    if any(c in text for c in "“„«\""):
        text = _QUOTED.sub(" ", text)
    out: list[str] = []
    for t in text.split():
        w = _PLAIN.get(t)
        if w is None:
            _PLAIN[t] = w = tuple(x.lower() for x in _LETTERS.findall(_CODE.sub(" ", t)))
        out += w
    return out


def states_task(w: list[str]) -> bool:
    """Whether a message of the lower-case words w asks for something; a mere acknowledgement doesn't."""
    return bool(w) and not (len(w) <= 5 and all(x in _ACK for x in w))


_SETS = {k: frozenset(v) for k, v in _FUNCTION.items()}
_FURTHER_SETS = {k: frozenset(v) for k, v in _FURTHER.items()}
_ALL_FURTHER = frozenset().union(*_FURTHER_SETS.values())


def sure_language(words: list[str]) -> str | None:
    """Language that the function words of a message tell, if they do."""
    hits = {k: sum(x in s for x in words) for k, s in _SETS.items()}
    top = max(hits, key=lambda k: (hits[k], k))
    return top if hits[top] >= 2 and sorted(hits.values())[-2] * 2 <= hits[top] else None


class Languages:
    """Words and letter triples of each language; scores are sums of log probabilities, the best language 0."""

    def __init__(self, words: dict[str, Counter]):
        """words: how often each word stands in messages of each language."""
        words = {k: Counter(words.get(k, {})) for k in _FUNCTION}
        counts = {k: Counter() for k in _FUNCTION}
        for k, v in _FUNCTION.items():
            for x in v:
                words[k][x] += 5
            for x, n in words[k].items():
                for g in self._grams(x):
                    counts[k][g] += n
        every = set().union(*counts.values())
        total = {k: sum(c.values()) + 0.1 * len(every) for k, c in counts.items()}
        self.log = {g: np.array([np.log((counts[k][g] + 0.1) / total[k]) for k in _FUNCTION]) for g in every}
        n = {k: sum(words[k].values()) + 1 for k in words}
        vocabulary = set().union(*words.values())
        self.word = {x: np.array([np.log((words[k][x] + 0.2) / n[k]) for k in _FUNCTION]) for x in vocabulary}
        self._place: dict[str, int] = {}
        self._rows = np.zeros((0, len(_FUNCTION)))

    def __getstate__(self):
        return self.__dict__ | {"_place": {}, "_rows": self._rows[:0]}

    @staticmethod
    def _grams(word: str) -> list[str]:
        w = f" {word} "
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def _of(self, x: str) -> np.ndarray:
        v = self.word.get(x)
        if v is None:
            g = [self.log[y] for y in self._grams(x) if y in self.log]
            v = sum(g) if g else np.zeros(len(_FUNCTION))
        return np.maximum(v - v.max(), -4.0)

    def score(self, w: list[str]) -> np.ndarray | None:
        """Log odds of the languages (in the order of _FUNCTION), the best 0; null for too little prose."""
        if not w:
            return None
        if len(self._place) > 300_000:
            self._place, self._rows = {}, self._rows[:0]
        get = self._place.get
        at = [get(x, -1) for x in w]
        if -1 in at:
            new = sorted({x for x, i in zip(w, at) if i < 0})
            self._place.update(zip(new, range(len(self._place), len(self._place) + len(new))))
            if len(self._place) > len(self._rows):
                self._rows = np.vstack([self._rows, np.zeros((max(1024, len(self._rows)) + len(new), len(_FUNCTION)))])
            for x in new:
                self._rows[self._place[x]] = self._of(x)
            at = [self._place[x] for x in w]
        s = self._rows[at].sum(axis=0)
        return s - s.max()

    def elsewhere(self, w: list[str], lang: int | None) -> bool:
        """Whether function words of a further language, or letters of another script, make up the words w."""
        k = list(_FUNCTION)[lang] if lang is not None else None
        own = _SETS[k] if k else frozenset()
        for further in _FURTHER_SETS.values() if not _ALL_FURTHER.isdisjoint(w) else ():
            hits = [x for x in w if x in further and x not in own]
            # words that the message's own language has at least as often tell nothing
            if len(hits) >= 2 and sum(k is None or x not in self.word or self.word[x].argmax() != lang for x in hits) * 4 >= max(8, len(w)):
                return True
        letters = "".join(w)
        return not letters.isascii() and sum(ord(c) > 0x24F for c in letters) * 2 > len(letters)


class Vocabulary:
    """How often words stand inside texts, where fragments don't stand, and at the end of answers."""

    def __init__(self, inside: dict[str, int], end: dict[str, int]):
        self.tables = []
        for own, every in ((inside, inside), (end, Counter(inside) + Counter(end))):
            words = sorted(every)
            self.tables.append((own, words, np.array([every[w] for w in words], np.int64)))
        self._seen: dict[str, tuple[int, int]] = {}

    def whole(self, word: str) -> tuple[int, int]:
        """How often a word stands inside texts, and at ends, against the most frequent word that it begins: bins of its
        logarithm, 0 never, 6 as often or more."""
        if word not in self._seen:
            if len(self._seen) > 300_000:
                self._seen.clear()
            bins = []
            for own, words, n in self.tables:
                lo, hi = bisect_left(words, word), bisect_right(words, word + "\U0010ffff")
                lo += lo < hi and words[lo] == word
                gap = np.log2((own.get(word, 0) + 0.5) / ((int(n[lo:hi].max()) if lo < hi else 0) + 0.5))
                bins.append(6 if gap >= 0 else 0 if word not in own else max(1, 6 + int(gap // 2)))
            self._seen[word] = tuple(bins)
        return self._seen[word]


def _letters(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def word_counts(rows: DataFrame) -> DataFrame:
    """kind, word, n over all rows: kind `inside` (of a message or answer), `end` (of an answer) or a language (of messages)."""
    load = ship(rows.sparkSession, (_letters, plain_words, sure_language, split_answer))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (letters, plain, language, split), n = load(), {}
        frame = lambda: pd.DataFrame([(k, w, x) for k, c in n.items() for w, x in c.items()], columns=["kind", "word", "n"])
        for b in batches:
            for m, *answers in zip(b["message"], b["goal"], b["student"]):
                m = m or ""
                words = plain(m)
                lang = language(words)
                bare = [split(a)[0] for a in answers if a]
                inside, end = n.setdefault("inside", Counter()), n.setdefault("end", Counter())
                inside.update(letters(m)[:-1])
                for a in bare:
                    w = letters(a)
                    inside.update(w[:-1])
                    end.update(w[-1:])
                if lang:
                    # the words of answers mostly belong to the language of the message
                    n.setdefault(lang, Counter()).update(words + [w for a in bare if len(a) < len(m) // 2 for w in plain(a)])
            if sum(map(len, n.values())) > COUNTED:
                yield frame()
                n.clear()
        yield frame()

    return rows.select("message", "goal", "student").mapInPandas(count, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def learned(counts: list[tuple[str, str, int]]) -> tuple[Languages, Vocabulary]:
    by: dict[str, Counter] = {}
    for k, w, n in counts:
        by.setdefault(k, Counter())[w] = n
    return Languages(by), Vocabulary(by.get("inside", {}), by.get("end", {}))


def split_answer(answer: str) -> tuple[str, bool]:
    """Text without tags, and whether a tag was opened and not closed."""
    opened = len(_OPEN.findall(answer)) > len(_CLOSE.findall(answer)) or (bool(_BROKEN.search(answer)) and "<" in answer)
    return _BROKEN.sub("", _TAG.sub(" ", answer)).strip(), opened


def clauses(text: str) -> list[str]:
    out = [c for c in (x.strip() for x in _CLAUSE.split(text)) if _WORDS.search(c)]
    merged: list[str] = []
    for c in out:  # one-word openings belong to what follows
        if merged and len(_WORDS.findall(merged[-1])) < 2:
            merged[-1] = f"{merged[-1]} {c}"
        else:
            merged.append(c)
    return merged


class Message:
    """What clauses are compared with."""

    def __init__(self, text: str, languages: Languages):
        self.words = _WORDS.findall(text.lower())
        self.set = set(self.words)
        s = languages.score(plain_words(text))
        self.lang = None if s is None or np.sort(s)[-2] > -2.0 else int(s.argmax())
        self.task = states_task(self.words)

    @cached_property
    def runs(self) -> set[tuple[str, ...]]:
        return set(zip(self.words, self.words[1:], self.words[2:]))

    def after(self, word: str) -> set[str]:
        """Words that follow a word."""
        return {b for a, b in zip(self.words, self.words[1:]) if a == word} if word in self.set else set()


def _bin(x: float) -> int:
    return min(5, int(x * 5.0001))


_ALL_FUNCTION = frozenset().union(*_SETS.values())


def features(parts: list[str], m: Message, languages: Languages, vocabulary: Vocabulary, opened: bool, ended: str) -> list[tuple[str, ...]]:
    out = []
    for i, c in enumerate(parts):
        low = c.lower()
        w = _WORDS.findall(low)
        runs = list(zip(w, w[1:], w[2:]))
        shared = sum(x in m.set for x in w) / len(w)
        run = sum(r in m.runs for r in runs) / len(runs) if runs else 0.0
        apart = not any(x in m.set for x in w if x not in _ALL_FUNCTION)  # no word of content from the message
        f = ["bias", f"shared={_bin(shared)}", f"run={_bin(run)}", f"len={min(4, len(w) // 4)}", f"longrun={len(runs) >= 4 and run > 0.6}", f"apart={apart}"]
        cues = [k for k, rx in _CUE.items() if rx.search(low)] if _ANY_CUE.search(low) else []
        f += [f"cue={k}" for k in cues]
        f += [f"cues={min(3, len([k for k in cues if k not in ('self', 'help', 'no')]))}", f"selfcue={'self' in cues and len(cues) > 1}"]
        f += [f"apart&{k}" for k in ("self", "no") if apart and k in cues]
        p = plain_words(c)
        s = languages.score(p)
        if languages.elsewhere(p, m.lang):
            lang = "far"
        elif s is None or m.lang is None:
            lang = "unknown"
        else:
            gap = -float(s[m.lang])
            lang = "same" if gap < 1 else "near" if gap < 4 else "other" if gap < 8 else "far"
        f += [f"lang={lang}", f"lang={lang}&apart={apart}", f"cues&lang={min(3, len(cues))},{lang in ('other', 'far')}"]
        last = i == len(parts) - 1
        f += [f"first={i == 0}", f"last={last}"]
        if last:
            tail = w[-1]
            follows = m.after(w[-2]) if len(w) > 1 else set()
            cut_phrase = tail not in follows and any(x.startswith(tail) for x in follows)
            f += [f"open={opened}", f"connector={tail in _CONNECTORS}", f"openconnector={opened and tail in _CONNECTORS}", f"cutphrase={cut_phrase}", f"end={ended}"]
            inside, end = (6, 6) if tail.isdigit() else vocabulary.whole(tail)
            f += [f"inside={inside}", f"ends={end}", f"whole={inside},{end}"]
        if len(m.words) <= 5:
            f.append("shortmessage")
        out.append(tuple(f))
    return out


_PARTS = {
    "en": (["Sorry, ", "I'm sorry, but ", "Unfortunately, ", "Apologies, ", "I must decline: ", "Note: ", "I am afraid ", ""],
           ["I cannot help with that", "I can't do this", "I am unable to read the files", "this is not something I may answer", "I won't answer this request", "I refuse to name a goal", "as a language model I have no access to the repository", "that would go against my guidelines", "it is not possible for me to comply", "I don't feel comfortable with this", "I would rather not say", "no answer will be given", "I have no access to your files", "I am not allowed to reply", "this is outside what I may do", "that is beyond my remit", "nothing will be named here", "no label will be given here", "no task will be given here", "no summary will be given", "no name will be given here", "no title will be provided", "no goal will be named", "I have no access to the settings page", "I must not say that", "I won't be able to assist with the report", "leave me out of this", "that is not for me to say", "nope, not this one", "I'd sooner pass on that", "not going into it", "none of my business here", "nothing from me on this", "I stay out of such things", "my answer is no", "we don't go near that"]),
    "pl": (["Przepraszam, ", "Przykro mi, ", "Niestety ", "Wybacz, ale ", "", "Uwaga: "],
           ["nie mogę w tym pomóc", "nie wolno mi na to odpowiadać", "nie jestem w stanie tego zrobić", "odmawiam odpowiedzi", "jako model językowy nie mam dostępu do plików", "nie podam celu", "nie będę tego opisywać", "nie widzę repozytorium", "nic ode mnie w tej sprawie", "to nie dla mnie"]),
    "de": (["Leider ", "Entschuldigung, ", "Tut mir leid, ", "", "Hinweis: "],
           ["kann ich dabei nicht helfen", "das darf ich nicht beantworten", "ich bin nicht in der Lage dazu", "dazu gebe ich keine Auskunft", "ich habe keinen Zugriff auf die Dateien", "als Sprachmodell kann ich das nicht", "das lehne ich ab", "ich möchte darauf nicht antworten", "da halte ich mich raus", "nichts für mich"]),
    "es": (["Lo siento, ", "Disculpa, ", "Por desgracia, ", "", "Nota: "],
           ["no puedo ayudar con eso", "no me está permitido responder", "prefiero no contestar", "como modelo de lenguaje no puedo abrir archivos", "no daré ningún objetivo", "no tengo acceso al repositorio", "me niego a responder", "no cuentes conmigo", "de eso no hablo yo"]),
}
#: Sound answers that speak of refusing, errors and access without being refusals, by language.
_SOUND = [
    ["Show why access is blocked", "Explain the refused upload", "Decline unsigned requests", "Refuse broken files", "Stop copying old invites", "Say when saving fails", "Handle cannot open errors", "Fix the sorry page", "Test the policy check", "Show why login is impossible", "Explain why it cannot start", "Turn off my alerts"],
    ["Pokaż powód odmowy dostępu", "Odrzuć niepodpisane pliki", "Wyjaśnij czemu nie działa"], ["Zeige warum der Zugriff fehlt", "Lehne alte Einladungen ab", "Erkläre warum es nicht startet"], ["Muestra por qué falla el acceso", "Rechaza archivos sin firma", "Explica por qué no arranca"],
]


class Tagger:
    def __init__(self, languages: Languages, vocabulary: Vocabulary, field: LinearChainCRF):
        self.languages, self.vocabulary, self.field = languages, vocabulary, field
        self._seen: dict[tuple, list[str]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}

    def tags(self, x: tuple[tuple[str, ...], ...]) -> list[str]:
        """Tags of a sequence of features; few sequences differ."""
        if x not in self._seen:
            if len(self._seen) > 100_000:
                self._seen.clear()
            self._seen[x] = self.field.tag(x)
        return self._seen[x]

    def defect(self, m: Message, answer: str | None) -> str | None:
        text, opened = split_answer(answer or "")
        if not _WORDS.search(text):
            return "empty" if m.task else None
        parts = clauses(text)
        tags = self.tags(tuple(features(parts, m, self.languages, self.vocabulary, opened, _ending(text))))
        size = [len(p) for p in parts]
        share = {t: sum(n for n, x in zip(size, tags) if x == t) / sum(size) for t in TAGS}
        w = [x.lower() for x in _WORDS.findall(text)]
        if share["refusal"] >= 0.5:
            return "refusal"
        echoed = [x for p, t in zip(parts, tags) if t == "echo" for x in (y.lower() for y in _WORDS.findall(p))]
        if m.words and echoed and share["echo"] >= 0.5:
            # of the message's words in runs that the answer repeats
            repeated = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
            n = len(m.words)
            covered = set()
            for i in range(n - 2):
                if tuple(m.words[i : i + 3]) in repeated:
                    covered |= {i, i + 1, i + 2}
            if n < 3:
                covered = set(range(n)) if m.words == w else set()
            if len(covered) > n * MOST:
                return "copy"
        if opened or (tags[-1] == "unfinished" and share["unfinished"] > 0):
            return "truncated"
        if share["foreign"] >= 0.5:
            return "language"
        return None


def _ending(text: str) -> str:
    t = text.rstrip()
    return "stop" if t[-1:] in ".!?" else "comma" if t[-1:] in ",;:-–" else "ellipsis" if t.endswith("…") else "word"


def train(rows: list[tuple[str | None, str | None, str | None]], languages: Languages, vocabulary: Vocabulary) -> Tagger:
    """rows: message, goal, student. Fits the field on their sound answers and on damaged ones."""
    rng = random.Random(SEED)
    good: list[tuple[Message, str, str]] = []
    for m, g, s in rows:
        if not m or not (msg := Message(m, languages)).task:
            continue
        for a in (g, s):
            text, opened = split_answer(a or "")
            w = _WORDS.findall(text)
            cue = [k for k, rx in _CUE.items() if rx.search(text) and k not in ("self", "help", "no")]
            sc = languages.score(plain_words(text))
            alike = sc is not None and msg.lang is not None and sc[msg.lang] > -3
            if not opened and 2 <= len(w) <= 9 and not cue and alike and w[-1].lower() not in _CONNECTORS and any(x.lower() in msg.set for x in w if x.lower() not in _ALL_FUNCTION):
                good.append((msg, m, text))
    rng.shuffle(good)
    x, y = [], []

    def add(m: Message, text: str, opened: bool, label) -> None:
        parts = clauses(text)
        if parts:
            x.append(features(parts, m, languages, vocabulary, opened, _ending(text)))
            y.append(label(parts))

    by_lang: dict[int, list[str]] = {}
    for m, _, t in good:
        if m.lang is not None:
            by_lang.setdefault(m.lang, []).append(t)
    whole = lambda tag: lambda p: [tag] * len(p)
    tail = lambda p: ["answer"] * (len(p) - 1) + ["unfinished"]
    for m, message, t in islice(cycle(good), TRAINING):  # few rows are damaged several times
        add(m, t, False, whole("answer"))
        kind = rng.choice((0, 0, 1, 2, 3, 3, 3, 4, 5, 6))
        lead, rest = _PARTS[rng.choice(list(_PARTS))]
        if kind == 0:
            r = rng.choice(lead) + rng.choice(rest)
            if rng.random() < 0.3:  # what it won't speak of is named
                i = rng.randrange(max(1, len(m.words) - 2))
                r += " " + rng.choice(["about the ", "to the ", "", "über ", "o ", "de "]) + " ".join(m.words[i : i + rng.choice((1, 2))])
            r += rng.choice(["", ".", "!"])
            add(m, r[:1].upper() + r[1:], False, whole("refusal"))
        elif kind == 1:
            cutoff = message if rng.random() < 0.6 else message[: int(len(message) * rng.uniform(0.6, 0.95))]
            if rng.random() < 0.3:  # written otherwise
                cutoff = rng.choice([cutoff.upper(), cutoff.lower(), re.sub(r"[,.;:]", "", cutoff), re.sub(r"\s", "  ", cutoff), cutoff.replace("e", "ee", 2)])
            add(m, rng.choice(["", "", "Q: ", "Task: ", "> ", "“"]) + cutoff, rng.random() < 0.1, whole("echo"))
        elif kind == 2 and len(by_lang) > 1 and m.lang in by_lang:
            other = rng.choice([k for k in by_lang if k != m.lang])
            add(m, rng.choice(by_lang[other]), False, whole("foreign"))
        elif kind == 3 and len(t) > 8:
            opened = rng.random() < 0.5
            # an answer that ends with a whole word and isn't open can't be told from a sound one
            within = [i for i in range(4, len(t) - 1) if opened or t[i - 1].isalpha() and t[i].isalpha()]
            if within:
                add(m, t[: rng.choice(within)].rstrip(), opened, tail)
        elif kind == 4:
            end = {0: ["because of", "so that the", "and the", "for", "before the", "first, the"], 1: ["ponieważ", "oraz", "tak, żeby", "dla", "bo"], 2: ["weil", "damit die", "und das", "für", "so, dass"], 3: ["porque", "para que", "y el", "con", "así, que"]}
            add(m, f"{t} {rng.choice(end[m.lang or 0])}", rng.random() < 0.5, tail)
        elif kind == 6:  # shorter and still sound: its last word mostly stands inside answers
            w = t.split()
            k = rng.randint(2, max(2, len(w) - 1))
            if w[k - 1 : k] and w[k - 1].isalpha() and w[k - 1].lower() not in _CONNECTORS | _ALL_FUNCTION:
                add(m, " ".join(w[:k]), False, whole("answer"))
        else:
            sound = rng.choice(_SOUND[m.lang or 0])  # of a message that speaks of it
            add(Message(f"{message} {sound.lower()}", languages), sound, False, whole("answer"))
    if not x:
        m = Message("Please fix the login form in the app today", languages)
        add(m, "Fix the login form", False, whole("answer"))
        add(m, "Sorry, I cannot help with that", False, whole("refusal"))
    return Tagger(languages, vocabulary, LinearChainCRF(TAGS, l2=1e-4, epochs=40, rate=0.25).fit(x, y))


def fit(predictions: DataFrame, sample: int = SAMPLE) -> Tagger:
    counts = cut(word_counts(predictions))
    least = counts.groupBy("kind").agg((F.sum("n") * COMMON).alias("_least"))  # a row for each language
    known = counts.join(F.broadcast(least), "kind").where((F.col("n") >= F.col("_least")) & (F.col("n") > 1))
    languages, vocabulary = learned([tuple(r) for r in known.select("kind", "word", "n").toLocalIterator()])
    total = max(1, predictions.count())
    pick = predictions.where(F.col("message").isNotNull() & (F.pmod(F.xxhash64("pred_id"), F.lit(1_000_000)) < F.lit(1_000_000 * sample / total)))
    rows = sorted(pick.select("pred_id", "message", "goal", "student").limit(sample).collect(), key=lambda r: (r["pred_id"] is None, r["pred_id"]))
    return train([(r["message"], r["goal"], r["student"]) for r in rows], languages, vocabulary)


def defects(predictions: DataFrame, tagger: Tagger) -> DataFrame:
    """pred_id, field_name, defect of each defective answer."""
    load = ship(predictions.sparkSession, tagger)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = load()
        for b in batches:
            out = []
            for i, message, goal, student in zip(b["pred_id"], b["message"], b["goal"], b["student"]):
                m = Message(message or "", t.languages)
                out += [(i, f, d) for f, a in (("goal", goal), ("student", student)) if (d := t.defect(m, a))]
            yield pd.DataFrame(out, columns=["pred_id", "field_name", "defect"])

    rows = predictions.where("pred_id is not null").select(F.col("pred_id").cast("long").alias("pred_id"), "message", "goal", "student")
    return rows.mapInPandas(check, "pred_id long, field_name string, defect string")


def found(predictions: DataFrame) -> DataFrame:
    return defects(predictions, fit(predictions)).distinct()


def report(predictions: DataFrame) -> DataFrame:
    """field_name, defect, n."""
    return found(predictions).groupBy("field_name", "defect").agg(F.count(F.lit(1)).alias("n"))
