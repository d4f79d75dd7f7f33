"""Predicates and parsers over messages, goals and decisions: Column -> Column, all built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import collapse_ws, trim_ws

# --- fixed values ---
NO_TASK = (
    "ok", "okay", "okej", "tak", "yes", "no", "nie", "continue", "kontynuuj", "dalej", "go ahead", "proceed", "carry on", "keep going", "yes continue", "ok continue", "okay continue", "okej kontynuuj", "tak kontynuuj",
    "yes do that", "ok do that", "okay do that", "okej zrób to", "tak zrób to", "do it", "zrób to", "sounds good", "looks good", "that works", "perfect", "great", "super", "fine", "agreed", "zgoda", "jasne", "dobrze",
    "got it", "understood", "rozumiem", "thanks", "thank you", "dzięki", "dziekuje", "dziękuję", "hi", "hello", "hey", "hej", "ready", "gotowe",
)
SECRET_MARKERS = ("[masked:", "authorization: bearer", "begin private key", "begin rsa private key", "github_pat_", "gho_", "sk-ant-", "sk-proj-", "_agent_auth_secret", "api_key=", "token=")
SYNTHETIC_PREFIXES = (
    "you are a strict gate that", "<system-reminder>", "on your first completion attempt", "decide whether the user message below", "you translate developer-tool ui strings", "use the read tool", "use bash to run exactly",
    "use the monitor tool", "use the notebookedit tool", "use the edit tool",
)
CLASSIFIER_PREFIX = r"^you are \w+'s prompt-to-goal classifier"
SYNTHETIC_FRAGMENT = "api validation error:"
UNAUTHORED_PREFIXES = ("<system", "kontynuuj dokładnie przerwaną pracę", "you are a strict gate", "on your first completion attempt", "use the read tool", "use bash to run exactly", "api validation error:")
UNAUTHORED_FRAGMENTS = ("skip to content", "begin private key", "authorization: bearer", "[masked:", "claude-code-hint", "<system-reminder>", "<system-notice>", "github_pat_", "sk-ant-", "sk-proj-")
GENERIC_GOALS = ("continue the requested task", "complete the requested fix", "fix the issue", "complete the requested change", "continue the task", "add the requested change", "identify the problem", "select option 1", "answer yes or no")
COMPLETION_WORDS = ("commit", "complete", "done", "finished", "installed", "subagent_notification", "success", "working", "good", "great", "no limit", "looks good")
OPEN_WORDS = ("failed", "improve", "open", "pending", "research", "retry", "status", "still", "wrong")
ANCHOR = r"https?://\S+|\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b|\b\d[\d.,:/%-]*\b"
MESSAGE_CHARS, AUTHORED_CHARS, AUTHORED_LINES, AUTHORED_WORDS, AUTHORED_SHARE = (3, 4000), (20, 2000), 8, 4, 65
GOAL_WORDS, GOAL_CHARS, STYLE_RATIO = (3, 7), 100, (0.65, 2.5)
# --- end of fixed values ---
PUNCTUATION = r"""!-/:-@\[-`{-~"""


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_any(c: Column, words) -> Column:
    return any_of(F.contains(c, F.lit(w)) for w in words)


def starts_with_any(c: Column, words) -> Column:
    return any_of(F.startswith(c, F.lit(w)) for w in words)


def obvious_no_task(c: Column) -> Column:
    """Whether a message is one of the mere acknowledgements, apart from case, edge punctuation and runs of blanks."""
    edges = F.regexp_replace(F.lower(trim_ws(c)), rf"(?U)^[\s{PUNCTUATION}]+|[\s{PUNCTUATION}]+$", "")
    return collapse_ws(edges).isin(*NO_TASK)


def safe_message(c: Column) -> Column:
    t = trim_ws(c)
    return F.length(t).between(*MESSAGE_CHARS) & ~F.startswith(t, F.lit("/")) & ~contains_any(F.lower(t), SECRET_MARKERS)


def task_message(c: Column) -> Column:
    low = F.lower(trim_ws(c))
    return safe_message(c) & ~starts_with_any(low, SYNTHETIC_PREFIXES) & ~low.rlike(CLASSIFIER_PREFIX) & ~F.contains(low, F.lit(SYNTHETIC_FRAGMENT))


def line_count(c: Column) -> Column:
    """Lines as read from text: a final line end opens no further line."""
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(F.regexp_replace(c, r"\r?\n$", ""), "\n")))


def likely_authored(c: Column) -> Column:
    t = trim_ws(c)
    low = F.lower(t)
    letters = F.size(F.filter(F.split(collapse_ws(c), " "), lambda w: w.rlike(r"\p{L}")))
    meaningful = F.length(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}\s]", ""))
    return (
        F.length(t).between(*AUTHORED_CHARS) & (line_count(t) <= AUTHORED_LINES) & ~F.startswith(t, F.lit("/")) & ~starts_with_any(low, UNAUTHORED_PREFIXES) & ~contains_any(low, UNAUTHORED_FRAGMENTS)
        & (letters >= AUTHORED_WORDS) & (F.floor(meaningful * 100 / F.length(t)) >= AUTHORED_SHARE)
    )


def generic_goal(c: Column) -> Column:
    return F.lower(c).isin(*GENERIC_GOALS)


def parse_goal(c: Column) -> Column:
    """Struct (kind, goal): kind no_task, task or rejected."""
    t = trim_ws(c)
    inner = F.regexp_replace(collapse_ws(F.regexp_extract(t, r"(?s)<goal>(.*?)</goal>", 1)), r"\.+$", "")
    n = F.when(trim_ws(inner) == "", F.lit(0)).otherwise(F.size(F.split(trim_ws(inner), " ")))
    kind = F.when(t.isin("<goal/>", "<goal></goal>"), F.lit("no_task")).when(t.rlike(r"(?s)<goal>.*?</goal>") & n.between(*GOAL_WORDS) & (F.length(inner) <= GOAL_CHARS), F.lit("task")).otherwise(F.lit("rejected"))
    kind = F.when(c.isNull(), F.lit("rejected")).otherwise(kind)
    return F.struct(kind.alias("kind"), F.when(kind == "task", inner).alias("goal"))


def anchors(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(ANCHOR), F.lit(0)))


def valid_source(target: Column, source: Column) -> Column:
    """Whether source may stand for target: not equal, of like length, with all links, addresses and numbers kept."""
    t, s = trim_ws(target), trim_ws(source)
    ratio = F.length(s) / F.greatest(F.lit(1), F.length(t))
    return (s != "") & (s != t) & ratio.between(*STYLE_RATIO) & (F.size(F.array_except(anchors(t), anchors(s))) == 0)


def keyword_negative(text: Column, words) -> Column:
    return contains_any(F.lower(text), words)


def parse_answer(answer: Column, values: list[str]) -> Column:
    """Struct (value, exact): the allowed value an answer names, by itself or as the only one inside a sentence."""
    clean = F.regexp_replace(F.trim(answer), r"""(?U)^["'`.\s]+|["'`.\s]+$""", "")
    allowed = F.array(*[F.lit(v) for v in values])
    same = F.filter(allowed, lambda v: F.lower(v) == F.lower(clean))
    inside = F.filter(allowed, lambda v: F.contains(F.lower(answer), F.lower(v)))
    value = F.when(F.size(same) > 0, same[0]).when(F.size(inside) == 1, F.get(inside, F.lit(0)))
    return F.struct(value.alias("value"), (F.size(same) > 0).alias("exact"))


def first_json_object(c: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def strip_fence(c: Column) -> Column:
    return F.regexp_replace(trim_ws(c), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")


def kebab(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(trim_ws(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def directory_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "--"), r"^-+|-+$", "")


def name_ok(c: Column) -> Column:
    return c.rlike(r"^[a-z0-9][a-z0-9_-]*$")


def source_ok(c: Column) -> Column:
    return c.rlike(r"^(manual|human|model|brama)(:[A-Za-z0-9._/-]+)?$")


def message_features(c: Column) -> list[Column]:
    """The lifecycle features of a single message."""
    low = F.lower(c)
    n = F.when(trim_ws(c) == "", F.lit(0)).otherwise(F.size(F.split(collapse_ws(c), " ")))
    return [
        n.alias("word_count"), (n <= 12).alias("is_short_prompt"), F.contains(c, F.lit("?")).alias("is_question"), contains_any(low, ("status", "progress", "what happened")).alias("has_status"),
        contains_any(low, ("wrong", "instead", "do not", "don't")).alias("has_correction"), contains_any(low, ("done", "finished", "thanks", "thank you")).alias("has_completion"),
    ]


#: Kinds of made messages whose flags follow from the kind.
FINISHED_WORDS = ("done", "finished", "completed", "skończ", "zakończ")


def lifecycle_features(c: Column) -> list[Column]:
    """All nine features of a message that opens a session with a new objective."""
    word_count, short, question, status, correction, completion = message_features(c)
    return [F.lit(0).alias("turn_index"), F.lit(True).alias("is_first_turn"), word_count, short, question, F.lit(True).alias("has_new_objective"), status, correction, completion]


def feature_flags(c: Column, family: Column, turn_index: Column) -> list[Column]:
    """All nine features of a message made for a family at a later turn: the family sets what its words can't."""
    word_count, short, question, *_ = message_features(c)
    finished = family.startswith("finish_") | (family == "completion_negative") | contains_any(F.lower(c), FINISHED_WORDS)
    return [
        turn_index.alias("turn_index"), F.lit(False).alias("is_first_turn"), word_count, short, question, (family == "start_switch").alias("has_new_objective"), family.startswith("ignore_").alias("has_status"),
        (family == "continue_correction").alias("has_correction"), finished.alias("has_completion"),
    ]


def strict_decision_ok(answer: Column, legacy_title: bool = False) -> Column:
    """Contract of a decision as text: an object of exactly the four string keys; a title only at a start, where the old
    form of three to seven words is let through if legacy_title is set. Refs aren't compared with candidates."""
    v = F.try_parse_json(first_json_object(trim_ws(answer)))
    keys = F.schema_of_variant(v) == "OBJECT<action: STRING, goal_ref: STRING, lifecycle_evidence: STRING, title: STRING>"
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    d = F.struct(*[get(k).alias(k) for k in ("action", "goal_ref", "lifecycle_evidence", "title")])
    words = F.when(trim_ws(d["title"]) == "", F.lit(0)).otherwise(F.size(F.split(collapse_ws(d["title"]), " ")))
    title = F.when(d["action"] == "startGoal", (words == 0) | (words.between(3, 7) & F.lit(legacy_title))).otherwise(d["title"] == "")
    return F.coalesce(keys & decision_ok(d) & title, F.lit(False))


def existing_refs(candidates: Column) -> Column:
    """Refs that an answer may name for this request: those of its candidates, without the one for a new goal."""
    return F.filter(F.transform(candidates, lambda c: c["ref"]), lambda r: r != "NEW_GOAL")


def one_message(messages: Column, role: str) -> Column:
    """Content of the only message of a role; null where there is none or more than one."""
    of = F.filter(messages, lambda m: m["role"] == role)
    return F.when(F.size(of) == 1, of[0]["content"])


def rejection_reason(target: Column, source: Column) -> Column:
    """Why source can't stand for target (see valid_source): the first of blank, same, length and anchors; null if it can."""
    t, s = trim_ws(target), trim_ws(source)
    ratio = F.length(s) / F.greatest(F.lit(1), F.length(t))
    lost = F.size(F.array_except(anchors(t), anchors(s))) > 0
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("blank")).when(s == t, F.lit("same")).when(~ratio.between(*STYLE_RATIO), F.lit("length")).when(lost, F.lit("anchors"))


def decision_ok(d: Column, refs: Column | None = None) -> Column:
    """Contract of a decision struct (action, goal_ref, lifecycle_evidence); refs restricts goal_ref where given."""
    a, r, e = d["action"], d["goal_ref"], d["lifecycle_evidence"]
    ok = a.isin("startGoal", "continueCurrent", "finishGoal", "ignore") & r.isNotNull() & e.isin("none", "explicit_open", "explicit_completion")
    ok = ok & ((a == "startGoal") == (r == "NEW_GOAL")) & ((a == "finishGoal") == (e == "explicit_completion"))
    if refs is not None:
        ok = ok & F.array_contains(F.concat(refs, F.array(F.lit("NEW_GOAL"))), r)
    return F.coalesce(ok, F.lit(False))


# --- fixed values ---
POLISH_WORDS = (
    "aplikacje", "aplikacji", "czemu", "czy", "dlaczego", "gdzie", "jakie", "ktore", "ktory", "mamy", "moj", "nasz", "naszego", "naszych", "przed", "prosze", "sie", "sprawdz", "zamknelo", "znalezc", "zrestartowalo",
)
POLISH_SIGNS = "[ąćęłńóśźż]"
IDENTIFIER = r"\b[A-Z][A-Z0-9.+-]{1,}\b"
# --- end of fixed values ---


def is_polish(c: Column) -> Column:
    """Two or more of the words, repeats counted, or a letter that only Polish has."""
    low = F.lower(c)
    w = F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0))
    return (F.size(F.filter(w, lambda x: x.isin(*POLISH_WORDS))) >= 2) | low.rlike(POLISH_SIGNS)


def lost_identifiers(message: Column, answer: Column) -> Column:
    """Identifiers in capitals that a message holds and its answer doesn't, in order."""
    every = F.array_distinct(F.regexp_extract_all(message, F.lit(IDENTIFIER), F.lit(0)))
    return F.array_sort(F.filter(every, lambda x: ~F.contains(answer, x)))
