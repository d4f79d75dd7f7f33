"""Job specs: a YAML file checked key by key, and the flow from spec to split, model and report."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

EVAL_FRACTION, EVAL_SEED, MAX_FRACTION = 0.2, 20260808, 0.5


#: Names of the text classifier; other models aren't trained here.
BACKENDS = ("tfidf-logreg", "tfidf")


class SpecError(ValueError):
    pass


def backend(model: str) -> str:
    """The backend of a model's name; unknown ones are refused."""
    if model not in BACKENDS:
        raise SpecError(f"'{model}' isn't a model of this engine (known: {', '.join(BACKENDS)})")
    return BACKENDS[0]


@dataclass
class Scope:
    aspect: str
    runtimes: list[str] | None = None
    since: str | None = None
    values: list[str] | None = None
    min_text_chars: int = 0


@dataclass
class Job:
    name: str
    task: str
    evaluator: str
    model: str
    scope: Scope
    split: tuple[float, int] | None = (EVAL_FRACTION, EVAL_SEED)
    judge: str | None = "default"
    raw: dict = field(default_factory=dict)


def parse_since(raw: str) -> str | None:
    """UTC instant of an ISO date or date and time, with or without offset; null when unreadable."""
    try:
        t = datetime.fromisoformat(str(raw).strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).isoformat(timespec="seconds")


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise SpecError(message)


def _known(mapping: dict, allowed: set[str], where: str) -> None:
    extra = sorted(str(k) for k in mapping if k not in allowed)
    _need(not extra, f"unknown {where} field(s): {', '.join(extra)}")


def _text(mapping: dict, key: str) -> str:
    v = mapping.get(key)
    _need(isinstance(v, str) and bool(v.strip()), f"'{key}' must be a non-empty string")
    return v.strip()


def _list(mapping: dict, key: str) -> list[str] | None:
    v = mapping.get(key)
    if v is None:
        return None
    _need(isinstance(v, list) and bool(v) and all(isinstance(x, str) and x.strip() for x in v), f"scope.{key} must be a non-empty list of strings")
    return [x.strip() for x in v]


def job_from(raw: dict) -> Job:
    _need(isinstance(raw, dict), "a job spec must be a mapping")
    _known(raw, {"name", "task", "evaluator", "model", "scope", "eval_split", "judge"}, "job")
    name, evaluator = _text(raw, "name"), _text(raw, "evaluator")
    _need(bool(re.fullmatch(r"[a-z0-9][a-z0-9_-]*", name)), f"'{name}' isn't a job name")
    _need(bool(re.fullmatch(r"(manual|human|model|brama)(:[A-Za-z0-9._/-]+)?", evaluator)), f"'{evaluator}' isn't an evaluator")
    s = raw.get("scope")
    _need(isinstance(s, dict), "'scope' must be a mapping")
    _known(s, {"aspect", "runtimes", "since", "values", "min_text_chars"}, "scope")
    since = s.get("since")
    if since is not None:
        since = parse_since(since)
        _need(since is not None, "scope.since must be an ISO date or time")
    least = s.get("min_text_chars", 0)
    _need(isinstance(least, int) and not isinstance(least, bool) and least >= 0, "scope.min_text_chars must be a non-negative integer")
    scope = Scope(_text(s, "aspect"), _list(s, "runtimes"), since, _list(s, "values"), least)
    e = raw.get("eval_split", True)
    split: tuple[float, int] | None = (EVAL_FRACTION, EVAL_SEED)
    if e is False:
        split = None
    elif e not in (None, True):
        _need(isinstance(e, dict), "'eval_split' must be a mapping, true or false")
        _known(e, {"fraction", "seed"}, "eval_split")
        fraction, seed = e.get("fraction", EVAL_FRACTION), e.get("seed", EVAL_SEED)
        _need(isinstance(fraction, (int, float)) and not isinstance(fraction, bool) and 0 < fraction <= MAX_FRACTION, f"eval_split.fraction must be greater than 0 and at most {MAX_FRACTION}")
        _need(isinstance(seed, int) and not isinstance(seed, bool) and seed >= 0, "eval_split.seed must be a non-negative integer")
        split = (float(fraction), seed)
    j = raw.get("judge", True)
    judge: str | None = "default"
    if j is False:
        judge = None
    elif j not in (None, True):
        _need(isinstance(j, dict), "'judge' must be a mapping, true or false")
        _known(j, {"model"}, "judge")
        judge = _text(j, "model") if "model" in j else "default"
    return Job(name, _text(raw, "task"), evaluator, _text(raw, "model"), scope, split, judge, raw)


def load(path: str) -> Job:
    import yaml

    with open(path, encoding="utf-8") as f:
        return job_from(yaml.safe_load(f))
