"""Rules for what model layers return: cut, cleaned, judged and scored before it joins the other layers.

Models are injected as functions text -> spans; their word lists are parameters, empty by default.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from inkveil.functions.language import SAMPLE
from inkveil.operators.firms import has_form
from inkveil.operators.spans import Span

# Lengths below which an entity is none, titles that end no name, and scores.
LEAST_LENGTH = {"PERSON": 3, "ORG": 2, "LOCATION": 2, "DATE": 4, "ADDRESS": 3, "UNKNOWN": 3}
BASE = {"PERSON": 0.80, "ORG": 0.40, "LOCATION": 0.25, "ADDRESS": 0.55}
TIERS = (("_trf", 0.08, 0.98), ("_lg", 0.03, 0.95))
_DIGITS = re.compile(r"^[\d\s.,;:\-/]+$")


@dataclass(frozen=True)
class ModelRules:
    """What one language's model needs: words before names, titles after them, words that are no names; and its scores."""

    articles: tuple[str, ...] = ("the ", "The ", "a ", "A ", "an ", "An ")
    firm_prefixes: tuple[str, ...] = ()
    titles: frozenset[str] = frozenset()
    no_person: frozenset[str] = frozenset()
    no_firm: frozenset[str] = frozenset()
    generic: frozenset[str] = frozenset()
    forms: frozenset[str] = frozenset()
    base: dict[str, float] = field(default_factory=lambda: BASE)
    person_cap: float = 0.95
    long_firm_cap: float = 0.80
    single_person: float = 0.20
    single_firm_floor: float = 0.25
    tiers: tuple[tuple[str, float, float], ...] = TIERS


def cleaned(text: str, kind: str, rules: ModelRules) -> str:
    """The first line of an entity without a leading article, of a firm without words for a firm, of a person without titles after two names."""
    line = text[: text.find("\n")] if text.find("\n") > 0 else text
    out = line.strip()
    out = next((out[len(a) :].strip() for a in rules.articles if out.startswith(a)), out)
    if kind == "ORG":
        out = next((out[len(p) :].strip() for p in rules.firm_prefixes if out.lower().startswith(p.lower())), out)
    if kind == "PERSON" and rules.titles:
        words = out.split()
        while len(words) > 2 and words[-1].lower() in rules.titles:
            words.pop()
        out = " ".join(words)
    return out


def score(text: str, kind: str, rules: ModelRules, model: str = "") -> float:
    """Confidence by type and number of words; larger models gain a little."""
    n = len(text.split())
    out = rules.base.get(kind, 0.40)
    if kind == "PERSON":
        out = min(out + 0.08, rules.person_cap) if n >= 2 else max(out - rules.single_person, 0.40) if n == 1 else out
    elif kind == "ORG":
        if n >= 2:
            out = min(out + 0.15, 0.80)
        if n >= 3:
            out = min(out + 0.05, rules.long_firm_cap)
        if n == 1:
            out = max(out - 0.15, rules.single_firm_floor)
    elif kind == "LOCATION" and n == 1:
        out = max(out - 0.10, 0.30)
    for suffix, gain, cap in rules.tiers:
        if model.endswith(suffix):
            return round(min(out + gain, cap), 4)
    return round(out, 4)


def no_person(text: str, rules: ModelRules, capitals: bool = False) -> bool:
    """Whether an entity is no person: a stop word, an abbreviation, something with a digit first, one short
    word. capitals: names must be capitalised too, and are none if all their words are stop words."""
    t, words = text.strip(), text.split()
    plain = t.lower() in rules.no_person or (text.isupper() and len(text) <= 5) or t[:1].isdigit() or (len(words) == 1 and len(words[0]) <= 3)
    if plain or not capitals:
        return plain
    return bool(_DIGITS.match(t)) or (len(words) >= 2 and all(w.lower() in rules.no_person for w in words)) or (t == t.lower() and len(words) <= 3)


def no_firm(text: str, rules: ModelRules, capitals: bool = False) -> bool:
    """Whether an entity is no firm: a stop word, an abbreviation, a number, small letters. capitals: numbered firms
    with a legal form stay, and one short word or stop words alone are none."""
    t, words = text.strip(), text.split()
    low = t.lower()
    if low in rules.no_firm or (low in rules.generic and not capitals) or len(t) <= 2 or (t.isupper() and len(t) <= 4) or (t == low and len(words) <= 2):
        return True
    if not capitals:
        return t[:1].isdigit()
    return bool(_DIGITS.match(t)) or (t[:1].isdigit() and not has_form(t)) or (len(words) == 1 and len(words[0]) <= 3) or (len(words) >= 2 and all(w.lower() in rules.no_firm for w in words))


def zero_shot_noise(text: str, kind: str, rules: ModelRules) -> bool:
    """Whether an entity of a zero-shot model is noise: too short, a short number, a stop word or legal form alone,
    a firm without any word that is capitalised, longer than two letters and none of these."""
    t, words = text.strip(), text.split()
    low = t.lower()
    if len(t) < 2 or (t.isdigit() and len(t) < 5) or low in rules.generic or low in rules.forms or (len(words) == 1 and len(words[0]) <= 2):
        return True
    if kind != "ORG":
        return False
    if len(words) == 1:
        return low in rules.no_firm
    return not any(w[0].isupper() and len(w) > 2 and w.lower() not in rules.generic | rules.no_firm | rules.forms for w in words)


def entities(found: Iterable[Span], rules: ModelRules, model: str = "", source: str = "NER") -> list[Span]:
    """Spans of a model, cleaned, without what is none, with scores of their own for models that give none.

    source: NER (a statistical pipeline), BERT or GLINER, whose spans keep their scores."""
    out = []
    for s in found:
        if source == "GLINER":
            if not zero_shot_noise(s.text, s.kind, rules):
                out.append(s)
            continue
        text = cleaned(s.text, s.kind, rules) if source == "NER" else s.text.strip()
        strict = source == "BERT"
        if len(text) < LEAST_LENGTH.get(s.kind, 2) or text.isdigit() or (text.isupper() and len(text) <= 5 and not strict):
            continue
        if (s.kind == "PERSON" and no_person(text, rules, strict)) or (s.kind == "ORG" and no_firm(text, rules, strict)) or (not strict and text.lower() in rules.generic):
            continue
        at = s.start + max(0, s.text.find(text))
        out.append(Span(at, at + len(text), text, s.kind, s.confidence if strict else score(s.text.strip(), s.kind, rules, model)))
    return out


def is_language(text: str, stop_words: frozenset[str], threshold: float, short: bool = False) -> bool:
    """Whether at least that share of the words of a text's beginning are stop words; `short` for texts of under twenty words."""
    words = [w for w in (x.lower().strip(".,;:!?()[]{}\"'") for x in text[:SAMPLE].split()) if len(w) >= 2]
    return sum(map(stop_words.__contains__, words)) >= threshold * len(words) if len(words) >= 20 else short


def choose(models: dict[str, Callable], language: str, preferred: str | None = None) -> Callable | None:
    """The model to run: the preferred one if it is there, else that of the language, else the English one."""
    return models.get(preferred or "") or models.get(language) or models.get("en")
