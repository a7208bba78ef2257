"""The span detectors and the sweeps over spans of one page: plain functions that kernels call.

A span is (start, end, text, type, confidence); ends are exclusive, offsets are code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from inkveil.functions.language import language_py
from inkveil.functions.validators import accepted
from inkveil.lexicon.patterns import EXCLUDED, LABELLED, STANDALONE, VALUE
from inkveil.lexicon.words import CONTEXT, PHONE_LABELS
from inkveil.operators.firms import firm_noise
from inkveil.operators.noise import Lexicon, person_noise, place_noise
from inkveil.operators.prefilter import Prefilter, fold

WINDOW, BOOST, PHONE_PENALTY, MARGIN = 100, 0.25, 0.15, 0.20


class Span(NamedTuple):
    start: int
    end: int
    text: str
    kind: str
    confidence: float


@dataclass(frozen=True)
class Custom:
    """A user pattern: a regular expression, or parts of a template (kind, count, value)."""

    pattern: str
    kind: str = "CUSTOM"
    confidence: float = 0.85
    case_sensitive: bool = False
    enabled: bool = True


@dataclass(frozen=True)
class Config:
    """Settings of one run, passed as a value."""

    language: str | None = None  # None or "auto": detect
    allowed: frozenset[str] | None = None
    #: Types that model layers may give (None or empty: all), and pattern types ticked (None: all): the others go from all layers.
    model_types: frozenset[str] | None = None
    pattern_types: frozenset[str] | None = None
    custom: tuple[Custom, ...] = ()
    threshold: float = 0.55
    keep_custom: bool = False
    min_chars: int = 30
    names: frozenset[str] = field(default_factory=frozenset)
    lexicon: Lexicon = field(default_factory=Lexicon)


def template_pattern(parts: list[tuple[str, int, str]]) -> str:
    """A regular expression from template parts; unknown parts are left out."""
    from inkveil.functions.text import TEMPLATE_PARTS

    out = []
    for part, count, value in parts:
        if part in TEMPLATE_PARTS:
            out.append(TEMPLATE_PARTS[part] + (f"{{{count}}}" if count > 1 else ""))
        elif part in ("literal", "separator"):
            out.append(re.escape(value))
    return "".join(out)


def _keywords(listed: list[str]) -> re.Pattern:
    words = sorted(set(listed), key=lambda w: (-len(w), w))
    return re.compile(r"(?:^|(?<=\W))(?:" + "|".join(map(re.escape, words)) + r")(?:$|(?=\W))", re.IGNORECASE)


_flag = {"": 0, "i": re.IGNORECASE}
_STANDALONE = [(re.compile(p, _flag[f]), t, c, langs) for t, c, langs, f, p in STANDALONE]
_LABELLED = [(re.compile(p, _flag[f]), t, c, langs, VALUE in p) for t, c, langs, f, p in LABELLED]
_EXCLUDED = [re.compile(p, _flag[f]) for f, p in EXCLUDED]
_CONTEXT = {k: _keywords(v) for k, v in CONTEXT.items()}
_PHONE_LABEL = _keywords(PHONE_LABELS)
_ORG = [(p, c) for p, t, c, _ in _STANDALONE if t == "ORG"]
_ALL = Prefilter([p for p, *_ in _STANDALONE] + [p for p, *_ in _LABELLED])
_FIRMS = Prefilter([p for p, _ in _ORG])


def boost(text: str, start: int, end: int, kind: str) -> float:
    """What keywords near a match add to its confidence; phone numbers without any label lose some."""
    words = _CONTEXT.get(kind)
    if words is None:
        return 0.0
    before = text[max(0, start - WINDOW) : start]
    if words.search(before):
        return BOOST
    if kind != "PHONE":
        return 0.0
    if _PHONE_LABEL.search(before) or _PHONE_LABEL.search(text[end : end + WINDOW]):
        return BOOST
    return -PHONE_PENALTY


def excluded(text: str, start: int, end: int) -> bool:
    """Whether the first hit of an exclusion pattern around the match holds the whole match."""
    lo = max(0, start - 30)
    window = text[lo : end + 10]
    return any((m := p.search(window)) and lo + m.start() <= start and lo + m.end() >= end for p in _EXCLUDED)


def sweep(spans: list[Span]) -> list[Span]:
    """Overlaps resolved in order of start: each span is compared with the last one kept only."""
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.confidence)):
        if not kept or s.start >= kept[-1].end:
            kept.append(s)
            continue
        last = kept[-1]
        if last.start <= s.start and s.end <= last.end:
            wins = s.confidence > last.confidence + MARGIN
        elif s.start <= last.start and last.end <= s.end:
            wins = last.confidence <= s.confidence + MARGIN
        else:
            wins = s.confidence > last.confidence or (s.confidence == last.confidence and s.end - s.start > last.end - last.start)
        if wins:
            kept[-1] = s
    return kept


def detect_patterns(text: str, config: Config, language: str | None) -> list[Span]:
    """The pattern layer: standalone, labelled and user patterns, then the sweep."""
    found: list[Span] = []

    def wanted(kind: str, langs: frozenset[str] | None) -> bool:
        return (not config.allowed or kind in config.allowed) and (not language or langs is None or language in langs)

    folded = fold(text)
    may = _ALL.may_match(text, folded)
    for k, (_, kind, base, langs) in enumerate(_STANDALONE):
        if may[k] and wanted(kind, langs) and (kind != "EMAIL" or "@" in text):
            for m in _ALL.hits(k, text, folded):
                if accepted(m[0], kind) and not excluded(text, *m.span()):
                    found.append(Span(*m.span(), m[0], kind, min(1.0, base + boost(text, *m.span(), kind))))
    colons = ":" in text
    for k, (_, kind, base, langs, colon) in enumerate(_LABELLED, len(_STANDALONE)):
        if may[k] and wanted(kind, langs) and (colons or not colon):
            for m in _ALL.hits(k, text, folded):
                if m[1] and len(m[1].strip()) >= 3 and accepted(m[1], kind):
                    found.append(Span(*m.span(1), m[1], kind, min(1.0, base + boost(text, *m.span(1), kind))))
    for c in config.custom:
        if c.enabled and wanted(c.kind, None) and (compiled := _compiled(c)):
            for m in compiled.finditer(text):
                if m[0].strip() and not excluded(text, *m.span()):
                    found.append(Span(*m.span(), m[0], c.kind, c.confidence))
    return sweep(found)


def _compiled(custom: Custom) -> re.Pattern | None:
    try:
        return re.compile(custom.pattern, 0 if custom.case_sensitive else re.IGNORECASE)
    except re.error:
        return None


def cross_line_firms(text: str, words: int = 5) -> list[Span]:
    """Firms that straddle a line break: up to five words of each adjoining line, joined by a space."""
    found: dict[tuple[int, int], Span] = {}
    at = text.find("\n")
    if at < 0 or not any(_FIRMS.may_match(text.replace("\n", " "))):
        return []
    while at >= 0:
        line = text[text.rfind("\n", 0, at) + 1 : at]
        cuts = [i for i, c in enumerate(line) if c == " "]
        lo = at - len(line) + (cuts[-words] + 1 if len(cuts) >= words else 0)
        stop = text.find("\n", at + 1)
        after = text[at + 1 : stop if stop >= 0 else len(text)]
        cuts = [i for i, c in enumerate(after) if c == " "]
        hi = at + 1 + (cuts[words - 1] if len(cuts) >= words else len(after))
        window = text[lo:hi]
        if len(window.split()) >= 2:
            flat = window.replace("\n", " ")
            for (pattern, base), open_ in zip(_ORG, _FIRMS.may_match(flat), strict=True):
                for m in pattern.finditer(flat) if open_ else ():
                    if m.start() < at - lo < m.end():
                        key = (lo + m.start(), lo + m.end())
                        found.setdefault(key, Span(*key, text[key[0] : key[1]], "ORG", base))
        at = stop if stop >= 0 else -1
    return list(found.values())


_NAME = re.compile(r"\b([A-ZÀ-Ü][a-zà-ü]{1,20}) ([A-ZÀ-Ü][a-zà-ü]{1,20}(?: [A-ZÀ-Ü][a-zà-ü]{1,20})?)\b")


def heuristic_names(text: str, first_names: frozenset[str]) -> list[Span]:
    """Two or three capitalised words of which the first is a known first name."""
    out = []
    for m in _NAME.finditer(text):
        if m[1].lower() in first_names:
            out.append(Span(*m.span(), m[0], "PERSON", 0.50 if m[2].count(" ") == 0 else 0.55))
    return out


# The types that patterns are ticked by.
PATTERN_TYPES = frozenset(["EMAIL", "PHONE", "SSN", "CREDIT_CARD", "IBAN", "DATE", "IP_ADDRESS", "PASSPORT", "DRIVER_LICENSE", "ADDRESS"])


def ticked(layers: dict[str, list[Span]], config: Config) -> dict[str, list[Span]]:
    """Layers without the types that are not ticked: names and zero-shot finds by model_types, all but patterns by pattern_types."""
    off = PATTERN_TYPES - config.pattern_types if config.pattern_types is not None else frozenset()
    out = {}
    for name, found in layers.items():
        if name in ("NER", "GLINER") and config.model_types:
            found = [s for s in found if s.kind in config.model_types]
        out[name] = found if name == "REGEX" else [s for s in found if s.kind not in off]
    return out


def add_if_free(spans: list[Span], more: list[Span]) -> list[Span]:
    """Spans of `more` that overlap none before them, added one by one: each added one blocks later ones."""
    out = list(spans)
    for s in more:
        if not any(s.start < o.end and o.start < s.end for o in out):
            out.append(s)
    return out


def chunks(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Sliding windows over n characters; the last one ends at n."""
    out, at = [], 0
    while True:
        out.append((at, min(n, at + size)))
        if at + size >= n:
            return out
        at += size - overlap


@dataclass
class Candidate:
    start: int
    end: int
    text: str
    kind: str
    confidence: float
    source: str
    priority: int
    emphasis: bool = False


STRUCTURED = frozenset({"SSN", "EMAIL", "PHONE", "CREDIT_CARD", "IBAN", "IP_ADDRESS", "DATE"})
_QUOTE_PAIRS = [('"', '"'), ("'", "'"), ("“", "”"), ("„", "“"), ("„", "”"), ("‘", "’"), ("«", "»"), ("‹", "›"), ("「", "」"), ("『", "』")]
# Small words in firm names, legal forms, words of loan schedules, phone labels in addresses.
_SMALL = frozenset("de du des la le les l' d' di da del della dei degli of the and & et und e y".split())
LEGAL = re.compile(r"\b(?:inc|incorporated|corp|corporation|ltd|limited|llc|llp|plc|co|company|lp|sas|sarl|gmbh|ag|bv|nv|kg|kgaa|ohg|ug|mbh|e\.?k\.?|e\.?v\.?|se|aktiengesellschaft|kommanditgesellschaft|lt[ée]e|limit[ée]e|enr|s\.?e\.?n\.?c\.?|n\.\s*v\.?|b\.\s*v\.?|s\.?a\.?r?\.?l?\.?|s\.?p\.?a\.?|s\.?r\.?l\.?)\b\.?", re.IGNORECASE)
_LOAN = re.compile(r"\b(?:hypoth[ée]caire|hypoth[èe]que|remboursable|remboursements?|mensuell?e?s?|trimestriell?e?s?|annuell?e?s?|[ée]ch[ée]ances?|capital|int[ée]r[êe]ts?|emprunts?|pr[êe]ts?|cr[ée]ancier|d[ée]biteur|mortgages?|repayments?|repayable|monthly|quarterly|annually|maturity|maturities|principal|interests?|loans?|lender|borrower|creditor|debtor)\b")
_LABEL_LINE = re.compile(r"(?:^|\n|\s+)(?:Phone|Tel(?:e(?:phone|fon|fax))?|T[ée]l(?:[ée]ph(?:one)?)?|T[ée]l[ée]c(?:opieur)?|Telex|Facs(?:imile)?|Telec[óo]p(?:ia)?|Mob(?:ile?)?|Cell(?:ulare)?|Celular|Fax|Port(?:able)?|Fixe|Rufn(?:ummer|r)?|Handy|Tel[ée]fono|Telefoon|Telefone)\.?(?:\s*(?:No\.?|Number|Num[ée]ro|#|N°))?\s*[:.]?\s*[\d\s\+\(\)\.\-]*$", re.IGNORECASE | re.MULTILINE)
MIN_DIGITS = {"PHONE": 7, "SSN": 7, "DRIVER_LICENSE": 6}


def legal_suffix(text: str) -> bool:
    return bool(LEGAL.search(text.strip()))


def quoted_ranges(text: str) -> list[tuple[int, int]]:
    """Ranges in quotation marks, marks included, kind by kind."""
    out = []
    for a, b in _QUOTE_PAIRS:
        i = text.find(a)
        while i >= 0 and (j := text.find(b, i + 1)) >= 0:
            if len(text[i + 1 : j].strip()) >= 2:
                out.append((i, j + 1))
            i = text.find(a, j + 1)
    return out


def _digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


def model_gate(kind: str, text: str, source: str) -> bool:
    """Whether a span of a model layer may become a candidate."""
    if kind in MIN_DIGITS:
        if _digits(text) < MIN_DIGITS[kind]:
            return False
        if source == "NER" and kind != "DRIVER_LICENSE" and ("." in text or "_" in text):
            return False
        if source == "GLINER" and "." in text and _digits(text) and ("," in text or len(text.strip()) - _digits(text) > 2):
            return False
    return not (source == "NER" and kind == "PASSPORT" and re.search(r"[-()]", text))


def candidates(layers: dict[str, list[Span]]) -> list[Candidate]:
    """All layers as candidates; priority depends on source and type."""
    out = []
    for source in ("REGEX", "NER", "GLINER", "LLM"):
        for s in layers.get(source, ()):
            if source == "REGEX":
                rank = 3 if s.kind in STRUCTURED else 2 if s.kind in ("ORG", "ADDRESS") else 1
            elif source == "LLM":
                rank = 1 if s.kind in STRUCTURED else 3
            else:
                rank = 2
            if source not in ("NER", "GLINER") or model_gate(s.kind, s.text, source):
                out.append(Candidate(s.start, s.end, s.text, s.kind, s.confidence, source, rank))
    return out


def layer_boost(cands: list[Candidate]) -> None:
    """Agreement of layers: a candidate gains where later ones of other sources overlap half of the shorter."""
    order = sorted(cands, key=lambda c: c.start)
    for i, c in enumerate(order):
        sources = {c.source}
        for o in order[i + 1 :]:
            if o.start >= c.end:
                break
            shared = min(c.end, o.end) - o.start
            shorter = min(c.end - c.start, o.end - o.start)
            if shorter > 0 and shared > 0 and shared / shorter >= 0.5:
                sources.add(o.source)
        if len(sources) > 1:
            c.confidence = min(1.0, c.confidence + (0.15 if len(sources) > 2 else 0.10))


def emphasis(cands: list[Candidate], text: str, quotes: list[tuple[int, int]]) -> None:
    """Firms in quotes, or of title-case words without a legal form, gain; names grow to the quoted run."""
    for c in cands:
        if c.kind == "ORG":
            hit = any(a <= c.start and c.end <= b for a, b in quotes)
            if not hit and not legal_suffix(c.text) and len(words := c.text.split()) >= 2:
                titled = [w for w in words if w.lower() not in _SMALL]
                hit = len(titled) >= 2 and all(w[0].isupper() for w in titled)
            if hit:
                c.confidence, c.emphasis = min(1.0, c.confidence + 0.15), True
    for c in cands:
        if c.kind in ("PERSON", "ORG"):
            for a, b in quotes:
                if c.start < b - 1 and c.end > a + 1:
                    lo, hi = a + 1, b - 1
                    while lo < hi and text[lo] in " \t\n":
                        lo += 1
                    while hi > lo and text[hi - 1] in " \t\n":
                        hi -= 1
                    c.start, c.end, c.text = lo, hi, text[lo:hi]
                    break


def merge(cands: list[Candidate], text: str) -> list[Candidate]:
    """Overlaps merged in order: priority wins, then confidence; equal types give the union of their spans."""
    out: list[Candidate] = []
    for c in sorted(cands, key=lambda c: (c.start, -c.priority)):
        if not out:
            out.append(c)
            continue
        last = out[-1]
        if c.kind == last.kind == "PERSON" and c.start == last.end + 1 and text[last.end : c.start] == " " and len(text[last.start : c.end].split()) <= 4:
            last.end, last.confidence = c.end, max(last.confidence, c.confidence)
            last.text = text[last.start : last.end]
        elif c.start < last.end:
            lo, hi = last.start, max(last.end, c.end)
            if c.priority > last.priority or (c.priority == last.priority and c.confidence > last.confidence):
                out[-1] = c
            top = out[-1]
            if c.kind == last.kind:
                top.start, top.end = min(lo, top.start), hi
            top.end = min(top.end, top.start + 500)
            top.text = text[top.start : top.end]
        else:
            out.append(c)
    return out


def is_noise(c: Candidate, lexicon: Lexicon = Lexicon()) -> bool:  # noqa: B008
    """Structural gates, the same for every source, and the noise rules of each type."""
    t = c.text.strip()
    if c.kind == "EMAIL" and "@" not in t or c.kind == "CREDIT_CARD" and _digits(t) < 13:
        return True
    if c.kind == "PASSPORT" and len(t.replace(" ", "")) < 5 or c.kind == "PHONE" and re.match(r"^\d{4}-\d{2}-\d{2}$", t):
        return True
    if c.kind in ("ORG", "PERSON") and sum(x.isalpha() for x in t) < 3:
        return True
    if c.kind == "ORG" and not c.emphasis and firm_noise(c.text, lexicon) or c.kind == "LOCATION" and place_noise(c.text, lexicon) or c.kind == "PERSON" and person_noise(c.text, lexicon):
        return True
    if c.kind == "PERSON" and c.source in ("NER", "GLINER") and c.start <= 5 and len(c.text.split()) >= 2:
        return True
    if c.kind == "ADDRESS" and not address_ok(c.text):
        return True
    if c.kind in MIN_DIGITS:
        if _digits(c.text) < MIN_DIGITS[c.kind]:
            return True
        if c.kind == "SSN" and (re.search("[$€£]", c.text) or re.fullmatch(r"\d{1,2}\s+\d{3}\s+\d{3}", t)):
            return True
        return c.kind in ("SSN", "PHONE") and "\n" in c.text
    return False


def is_region_noise(kind: str, text: str, emphasised: bool, lexicon: Lexicon = Lexicon()) -> bool:  # noqa: B008
    """The gates once more, on what regions are after trimming and splitting. emphasised: a candidate of two words or more that
    began here was set off on its page, so the rules on names of firms do not judge it."""
    t = text.strip()
    if kind == "ORG" and (len(t) <= 2 or t.isdigit()):
        return True
    if kind == "SSN":
        return _digits(text) < MIN_DIGITS["SSN"] or bool(re.search("[$€£\n]", text))
    return is_noise(Candidate(0, len(text), text, kind, 1.0, "REGEX", 0, emphasised), lexicon)


def address_ok(text: str) -> bool:
    """An address has letters and digits and no word of a loan schedule."""
    return bool(re.search("[A-Za-zÀ-ÿ]", text) and re.search(r"\d", text)) and not _LOAN.search(text.strip().lower())


def split_lines(cands: list[Candidate]) -> list[Candidate]:
    """Names and firms over several lines become one span per capitalised line, but for firms with a legal form."""
    out = []
    for c in cands:
        parts = []
        if c.kind in ("ORG", "PERSON") and "\n" in c.text and not (c.kind == "ORG" and legal_suffix(c.text)):
            at = c.start
            for line in c.text.split("\n"):
                t = line.strip()
                if len(t) >= 2 and t[0].isupper():
                    lo = at + len(line) - len(line.lstrip())
                    parts.append(replace(c, start=lo, end=lo + len(t), text=t))
                at += len(line) + 1
        out += parts or [c]
    return out


def join_addresses(cands: list[Candidate], text: str) -> list[Candidate]:
    """An address and a near address or place become one address; phone labels at its end go."""
    out: list[Candidate] = []
    for c in cands:
        if out and {out[-1].kind, c.kind} <= {"ADDRESS", "LOCATION"} and "ADDRESS" in (out[-1].kind, c.kind):
            last, both = out[-1], text[out[-1].start : c.end]
            if 0 <= c.start - last.end <= 60 and both.count("\n") <= 3:
                last.end, last.text, last.kind = c.end, both, "ADDRESS"
                last.confidence = max(last.confidence, c.confidence)
                continue
        out.append(c)
    for c in out:
        if c.kind == "ADDRESS" and (clean := _LABEL_LINE.sub("", c.text).strip()) and clean != c.text:
            at = c.text.find(clean)
            if at >= 0:
                c.start, c.end, c.text = c.start + at, c.start + at + len(clean), clean
            else:
                c.end, c.text = c.start + len(clean), clean
    return out


def detect_page(text: str, config: Config, models: dict[str, list[Span]] | None = None) -> list[Candidate]:
    """All spans of one page of plain text that reach the threshold."""
    if len(text.strip()) < config.min_chars:
        return []
    language = config.language if config.language and config.language != "auto" else language_py(text)
    layers = dict(models or {})
    patterns = detect_patterns(text, config, language)
    firms = cross_line_firms(text) if "\n" in text and (not config.allowed or "ORG" in config.allowed) else []
    layers["REGEX"] = add_if_free(patterns, firms)
    if config.names:
        layers["NER"] = add_if_free(layers.get("NER", []), heuristic_names(text, config.names))
    found = candidates(ticked(layers, config))
    if not found:
        return []
    layer_boost(found)
    emphasis(found, text, quoted_ranges(text))
    found = [c for c in merge(found, text) if not is_noise(c, config.lexicon)]
    found = join_addresses(split_lines(found), text)
    return [c for c in found if c.confidence >= config.threshold and (config.keep_custom or c.kind != "CUSTOM")]
