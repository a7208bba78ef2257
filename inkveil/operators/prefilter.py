"""What a text must hold for a pattern to match it: a digit, one of some literals, or one of some marks.

All are read off the parsed pattern. A text is folded once and searched for the literals of all
patterns by one automaton, and as it is written for those of patterns that heed case; what ends names of
firms is only looked for if it may begin somewhere, by its first characters. Patterns that cannot match are then not
tried at all. The filter never hides a match: where nothing is known of a pattern it is always tried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product
from re import _constants as op
from re import _parser
from typing import NamedTuple

import ahocorasick

#: Literals shorter than this stand in almost every text and are not looked for; literals as they are written may be shorter.
LEAST, LEAST_EXACT = 3, 2
#: Characters at the beginning of a tail that are compared at first; how shorter beginnings go on: a word ends, or anything may follow.
HEAD, _EDGE, _ANY, _FOLDED_HEAD, _EXACT_HEAD = 5, "\0", "\1", "\2", "\3"
#: Characters that patterns which ignore case take for others beside their lower-case forms.
_ALIKE = {"ſ": "s", "ı": "i", "İ": "i", "K": "k", "Å": "å", "ẞ": "ß", "µ": "μ", "ς": "σ"}
_DIGIT = re.compile(r"\d")


def fold(text: str) -> str:
    if not text.isascii():
        for c, same in _ALIKE.items():
            text = text.replace(c, same) if c in text else text
    return text.lower()


class Needs(NamedTuple):
    digit: bool
    literals: frozenset[str] | None
    exact: frozenset[str] | None = None
    marks: frozenset[str] | None = None


def _characters(items) -> set[str] | None:
    """The characters of a small set, or None."""
    found = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < 4:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 4 else None


def _digits_only(items) -> bool:
    return all(kind is op.CATEGORY and value is op.CATEGORY_DIGIT or kind is op.LITERAL and chr(value).isdigit() or kind is op.RANGE and chr(value[0]).isdigit() and chr(value[1]).isdigit() for kind, value in items)


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The set that says more: with longer shortest literals, then with fewer."""
    return max((x for x in (a, b) if x), key=lambda x: (min(min(map(len, x)), 6), -len(x)), default=None)


def _fewer(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    return min((x for x in (a, b) if x), key=len, default=None)


def _all(sets: list[frozenset[str] | None]) -> frozenset[str] | None:
    return frozenset().union(*sets) if all(sets) else None


def _mark(c: str) -> bool:
    return c.isascii() and c.isprintable() and not c.isalnum() and c != " "


def _sequence(items, fold=fold) -> Needs:
    """What a sequence holds, its literals folded; with fold=str as they are written, but for those whose case is ignored."""
    digit, best, marks = False, None, None
    runs = {""}

    def end() -> None:
        nonlocal best, runs
        if runs != {""}:
            best = _better(best, frozenset(runs))
        runs = {""}

    for kind, value in items:
        chars = None
        if kind is op.LITERAL:
            chars = {chr(value)}
        elif kind is op.IN:
            chars = _characters(value)
            digit = digit or _digits_only(value)
        if chars is not None:
            digit = digit or all(c.isdigit() for c in chars)
            marks = _fewer(marks, frozenset(chars) if all(map(_mark, chars)) else None)
            longer = {fold(r + c) for r, c in product(runs, chars)}
            if len(longer) > 32:
                end()
                longer = {fold(c) for c in chars}
            runs = longer
            continue
        if kind is op.AT:
            continue
        end()
        inner = None
        if kind is op.SUBPATTERN:
            inner = _sequence(value[-1], fold)
            if fold is str and value[1] & re.IGNORECASE:
                inner = inner._replace(literals=None)
        elif kind is op.BRANCH:
            parts = [_sequence(x, fold) for x in value[1]]
            inner = Needs(all(p.digit for p in parts), _all([p.literals for p in parts]), None, _all([p.marks for p in parts]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0]:
            inner = _sequence(value[2], fold)
        elif kind is op.ASSERT and value[0] > 0:  # what follows a match stands in the text too
            inner = _sequence(value[1], fold)
        if inner:
            digit, best, marks = digit or inner.digit, _better(best, inner.literals), _fewer(marks, inner.marks)
    end()
    return Needs(digit, best, None, marks)


def needs(pattern: re.Pattern) -> Needs:
    """What every match holds: a digit, one of the literals (folded), one of those as they are written, and one of the marks, if any are known."""
    parsed = _parser.parse(pattern.pattern, pattern.flags & ~re.UNICODE)
    found, exact = _sequence(parsed), None if parsed.state.flags & re.IGNORECASE else _sequence(parsed, str).literals
    long = lambda x, least: x if x and min(map(len, x)) >= least else None
    return Needs(found.digit, long(found.literals, LEAST), long(exact, LEAST_EXACT), found.marks)


def tail(pattern: re.Pattern) -> re.Pattern | None:
    """The part of a pattern from its last white space outside groups on, if a group follows: a shorter
    pattern that matches wherever the whole one does, such as the legal form that ends a firm's name."""
    source, depth, at, k = pattern.pattern, 0, -1, 0
    while k < len(source):
        c = source[k]
        if c == "\\":
            if depth == 0 and source.startswith("\\s+(?", k):
                at = k
            k += 2
            continue
        if c == "[":
            k = source.index("]", k + 2)
        depth += (c == "(") - (c == ")")
        k += 1
    if at < 0 or re.search(r"\)[*?{]", source[at:]):
        return None
    return re.compile(source[at:], pattern.flags & ~re.UNICODE)


def heads(items, ignore: bool, begun: frozenset[str] = frozenset([""])) -> frozenset[str]:
    """How matches of a sequence may begin, after `begun`: _FOLDED_HEAD and folded characters, or _EXACT_HEAD and characters as
    they are written, white space as a blank; HEAD of them, or fewer and _EDGE, where a word ends, or _ANY."""
    mode = _FOLDED_HEAD if ignore else _EXACT_HEAD
    for kind, value in items:
        done = frozenset(x for x in begun if len(x) > HEAD or x[-1:] in (_EDGE, _ANY))
        live = begun - done
        if not live:
            return begun
        chars = None
        if kind is op.LITERAL:
            chars = {chr(value)}
        elif kind is op.IN:
            chars = {" "} if value == [(op.CATEGORY, op.CATEGORY_SPACE)] else _characters(value)
        if chars:
            chars = {fold(c) for c in chars} if ignore else chars
            live = frozenset((x or mode) + c if not x or x[0] == mode else x + _ANY for x, c in product(live, chars))
        elif kind is op.BRANCH:
            live = frozenset().union(*(heads(x, ignore, live) for x in value[1]))
        elif kind is op.SUBPATTERN and not value[2]:
            live = heads(value[-1], ignore or bool(value[1] & re.IGNORECASE), live)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] == 0:
            more = heads(value[2], ignore, live)
            live |= more if value[1] == 1 else frozenset(x if x[-1:] in (_EDGE, _ANY) else x + _ANY for x in more)
        elif kind is op.AT and value is op.AT_BOUNDARY:
            live = frozenset(x and x + (_EDGE if x[-1:].isalnum() else _ANY) for x in live)
        else:
            live = frozenset(x + _ANY for x in live)
        begun = done | live
    return begun


def guards(tails: list[re.Pattern]) -> tuple[re.Pattern, re.Pattern] | None:
    """Two patterns, for folded texts and for texts as they are written, of which one is found where any of the tails may
    begin, white space first; None if that cannot be told."""
    groups: dict[str, dict[str, set[str]]] = {_FOLDED_HEAD: {}, _EXACT_HEAD: {}}
    for t in tails:
        for x in heads(list(_parser.parse(t.pattern, t.flags & ~re.UNICODE))[1:], bool(t.flags & re.IGNORECASE)):
            if x[:1] not in groups or len(x) < 2 or x[1] in (_EDGE, _ANY, " "):
                return None
            rest = re.escape(x[2:].rstrip(_EDGE + _ANY)).replace("\\ ", r"\s")
            groups[x[0]].setdefault(x[1], set()).add(rest + (r"\b" if x[-1] == _EDGE else ""))

    def pattern(by_first: dict[str, set[str]]) -> re.Pattern:
        if not by_first:
            return re.compile("(?!)")
        firsts = "|".join(re.escape(c) + "(?:" + "|".join(sorted(rest)) + ")" for c, rest in sorted(by_first.items()))
        return re.compile(r"\s(?=[" + "".join(map(re.escape, sorted(by_first))) + "])(?:" + firsts + ")")

    return pattern(groups[_FOLDED_HEAD]), pattern(groups[_EXACT_HEAD])


def beginnings(pattern: re.Pattern) -> frozenset[str] | None:
    """Literals of two characters or more (folded), one of which stands where a match begins, if they are known."""
    parsed = _parser.parse(pattern.pattern, pattern.flags & ~re.UNICODE)
    items = list(parsed)
    while items and items[0][0] in (op.AT, op.ASSERT, op.ASSERT_NOT):
        del items[0]
    found = {re.split(f"[ {_EDGE}{_ANY}]", x[1:])[0] if x[:1] in (_FOLDED_HEAD, _EXACT_HEAD) else "" for x in heads(items, bool(parsed.state.flags & re.IGNORECASE))}
    found = set(map(fold, found))
    return frozenset(x for x in found if not any(x[:n] in found for n in range(2, len(x)))) if found and min(map(len, found)) > 1 else None


def _automaton(literals: list[frozenset[str] | None]) -> ahocorasick.Automaton:
    owners: dict[str, list[int]] = {}
    for k, own in enumerate(literals):
        for literal in own or ():
            owners.setdefault(literal, []).append(k)
    out = ahocorasick.Automaton()
    for literal, who in owners.items():
        out.add_word(literal, tuple(who))
    out.make_automaton()
    return out


def _ends(literals: frozenset[str]) -> ahocorasick.Automaton:
    """The literals, each with its length."""
    out = ahocorasick.Automaton()
    for literal in literals:
        out.add_word(literal, len(literal))
    out.make_automaton()
    return out


def _found(automaton: ahocorasick.Automaton, text: str) -> set[int]:
    return set().union(*{who for _, who in automaton.iter(text)}) if len(automaton) else set()


class Prefilter:
    """Which of some patterns may match a text."""

    def __init__(self, patterns: list[re.Pattern]):
        self.needs = [needs(p) for p in patterns]
        self.automaton, self.written = _automaton([n.literals for n in self.needs]), _automaton([n.exact for n in self.needs])
        self.free = frozenset(k for k, n in enumerate(self.needs) if n.literals is None)
        self.exact = frozenset(k for k, n in enumerate(self.needs) if n.exact)
        self.digit = frozenset(k for k, n in enumerate(self.needs) if n.digit)
        self.marks = {k: n.marks for k, n in enumerate(self.needs) if n.marks}
        self.tails = {k: t for k, p in enumerate(patterns) if k in self.free and (t := tail(p))}
        self.guards = guards(list(self.tails.values()))
        self.patterns = patterns
        self.begun = {k: _ends(b) for k, p in enumerate(patterns) if (b := beginnings(p))}

    def may_match(self, text: str, folded: str | None = None) -> list[bool]:
        folded = fold(text) if folded is None else folded
        open_ = self.free | _found(self.automaton, folded)
        open_ -= self.exact - _found(self.written, text)
        if not _DIGIT.search(text):
            open_ -= self.digit
        open_ = {k for k in open_ if k not in self.marks or any(c in text for c in self.marks[k])}
        if not open_.isdisjoint(self.tails):
            none = self.guards and not self.guards[0].search(folded) and not self.guards[1].search(text)
            open_ -= {k for k, t in self.tails.items() if none or k in open_ and not t.search(text)}
        return [k in open_ for k in range(len(self.needs))]

    def hits(self, k: int, text: str, folded: str) -> Iterator[re.Match]:
        """finditer of pattern k; where it is known how matches begin, only those places are tried."""
        if k not in self.begun or len(folded) != len(text):
            yield from self.patterns[k].finditer(text)
            return
        done = 0
        for at in sorted({end + 1 - size for end, size in self.begun[k].iter(folded)}):
            if at >= done and (m := self.patterns[k].match(text, at)):
                done = m.end()
                yield m
