from __future__ import annotations

import random
import re

import pytest

from inkveil.operators import prefilter, spans


@pytest.mark.parametrize(("pattern", "flags", "digit", "literals"), [
    (r"(?:Nom|Pr[ée]nom)[ \t]*:", 0, False, {"nom", "prénom", "prenom"}), (r"\b\d{3}-\d{2}\b", 0, True, None), (r"\b(?:Rua|Av)\s", re.I, False, None),
    (r"[A-Z]{2}\d+", 0, True, None), (r"a(?:bcd)?efg", 0, False, {"efg"}), (r"[0-9a-f]+x", 0, False, None), (r"(?=\s*BILAN)", 0, False, {"bilan"}), (r"(?:abc|\d+)z", 0, False, None),
])
def test_needs(pattern, flags, digit, literals):
    got = prefilter.needs(re.compile(pattern, flags))
    assert got.digit == digit and (set(got.literals) if got.literals else None) == literals


def test_tails_end_names_of_firms():
    assert prefilter.tail(re.compile(r"\b[A-Z]\w+\s+(?:Inc|AG)\b\.?")).pattern == r"\s+(?:Inc|AG)\b\.?"
    assert prefilter.tail(re.compile(r"\w(?:\s+(?:de|la))+\s*x")) is None
    assert prefilter.tail(re.compile(r"a\s+(?:b)?")) is None


TEXTS = [
    "Contact Mr John Smith at john@example.com or +1 (415) 555-0134, 12 Main Street.", "Société Générale SA et Müller & Söhne GmbH & Co. KG", "Nom : Dupont\nNé le 12.03.1975 à Lyon",
    "paſsport number AB1234567, İstanbul, KENNWORT", "SSN: 123-45-6789. IBAN DE89 3704 0044 0532 0130 00", "nothing at all here", "PATIENT ID A12345; Hospital General Clinic",
    "Acme Holdings\nBALANCE SHEET", "12345 Widget Works Inc.", "12 janvier 2020, 3 DE MAYO DE 1999, 4. MÄRZ 2001", "Dr. Jane Roe; Frau Anna Schmidt; Sig.ra Rossi", "«Les Amis du Parc» Club SARL",
]


def test_filter_hides_no_match():
    patterns = [p for p, *_ in spans._STANDALONE] + [p for p, *_ in spans._LABELLED]
    own = prefilter.Prefilter(patterns)
    texts = TEXTS + [t.upper() for t in TEXTS] + [t.lower() for t in TEXTS] + [" ".join(TEXTS)]
    tried = 0
    for text in texts:
        may = own.may_match(text)
        assert not [p.pattern for p, m in zip(patterns, may, strict=True) if not m and p.search(text)]
        tried += sum(may)
    assert tried < 0.4 * len(texts) * len(patterns)


def test_patterns_without_literals():
    own = prefilter.Prefilter([re.compile(r"\d+"), re.compile(r"[a-z]+")])
    assert own.may_match("abc") == [False, True] and prefilter.Prefilter([]).may_match("abc") == []


def test_marks_and_literals_as_they_are_written():
    own = prefilter.Prefilter([re.compile(r"\b(?:[0-9a-f]{1,4}:){3}"), re.compile(r"\b(?:FR|DE)[A-Z0-9]{8}\b"), re.compile(r"\b(?:MR|PAT)\s*[-:]\s*\w", re.I), re.compile(r"(?:(?i:no)|Nr)\.?x")])
    assert own.may_match("from the paris order") == [False, False, False, True]
    assert own.may_match("FR12345678 and a:b:c:") == [True, True, True, True] and own.may_match("pat - x") == [False, False, True, True]


def test_tails_are_only_looked_for_where_one_may_begin():
    tails = list(spans._ALL.tails.values())
    folded, exact = spans._ALL.guards
    assert not exact.search("as se sa company") and not folded.search(prefilter.fold("The Income of Cox and Sales, ever Sagas"))
    forms = ["SA", "as", "GmbH", "&", "Co.", "KG", "e.", "V.", "e.V", "eV", "S.", "S.A.R.L.", "S.A", "Ltée", "LTÉE", "inc", "Inc.", "Income", "a/s", "N.V.", "the", "Coop", "S.Coop.", "ſas", "K", "aK", "ENR.G", "Oyj", "corps", "Corp,"]
    rng, held = random.Random(3), 0
    for _ in range(20000):
        text = "".join(rng.choice(forms) + rng.choice([" ", " ", "\n", " ", "", ".", "-"]) for _ in range(rng.randint(1, 4)))
        if any(t.search(text) for t in tails):
            held += 1
            assert folded.search(prefilter.fold(text)) or exact.search(text), text
    assert held > 3000


def test_no_line_break_is_looked_at_without_a_firm(monkeypatch):
    looked, may = [], prefilter.Prefilter.may_match
    monkeypatch.setattr(prefilter.Prefilter, "may_match", lambda self, text: looked.append(text) or may(self, text))
    assert spans.cross_line_firms("one two\nthree four\n" * 50) == [] and len(looked) == 1
    assert [s.text for s in spans.cross_line_firms("by Acme\nWidget Inc. and\nothers")] == ["Acme\nWidget Inc."]


def test_matches_are_found_by_their_beginnings():
    rng = random.Random(8)
    bits = ["DL", "dl: A1234567", "DL No. A1234567", "HOPITAL", "Hôpital", " Général", "Dr. ", "M. Dupont", "France", "Côte d'Ivoire", "United  States", "Tel: +33 1 23", "Fax.", "née le 12/03/1980", "ICE: Bob Jones", "Via Roma 12", "İ", "ſ", "K", "ß", "\n", "  ", ", ", "x", "CHU"]
    patterns = [p for p, *_ in spans._STANDALONE] + [p for p, *_ in spans._LABELLED]
    assert len(spans._ALL.begun) > 50
    found = 0
    for _ in range(300):
        text = "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25)))
        for k in spans._ALL.begun:
            expected = [m.span() for m in patterns[k].finditer(text)]
            found += len(expected)
            assert [m.span() for m in spans._ALL.hits(k, text, prefilter.fold(text))] == expected, (k, text)
    assert found > 1000
