from __future__ import annotations

import pytest

from inkveil.operators.models import ModelRules, choose, cleaned, entities, is_language, no_firm, no_person, score, zero_shot_noise
from inkveil.operators.spans import Span

R = ModelRules(firm_prefixes=("société ",), titles=frozenset({"president", "ceo"}), no_person=frozenset({"dear", "sir"}), no_firm=frozenset({"board", "company"}), generic=frozenset({"total", "the"}), forms=frozenset({"sa"}))


@pytest.mark.parametrize(("text", "kind", "out"), [("The Acme Group\nLtd", "ORG", "Acme Group"), ("Société Alpha", "ORG", "Alpha"), ("John Smith President CEO", "PERSON", "John Smith"), ("John President", "PERSON", "John President"), ("  an Apple ", "ORG", "Apple")])
def test_entities_are_cut_and_cleaned(text, kind, out):
    assert cleaned(text, kind, R) == out


@pytest.mark.parametrize(("text", "kind", "model", "out"), [("John", "PERSON", "", 0.6), ("John Smith", "PERSON", "", 0.88), ("Acme", "ORG", "", 0.25), ("Acme Group", "ORG", "", 0.55), ("Acme Group Two", "ORG", "", 0.6), ("Paris", "LOCATION", "", 0.3), ("New York", "LOCATION", "", 0.25), ("John Smith", "PERSON", "en_core_web_trf", 0.96), ("Acme", "ORG", "en_core_web_lg", 0.28)])
def test_scores(text, kind, model, out):
    assert score(text, kind, R, model) == out


@pytest.mark.parametrize(("text", "plain", "strict"), [("Dear", True, True), ("CEO", True, True), ("1st Unit", True, True), ("Bob", True, True), ("john smith", False, True), ("Dear Sir", False, True), ("John Smith", False, False)])
def test_no_persons(text, plain, strict):
    assert (no_person(text, R), no_person(text, R, capitals=True)) == (plain, strict)


@pytest.mark.parametrize(("text", "plain", "strict"), [("board", True, True), ("SA", True, True), ("12 Rivers", True, True), ("9169270 Canada inc.", True, False), ("some firm", True, True), ("Board Company", False, True), ("Foo", False, True), ("Acme Group", False, False)])
def test_no_firms(text, plain, strict):
    assert (no_firm(text, R), no_firm(text, R, capitals=True)) == (plain, strict)


@pytest.mark.parametrize(("text", "kind", "noise"), [("x", "ORG", True), ("1234", "SSN", True), ("12345", "SSN", False), ("total", "PERSON", True), ("SA", "ORG", True), ("Board", "ORG", True), ("Board SA", "ORG", True), ("Acme SA", "ORG", False), ("Al", "PERSON", True)])
def test_zero_shot_noise(text, kind, noise):
    assert zero_shot_noise(text, kind, R) is noise


def test_offsets_follow_the_cleaned_text():
    text = "by The Acme Group\nof John Smith CEO"
    found = [Span(3, 20, text[3:20], "ORG", 0.9), Span(21, 35, text[21:35], "PERSON", 0.9), Span(0, 2, "by", "ORG", 0.9)]
    got = entities(found, R)
    assert [(text[s.start : s.end], s.kind) for s in got] == [("Acme Group", "ORG"), ("John Smith", "PERSON")]
    assert [s.confidence for s in entities(found, R, source="GLINER")] == [0.9, 0.9] and entities([], R) == []


def test_language_and_choice():
    stops = frozenset("the of and".split())
    assert is_language("the cat of and " * 10, stops, 0.15) and not is_language("cat dog cow " * 10, stops, 0.15)
    assert is_language("short", stops, 0.15, short=True) and not is_language("", stops, 0.15)
    models = {"en": len, "fr": str}
    assert choose(models, "fr") is str and choose(models, "de") is len and choose(models, "fr", "en") is len and choose({}, "en") is None
