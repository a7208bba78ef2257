from __future__ import annotations

import pytest

from inkveil.operators.firms import RULES, firm_noise
from inkveil.operators.noise import Lexicon, person_noise, place_noise

WORDS = Lexicon(common=frozenset("province territoire emplacement outre mer compagnie".split()), german=frozenset("haupt mieter vertrag arbeits miete".split()), short_names=frozenset({"max"}))


@pytest.mark.parametrize(("text", "noise"), [("Paris", False), ("New York City", False), ("PAYS", True), ("Pays :", True), ("12 Rome", True), ("www.example.org", True), ("l'emplacement", True), ("Province / Territoire", True), ("outre-mer", True), ("grand stade du nord", True), ("Installation de mouillages", True), ("ab", True)])
def test_places(text, noise):
    assert place_noise(text, WORDS) is noise


@pytest.mark.parametrize(("text", "noise"), [("Dagmar", False), ("John Smith", False), ("Nous avons", True), ("Corp", True), ("Max", True), ("J.P.", True), ("La compagnie", True), ("JOHN", True), ("john smith", True), ("Signature :", True), ("Hauptmieter", True)])
def test_persons(text, noise):
    assert person_noise(text, WORDS) is noise


@pytest.mark.parametrize(("word", "yes"), [("hauptmieter", True), ("arbeitsvertrag", True), ("mietevertrag", True), ("hauptxyz", False), ("miete", False)])
def test_german_compounds(word, yes):
    assert WORDS.compound(word) is yes


FIRMS = Lexicon(common=frozenset("the department annex international of déboursés exhaustivité sous jacentes répartis".split()), german=frozenset("haupt mieter vertrag".split()), stems=lambda w: {w.removesuffix("s")})


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.name)
def test_each_rule_catches_its_example(rule):
    assert firm_noise(rule.example, FIRMS) == rule.name


@pytest.mark.parametrize("text", ["Acme Inc.", "Apple", "12345 Widget Works Inc.", "Desjardins Group", "Müller & Söhne GmbH", "SOCIÉTÉ GÉNÉRALE SE", "Xyzzy Department", "SOCIÉTÉ GÉNÉRALE XYZZY"])
def test_firms_stay(text):
    assert firm_noise(text, FIRMS) is None


@pytest.mark.parametrize("text", ["", "  ", "International", "the department", "Déboursés", "DÃ©boursÃ©s", "Exhaustivite", "l'exhaustivité", "sous-jacentes", "Hauptmieter", "Annexs", "annex."])
def test_forms_of_common_words(text):
    assert firm_noise(text, FIRMS)


def test_without_dictionaries_only_shape_counts():
    assert firm_noise("International") is None and firm_noise("a " * 13) == "a sentence" and firm_noise("Fonds pour Alpha") == "for a purpose"
