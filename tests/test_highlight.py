from __future__ import annotations

import pytest

from inkveil.functions.text import matching_form
from inkveil.operators.highlight import highlight_all, mapped, occurrences, trim


@pytest.mark.parametrize("text", ["  Été  à\nParis ", "ＡＢ ﬁ x", "", " ", "áb", "L’Esprit – du"])
def test_maps_lead_back(text):
    low, places = mapped(text)
    assert low == matching_form(text) and len(low) == len(places) and places == sorted(places)


@pytest.mark.parametrize(("needle", "text", "found"), [
    ("Acme Corp", "the ACME\n corp and Acme Corp", ["ACME\n corp", "Acme Corp"]), ("Émile", "emile EMILE", ["emile", "EMILE"]), ("Johnson", "mr Jonson came", ["Jonson"]),
    ("Johnson", "nothing like it", []), ("", "x", []), ("x", "abc", []), ("aa", "aaa", ["aa", "aa"]),
])
def test_occurrences(needle, text, found):
    got = [text[a:b] for a, b in occurrences(needle, text)]
    assert [matching_form(g) for g in got] == [matching_form(f) for f in found] if needle != "Johnson" else len(got) == len(found)


@pytest.mark.parametrize(("text", "out"), [("L'ESPRIT DU LIEU\n(série)", "L'ESPRIT DU LIEU"), ("L'esprit du lieux", "L'esprit du lieux"), ("l’esprit du lieu", "l’esprit du lieu"), ("other", "other"), ("", "")])
def test_trim(text, out):
    assert trim(text, ["L'Esprit du lieu", ""]) == out


def test_highlight_all(spark):
    pages = spark.createDataFrame([("d", 1, "Acme Corp met acme corp"), ("d", 2, "ACME CORP again"), ("d", 3, None), ("e", 1, "Acme Corp")], "doc_id string, page_number int, text string")
    kind = "region_id string, doc_id string, page_number int, start int, end int, text string, pii_type string, confidence double, action string"
    regions = spark.createDataFrame([("r1", "d", 1, 0, 9, "Acme Corp", "ORG", 0.9, "PENDING"), ("r2", "d", 2, 0, 4, "ACME", "PERSON", 0.5, "PENDING"), ("r3", "d", 1, 14, 23, "acme corp", "ORG", 0.5, "CANCEL")], kind)
    new, cancelled = highlight_all(regions.where("region_id = 'r1'").select("region_id"), regions, pages)
    assert sorted((r.doc_id, r.page_number, r.start, r.end, r.pii_type, r.source) for r in new.collect()) == [("d", 1, 14, 23, "ORG", "MANUAL"), ("d", 2, 0, 9, "ORG", "MANUAL")]
    assert [r.region_id for r in cancelled.collect()] == ["r2"]
    assert highlight_all(regions.limit(0).select("region_id"), regions, pages)[0].count() == 0
