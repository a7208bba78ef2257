from __future__ import annotations

import pytest

from inkveil.operators.columns import columns, gutters, reading_text, translate
from inkveil.operators.layout import Box, Word, page_text
from inkveil.operators.shapes import Region, enforce, gap_groups, gap_limit
from inkveil.operators.spans import Span


def row(text, *edges, y=10.0):
    """Words of a line with (x0, x1) each, and their offsets in the text."""
    out, at = [], 0
    for word, (a, b) in zip(text.split(), edges, strict=True):
        at = text.index(word, at)
        out.append((at, at + len(word), Word(word, a, y, b, y + 10)))
        at += len(word)
    return out


@pytest.mark.parametrize(("text", "edges", "looseness", "sizes"), [
    ("John Smith", [(10, 40), (44, 80)], 0.5, [2]), ("John Smith", [(10, 40), (50, 80)], 0.5, [1, 1]), ("John    Smith", [(10, 40), (44, 80)], 0.5, [1, 1]),
    ("91269270 Canada Inc", [(10, 60), (66, 100), (107, 125)], 0.0, [3]), ("John Smith DOB", [(10, 40), (45, 80), (120, 145)], 0.0, [2, 1]), ("Hello", [(10, 50)], 0.5, [1]),
])
def test_gap_groups(text, edges, looseness, sizes):
    assert [len(g) for g in gap_groups(row(text, *edges), text, looseness)] == sizes
    assert gap_groups([], "") == []


def test_gap_limit_grows_and_is_bounded():
    assert gap_limit(10, 0.0) == 5.0 and gap_limit(10, 1.0) == 12.5 and gap_limit(100, 1.0) == 20.0


def test_small_regions_pass_and_large_ones_are_clamped():
    own = row("John Smith", (10, 40), (44, 80))
    r = Region(Box(10, 10, 80, 20), 0, 10, "John Smith", "PERSON", 0.9)
    assert enforce([r], "John Smith", 612, 792, own) == [r]
    out = enforce([Region(Box(600, 10, 650, 20), 0, 4, "Test", "ORG", 0.9)], "Test", 612, 792, row("Test", (600, 650)))
    assert len(out) == 1 and out[0].box.x1 == 612
    assert enforce([Region(Box(700, 10, 750, 20), 0, 4, "Test", "ORG", 0.9)], "Test", 612, 792, row("Test", (600, 650))) == []
    assert enforce([r], "", 612, 792, []) == [r]


def test_too_many_words_are_cut_and_seen_again():
    text = "a b c d e f"
    own = row(text, *[(10 + 12 * k, 18 + 12 * k) for k in range(6)])
    r = Region(Box(10, 10, 80, 20), 0, len(text), text, "PERSON", 0.9)
    assert enforce([r], text, 612, 792, own, threshold=0.5) == []
    out = enforce([r], text, 612, 792, own, again=lambda t: ("ORG", 0.8, "NER") if t == "e f" else None, threshold=0.4)
    assert [(x.text, x.kind, x.confidence, x.start, x.end) for x in out] == [("a b c d", "PERSON", 0.45, 0, 7), ("e f", "ORG", 0.8, 8, 11)]
    long = " ".join(f"w{k}" for k in range(14))
    a = enforce([Region(Box(10, 10, 500, 20), 0, len(long), long, "ADDRESS", 0.9)], long, 612, 792, row(long, *[(10 + 30 * k, 38 + 30 * k) for k in range(14)]))
    assert [len(x.text.split()) for x in a] == [12, 2] and {x.confidence for x in a} == {0.9}


def two_columns(middle=320.0):
    words = []
    for k, (left, right) in enumerate([("Acme Holdings", "Phone number"), ("International Ltd", "is below"), ("writes here", "this line")]):
        for x, side in ((50.0, left), (middle, right)):
            for w in side.split():
                words.append(Word(w, x, 50 + 14.0 * k, x + 6 * len(w), 60 + 14.0 * k))
                x += 6 * len(w) + 4
    return words


def test_columns_are_found_and_read_one_by_one():
    words = two_columns()
    assert len(gutters(words, 612)) == 1 and [len(c) for c in columns(words, 612)] == [6, 6]
    text, offsets = page_text(words)
    read, places = reading_text(text, offsets, 612)
    assert read == "Acme Holdings International Ltd writes here\nPhone number is below this line"
    assert len(read) == len(places) and all(p < 0 or text[p] == c for p, c in zip(places, read, strict=True))
    at = read.index("Holdings International")
    got = translate(Span(at, at + len("Holdings International"), "Holdings International", "ORG", 0.9), places, text)
    assert text[got.start : got.end].startswith("Holdings") and got.text.endswith("International") and "\n" not in got.text
    assert translate(Span(read.index("\n"), read.index("\n") + 1, "\n", "ORG", 0.9), places, text) is None


def test_scattered_edges_and_single_votes_make_no_column():
    words = two_columns()
    assert len(columns(words[:4], 612)) == 1  # one line shows the gap
    shift = lambda w: 9 * (w.y0 - 50) / 14 * (w.x0 >= 170)
    near = two_columns(170.0)
    assert len(columns(near, 612)) == 2
    scattered = [w._replace(x0=w.x0 + shift(w), x1=w.x1 + shift(w)) for w in near]
    assert len(columns(scattered, 612)) == 1
    assert columns([], 612) == [] and reading_text("", [], 612) == ("", [])


def test_paragraphs_stay_apart():
    words = [Word("one", 50, 50, 80, 60), Word("two", 50, 64, 80, 74), Word("three", 50, 120, 80, 130)]
    text, offsets = page_text(words)
    assert reading_text(text, offsets, 612)[0] == "one two\nthree"
