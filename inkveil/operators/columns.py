"""Columns of a page with word boxes, the text that detectors read column by column, and the way back to the page's text."""

from __future__ import annotations

from itertools import pairwise
from statistics import pstdev

from inkveil.operators.layout import Offset, Word, lines_of
from inkveil.operators.spans import Span

# A gutter's least width in mean heights and in points, the lines that must show it, how near votes
# are one, how far left edges beside it may scatter in mean heights, the gap in mean heights over which lines are
# one run of text, and the share of the page's width from which on a word is a heading.
GUTTER, GUTTER_POINTS, VOTES, NEAR_POINTS, SCATTER, JOINED, WIDE = 2.5, 15.0, 2, 12.0, 0.6, 2.0, 0.55


def mean_height(words: list[Word]) -> float:
    return sum(w.height for w in words) / len(words) if words else 10.0


def gutters(words: list[Word], width: float) -> list[float]:
    """Where columns meet: gaps that several lines show at one place, with straight left edges to their right."""
    narrow = [w for w in words if w.x1 - w.x0 <= width * WIDE] or words
    height = mean_height(narrow)
    least = max(height * GUTTER, GUTTER_POINTS)
    votes = sorted((a.x1 + b.x0) / 2 for line in lines_of(narrow) for a, b in pairwise(line) if b.x0 - a.x1 >= least)
    clusters: list[list[float]] = []
    for v in votes:
        if clusters and v - clusters[-1][-1] <= NEAR_POINTS:
            clusters[-1].append(v)
        else:
            clusters.append([v])
    found = []
    for c in clusters:
        if len(c) >= VOTES:
            x = sum(c) / len(c)
            edges = [w.x0 for w in narrow if x - 5 < w.x0 <= x + 4 * height]
            if len(edges) < 2 or pstdev(edges) <= height * SCATTER:
                found.append(x)
    return found


def columns(words: list[Word], width: float) -> list[list[Word]]:
    """Words by column, from left to right; a word belongs where its centre is. Without gutters there is one column."""
    if not words:
        return []
    inner = gutters(words, width)
    if not inner:
        return [list(words)]
    edges = [0.0, *inner, width]
    out: list[list[Word]] = [[] for _ in range(len(edges) - 1)]
    for w in words:
        centre = (w.x0 + w.x1) / 2
        inside = [k for k, (a, b) in enumerate(pairwise(edges)) if a <= centre <= b]
        out[inside[0] if inside else min(range(len(out)), key=lambda k: min(abs(centre - edges[k]), abs(centre - edges[k + 1])))].append(w)
    return [c for c in out if c]


def reading_text(text: str, offsets: list[Offset], width: float) -> tuple[str, list[int]]:
    """The text column by column, and for each of its characters the place in the page's text, -1 for those put in.

    Lines of one column stand in one run, joined by a space, where they lie close; columns and paragraphs are
    parted by a line break."""
    if not offsets or not text:
        return text, list(range(len(text)))
    at = {id(w): a for a, _, w in offsets}
    words = [w for _, _, w in offsets]
    close = mean_height(words) * JOINED
    out, places = [], []

    def put(chars: str, first: int | None) -> None:
        out.append(chars)
        places.extend(range(first, first + len(chars)) if first is not None else [-1] * len(chars))

    for k, column in enumerate(columns(words, width)):
        if k:
            put("\n", None)
        bottom = None
        for line in lines_of(column):
            if bottom is not None:
                put("\n" if min(w.y0 for w in line) - bottom > close else " ", None)
            for i, w in enumerate(line):
                if i:
                    put(" ", None)
                put(w.text, at[id(w)])
            bottom = max(w.y1 for w in line)
    return "".join(out), places


def translate(span: Span, places: list[int], text: str) -> Span | None:
    """A span of the reading text in the page's text, from its first to its last character there; line breaks
    inside are spaces. None if it holds nothing but characters put in."""
    own = [p for p in places[max(0, span.start) : max(0, span.end)] if p >= 0]
    if not own:
        return None
    start, end = own[0], own[-1] + 1
    return span._replace(start=start, end=end, text=text[start:end].replace("\n", " "))
