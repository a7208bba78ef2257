"""Shapes of regions on pages with word boxes: within the page, without wide gaps, of no more words than their type has."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from inkveil.operators.layout import Box, Offset, area, around, clamp, overlap

# Words of a region by type; gaps in line heights for a looseness of 0 and of 1, their limit in points,
# how much wider than the least gap of a line a cut must be, and how much white space stands between words at most.
MAX_WORDS = {"EMAIL": 1, "IP_ADDRESS": 1, "PASSPORT": 2, "SSN": 3, "DATE": 3, "DRIVER_LICENSE": 3, "PERSON": 4, "CREDIT_CARD": 4, "IBAN": 8, "PHONE": 8, "ORG": 8, "ADDRESS": 12}
MOST_WORDS, GAP_RATIOS, GAP_POINTS, OUTLIER, MOST_SPACE = 4, (0.50, 1.25), 20.0, 3.0, 3


@dataclass(frozen=True)
class Region:
    box: Box
    start: int | None
    end: int | None
    text: str
    kind: str
    confidence: float
    source: str = "REGEX"


def gap_limit(line_height: float, looseness: float = 0.5) -> float:
    """The widest gap between words of one region."""
    low, high = GAP_RATIOS
    return min(line_height * (low + (high - low) * looseness), GAP_POINTS)


def under(box: Box, offsets: list[Offset]) -> list[Offset]:
    """Words whose boxes overlap a box."""
    return [o for o in offsets if o[2].x0 < box.x1 and o[2].x1 > box.x0 and o[2].y0 < box.y1 and o[2].y1 > box.y0]


def gap_groups(words: list[Offset], text: str, looseness: float = 0.5) -> list[list[Offset]]:
    """Words in groups, cut where a gap on one line is wide and far wider than the least one there (if there are
    two to compare), or where more than MOST_SPACE white characters stand between them in the text."""
    if not words:
        return []
    middles = [w.middle for _, _, w in words]
    flat = max(middles) - min(middles) <= 0.5 * max(w.height for _, _, w in words)
    order = sorted(words, key=lambda o: o[2].x0 if flat else (o[2].middle, o[2].x0))
    pairs = list(zip(order, order[1:], strict=False))
    heights = [max(a[2].height, b[2].height) for a, b in pairs]
    gaps = [b[2].x0 - a[2].x1 if abs(a[2].middle - b[2].middle) < 0.5 * h else 0.0 for (a, b), h in zip(pairs, heights, strict=True)]
    wide = [g for g in gaps if g > 0]
    least = min(wide) if len(wide) >= 2 else 0.0
    groups = [[order[0]]]
    for (a, b), gap, height in zip(pairs, gaps, heights, strict=True):
        between = sum(c in " \t\n\r" for c in text[a[1] : b[0]])
        if (gap > gap_limit(height, looseness) and gap >= least * OUTLIER) or between > MOST_SPACE:
            groups.append([])
        groups[-1].append(b)
    return groups


def reading_order(words: list[Offset]) -> list[Offset]:
    """Words line by line: a word joins the last line if its middle is within 0.6 of a height of the line's mean middle."""
    lines: list[list[Offset]] = []
    for o in sorted(words, key=lambda o: (o[2].y0, o[2].x0)):
        if lines:
            last = lines[-1]
            middle, height = sum(x[2].middle for x in last) / len(last), max(x[2].height for x in last)
            if abs(o[2].middle - middle) <= 0.6 * max(height, o[2].height):
                last.append(o)
                continue
        lines.append([o])
    return [o for line in lines for o in sorted(line, key=lambda o: o[2].x0)]


def enforce(regions: list[Region], text: str, width: float, height: float, offsets: list[Offset], again: Callable[[str], tuple[str, float, str] | None] = lambda t: None, threshold: float = 0.55, looseness: float = 0.5) -> list[Region]:
    """Regions clamped to the page (those under a point go), cut at gaps, and cut into runs of as many words as
    their type has. Runs of too many words are detected again (`again`: text -> type, confidence and source); what
    is not found keeps half its confidence, if that reaches the threshold. Addresses are cut by words only."""
    if not offsets:
        return list(regions)
    out: list[Region] = []

    def part(r: Region, words: list[Offset], **changes) -> None:
        box = clamp(around([w for _, _, w in words]), width, height)
        if box.x1 - box.x0 >= 1 and box.y1 - box.y0 >= 1:
            out.append(replace(r, box=box, start=min(o[0] for o in words), end=max(o[1] for o in words), text=" ".join(o[2].text for o in words), **changes))

    for r in regions:
        box = clamp(r.box, width, height)
        if box.x1 - box.x0 < 1 or box.y1 - box.y0 < 1:
            continue
        r = replace(r, box=box)
        spanned = r.start is not None and r.end is not None and r.start < r.end
        words = [o for o in offsets if o[1] > r.start and o[0] < r.end] if spanned else under(box, offsets)
        most = MAX_WORDS.get(r.kind, MOST_WORDS)
        groups = [words] if r.kind == "ADDRESS" else gap_groups(words, text, looseness)
        if not words or (len(groups) == 1 and len(words) <= most):
            out.append(r)
            continue
        for group in groups:
            if len(group) <= most:
                part(r, group)
                continue
            row = reading_order(group) if r.kind == "ADDRESS" else sorted(group, key=lambda o: (o[2].y0, o[2].x0))
            for k in range(0, len(row), most):
                chunk = row[k : k + most]
                if r.kind == "ADDRESS":
                    part(r, chunk)
                elif found := again(" ".join(o[2].text for o in chunk)):
                    part(r, chunk, kind=found[0], confidence=found[1], source=found[2])
                elif r.confidence * 0.5 >= threshold:
                    part(r, chunk, confidence=r.confidence * 0.5)
    return out


def share_covered(a: Box, b: Box) -> float:
    """The share of a that b covers."""
    return overlap(a, b) / area(a) if area(a) > 0 else 0.0
