"""Searches for given terms, and spans from models' answers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.text import flex_pattern
from inkveil.functions.text import plain_py as plain_text
from inkveil.lexicon.words import TOKEN_LETTERS
from inkveil.operators.spans import Span
from inkveil.operators.store import spread
from inkveil.operators.value_index import index_of, key_words

_INNER = re.compile(r"\w+")


def _lower(text: str) -> str:
    """Lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def edit_costs(key: np.ndarray, text: np.ndarray, anywhere: bool) -> np.ndarray:
    """For each end in text the least edits from key to a part of text that ends there, starting anywhere or at 0."""
    steps = np.arange(len(text) + 1)
    cost = np.zeros(len(text) + 1, np.int64) if anywhere else steps.copy()
    for i, c in enumerate(key):
        new = np.empty_like(cost)
        new[0] = i + 1
        new[1:] = np.minimum(cost[1:] + 1, cost[:-1] + (text != c))
        cost = np.minimum.accumulate(new - steps) + steps
    return cost


def best_place(key: np.ndarray, text: np.ndarray, edits: int) -> tuple[int, int] | None:
    """The part of text with the fewest edits from key, `edits` at most: the first such end, then the longest part."""
    cost = edit_costs(key, text, True)
    end = int(cost.argmin())
    if cost[end] > edits:
        return None
    back = edit_costs(key[::-1], text[:end][::-1], False)
    length = int(np.flatnonzero(back == back.min())[-1])
    return (end - length, end) if length else None


def least_edits(key: str, text: str, most: int) -> int:
    """The least edits from key to a beginning of text, or most + 1: by edits and shift, how much of key is reached."""
    n, size, far = len(key), len(text), {0: 0}
    for e in range(most + 1):
        new = {}
        for d in range(-e, e + 1) if e else (0,):
            i = max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1) if e else 0
            i = min(i, n, size - d)
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < size and key[i] == text[i + d]:
                i += 1
            if i == n:
                return e
            new[d] = i
        far = new
    return most + 1


def may_stand(key: str, cuts: tuple[int, ...], part: int, text: str, at: int) -> bool:
    """Whether key, with one edit less than it has parts, stands in text so that its part `part` stands unchanged at `at`
    and, of parts halved again and again, each half that holds this part has one edit less than parts.

    Every place with so few edits has such a part: where two halves have fewer edits than parts together, one of them has."""
    lo, hi, halves = 0, len(cuts) - 1, []
    while hi - lo > 1:
        halves.append((lo, hi))
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if part < mid else (mid, hi)
    end = at + cuts[part + 1] - cuts[part]
    for lo, hi in reversed(halves):
        most = hi - lo - 1
        before, after = key[cuts[lo] : cuts[part]], key[cuts[part + 1] : cuts[hi]]
        used = least_edits(before[::-1], text[max(0, at - len(before) - most) : at][::-1], most)
        if used > most or used + least_edits(after, text[end : end + len(after) + most], most - used) > most:
            return False
    return True


_pattern = lru_cache(maxsize=4096)(flex_pattern)


def _cuts(key: str, edits: int) -> tuple[int, ...]:
    """Where a key is cut into its edits + 1 parts."""
    return tuple(len(key) * j // (edits + 1) for j in range(edits + 2))


@lru_cache(maxsize=4096)
def term_seeds(term: str, fuzziness: float) -> tuple[str, int, tuple[tuple[str, int], ...]]:
    """A term's key, the edits it may have, and its seeds with their offsets: its longest word (offset -1), and, for
    misspelled places, its edits + 1 parts, one of which stands unchanged in any place with so few edits."""
    key = " ".join(_lower(plain_text(term)).split())
    if not key:
        return "", 0, ()
    fuzzy = fuzziness < 0.98
    edits = max(1, round(len(key) * (1 - fuzziness))) if fuzzy else 0
    seeds = [(max(key.split(" "), key=len), -1)]
    if fuzzy and len(key) > edits:
        cuts = _cuts(key, edits)
        seeds += [(key[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return key, edits, tuple(seeds)


class TermFinder:
    """Places of many terms in a text, whatever their case, accents, quotes and white space; below a fuzziness
    of 0.98 also places with up to one edit, or that share of a term's length, if more.

    One automaton looks for the seeds of every term (see term_seeds). Only around seeds from which a term can be
    followed on (see may_stand) is it compared."""

    def __init__(self, terms: list[tuple[int, str]], fuzziness: float = 1.0):
        self.fuzzy, self.terms = fuzziness < 0.98, []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, term in terms:
            key, edits, parts = term_seeds(term, fuzziness)
            if not key:
                continue
            k = len(self.terms)
            self.terms.append((i, key, edits, _cuts(key, edits)))
            for j, (part, offset) in enumerate(parts):
                seeds.setdefault(part, []).append((k, j - 1 if offset >= 0 else -1))
        self.automaton = ahocorasick.Automaton()
        for seed, who in seeds.items():
            self.automaton.add_word(seed, (len(seed), who))
        self.automaton.make_automaton()
        self.tiny = [k for k, t in enumerate(self.terms) if self.fuzzy and len(t[1]) <= t[2]]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(term id, number of the place, start, end), terms in order, places from left to right."""
        plain = plain_text(text)
        low = _lower(plain)
        exact: set[int] = set()
        near: dict[int, list[int]] = {k: [0] for k in self.tiny}
        for end, (n, who) in self.automaton.iter(low) if len(self.automaton) else ():
            for k, part in who:
                if part < 0:
                    exact.add(k)
                    continue
                _, key, _, cuts = self.terms[k]
                if may_stand(key, cuts, part, low, end + 1 - n):
                    near.setdefault(k, []).append(end + 1 - n - cuts[part])
        out, codes = [], None
        for k in sorted(exact | near.keys()):
            i, key, edits, _ = self.terms[k]
            found = [m.span() for m in _pattern(key).finditer(plain)] if k in exact else []
            if k in near:
                codes = _codes(low) if codes is None else codes
                whole = [(0, len(low))] if k in self.tiny else _windows(near[k], len(key), edits, len(low))
                found = self._misspelled(found, whole, _codes(key), codes, edits)
            out += [(i, j, a, b) for j, (a, b) in enumerate(sorted(found))]
        return out

    @staticmethod
    def _misspelled(found: list[tuple[int, int]], windows: list[tuple[int, int]], key: np.ndarray, text: np.ndarray, edits: int) -> list[tuple[int, int]]:
        """found, and the best place of each gap between them, again and again, within the windows."""
        found = list(found)
        gaps = []
        for lo, hi in windows:
            inside = sorted((a, b) for a, b in found if a < hi and b > lo)
            gaps += zip([lo, *(b for _, b in inside)], [*(a for a, _ in inside), hi], strict=True)
        while gaps:
            lo, hi = gaps.pop()
            place = best_place(key, text[lo:hi], edits) if lo < hi else None
            if place:
                a, b = lo + place[0], lo + place[1]
                found.append((a, b))
                gaps += [(lo, a), (b, hi)]
        return found


def _windows(starts: list[int], length: int, edits: int, n: int) -> list[tuple[int, int]]:
    """Where places may lie that start about there, merged where they meet."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        lo, hi = max(0, s - edits), min(n, s + length + edits)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def find_term(term: str, text: str, fuzziness: float = 1.0) -> list[tuple[int, int]]:
    """All places of one term (see TermFinder)."""
    return [(a, b) for _, _, a, b in TermFinder([(0, term)], fuzziness).find(text)]


def fuzzy_find(needle: str, text: str, threshold: float = 0.75) -> int | None:
    """Where a text most like needle starts: exact, then in any case, then by the best ratio of windows."""
    low, want = text.lower(), needle.lower()
    for hay, what in ((text, needle), (low, want)):
        if (at := hay.find(what)) >= 0:
            return at
    n = len(needle)
    if n < 3 or n > len(text):
        return None
    ratio = lambda i: SequenceMatcher(None, want, low[i : i + n]).ratio()
    step, last = max(1, n // 6), len(text) - n + 1
    best = max(range(0, last, step), key=ratio)
    if ratio(best) >= 0.9 * threshold:
        near = range(max(0, best - step), min(last, best + step + 1))
        best = max([best, *near], key=ratio)
    return best if ratio(best) >= threshold else None


def parse_reply(reply: str, text: str, offset: int = 0) -> list[Span]:
    """Spans of a model's reply: a JSON list of {"text", "type"}, fenced or within other text."""
    reply = reply.strip()
    if reply.startswith("```"):
        reply = "\n".join(x for x in reply.split("\n") if not x.startswith("```"))
    try:
        items = json.loads(reply)
    except ValueError:
        m = re.search(r"\[.*\]", reply, re.DOTALL)
        try:
            items = json.loads(m[0]) if m else []
        except ValueError:
            items = []
    out = []
    for item in items if isinstance(items, list) else ():
        value = item.get("text") if isinstance(item, dict) else None
        if value and (at := fuzzy_find(value, text)) is not None:
            kind = item.get("type", "CUSTOM")
            kind = kind if kind in TOKEN_LETTERS else "CUSTOM"
            out.append(Span(offset + at, offset + at + len(value), text[at : at + len(value)], kind, 0.75))
    return out


def model_scale(score: float) -> float:
    """A zero-shot model's score on the scale of confidences: 0.20 gives 0.48, 0.80 gives 0.95."""
    return round(min(0.95, max(0.0, 0.48 + (score - 0.20) * (0.95 - 0.48) / (0.80 - 0.20))), 4)


def dedupe_chunks(spans: list[Span]) -> list[Span]:
    """Spans of overlapping chunks: where two overlap the surer or longer one stays."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, s.start - s.end)):
        if out and s.start < out[-1].end:
            if s.confidence > out[-1].confidence or s.end - s.start > out[-1].end - out[-1].start:
                out[-1] = s
        else:
            out.append(s)
    return out


FOUND = "term_id long, doc_id string, page_number long, ord int, start int, end int, text string"
#: Characters of a list of terms that one kernel takes; longer lists are searched in several passes.
LIST_CHARS = 8_000_000


def lots(terms: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    """A list of terms in parts of LIST_CHARS or one term."""
    out: list[list[tuple[int, str]]] = []
    held = LIST_CHARS
    for i, t in terms:
        if held + len(t) > LIST_CHARS:
            out.append([])
            held = 0
        out[-1].append((i, t))
        held += len(t)
    return out


def _in_lots(rows: DataFrame, terms: list[tuple[int, str]], kernel, schema: str) -> DataFrame:
    parts = [rows.mapInArrow(kernel(lot), schema) for lot in lots(terms)]
    return reduce(DataFrame.union, parts) if parts else rows.sparkSession.createDataFrame([], schema)


def search_terms(pages: DataFrame, terms: DataFrame | list[tuple[int, str]], fuzziness: float = 1.0) -> DataFrame:
    """All places of a table of terms (term_id, term), or of a user's short list, on all pages (see term_seeds.search_table).

    Terms that differ only in case or white space are searched once, under the least id."""
    from inkveil.operators.term_seeds import search_table

    if not isinstance(terms, DataFrame):
        terms = pages.sparkSession.createDataFrame(terms, "term_id long, term string")
    return search_table(pages, terms, fuzziness)


def containing(rows: DataFrame, terms: list[tuple[int, str]], id_col: str, text_col: str = "text") -> DataFrame:
    """(term_id, row_id) of rows whose text holds a term as it is, once each. Empty terms stand in every text
    that is not null; null texts hold nothing. One automaton for all terms of a part of the list."""
    def kernel(lot: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            owners: dict[str, list[int]] = {}
            for i, t in lot:
                owners.setdefault(t, []).append(i)
            found = ahocorasick.Automaton()
            for t, who in owners.items():
                if t:
                    found.add_word(t, who)
            found.make_automaton()
            for batch in batches:
                out = []
                for row, text in zip(batch.column("row_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    hits = {i for _, who in found.iter(text) for i in who} if text and len(found) else set()
                    out += [(i, row) for i in hits.union(i for i, t in lot if not t and text is not None)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["term_id", "row_id"])

        return run

    base = spread(rows.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")))
    return _in_lots(base, terms, kernel, "term_id long, row_id long")


def split_sizes(sizes: list[int], budget: int) -> list[tuple[int, int]]:
    """Page ranges (first, last) of parts whose bytes stay within a budget, filled in order; a larger page stands alone."""
    out, first, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > budget:
            out.append((first, i - 1))
            first, held = i, 0
        held += n
    return [*out, (first, len(sizes) - 1)] if sizes else []


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms with the hash of two neighbouring words inside them (of one word, if there are no two): the longest, as long words
    are rare. Words at the edges may be parts of longer ones in a text, so they are no seeds; 0 stands in every text."""
    for batch in batches:
        seeds = []
        for term in batch.column("term").to_pylist():
            inner = _INNER.findall(plain_text(term).lower())[1:-1]
            pairs = [f"{a} {b}" for a, b in zip(inner, inner[1:])] or inner  # noqa: B905
            seeds.append(key_words(max(pairs, key=lambda p: (len(p), p))) if pairs else 0)
        yield batch.append_column("words", pa.array(seeds, pa.int64()))


def containing_terms(rows: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term_id and row_id of all rows whose text contains a term of the table terms (term_id, term), as it is written.

    Terms and texts meet in an equi-join of a pair of words inside the term with the distinct words of each text, and what
    met is compared. Neither terms nor texts pass through the driver or meet in one task. An empty term is in every text, a
    null one in none; terms of one or two words are compared with every text."""
    base = rows.select(F.lit("").alias("doc_id"), F.col(id_col).cast("long").alias("page_number"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    known = terms.select(F.col("term_id").cast("long").alias("term_id"), "term").where("term IS NOT NULL")
    seeds = known.mapInArrow(_seeded, "term_id long, term string, words long").select("term_id", "words")
    index = index_of(spread(base.withColumn("text", F.when(F.col("text") == "", " ").otherwise(F.col("text")))))
    met = index.join(seeds, "words").select("term_id", "page_number").distinct()
    pairs = met.join(base.select("page_number", "text"), "page_number").join(known, "term_id")
    return pairs.where(F.contains("text", "term")).select("term_id", F.col("page_number").alias("row_id")).distinct()
