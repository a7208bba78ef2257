"""Where values of a document stand on its pages: an inverted index as a join, then one sweep a page.

Every value gives the hash of its document and all its words (of the first RUN, if it has more), every page those of its runs
of as many neighbouring words, as far as a table of bits of all values' hashes has them. They meet in an equi-join, so a
value is only tried on pages that hold its words one after another: what meets grows as the places that values have, however
many values start alike, and no task or row holds a document's values. What passes through the driver is the table of
bits, of MOST bits at most; with more values than it can tell apart more runs reach the join, where hashes are compared in
full. What met is ordered by page: its text, the spans it has, then the values in their order, and one pass over this
stream settles each page with its text and taken spans in memory, however many values there are.

An index that is stored before the values are known (index_of, for plans.incremental) has the distinct words and pairs of
neighbouring words of each page, and values meet it by the pair (or the only word) that they start with.

Words are told apart by 64-bit hashes; values are verified on the text, so equal hashes only cost a try.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.functions.text import flex_pattern
from inkveil.functions.text import plain_py as plain
from inkveil.operators.detect import _KINDS, _NAMES, REGIONS
from inkveil.operators.store import spread, stored

_WORDS = re.compile(r"\w+")
_WHITE = re.compile(r"[^\S ]")
ROWS = 5000
#: Values of a page that are looked for one by one.
FEW = 256
#: Rows of the index that a task holds at once.
INDEX_ROWS = 100_000
#: Words of a value that are compared in the index; the logarithms of the least and most bits of the table, and of one part of it.
RUN, LEAST, MOST, PART = 16, 20, 28, 20
_FACTORS = np.random.Generator(np.random.PCG64(37)).integers(1, 1 << 63, RUN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Characters of texts whose words are hashed at once; the base of the hash; what _Letters has for characters that were not met.
CHUNK, BASE, _UNMET = 1_000_000, np.uint64(0xA24BAED4963EE407), np.uint32(0xFFFFFFFF)
#: What patterns that ignore case take for an i; casefold knows the other characters that they take for each other.
_ALIKE = {ord("İ"): "i", ord("ı"): "i"}


def _hash(words: str) -> int:
    return xxhash.xxh64_intdigest(words) - (1 << 63)


def page_words(text: str) -> set[int]:
    """Hashes of the words and neighbouring pairs of a page; 0 stands on every page, for values without words."""
    words = _WORDS.findall(plain(text).lower())
    return {0, *map(_hash, set(words)), *map(_hash, {f"{a} {b}" for a, b in zip(words, words[1:])})}  # noqa: B905


def key_words(key: str) -> int:
    """The hash under which pages that may hold a value are found."""
    words = _WORDS.findall(key)[:2]
    return _hash(" ".join(words)) if words else 0


def _index_rows(docs: list[str], pages: list[int], hashes: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(pages, pa.int64()), pa.array(hashes, pa.int64())], names=["doc_id", "page_number", "words"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, pages, hashes = [], [], []
        for doc, page, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page_number", "text")), strict=True):
            if doc is not None and text:
                found = page_words(text)
                docs += [doc] * len(found)
                pages += [page] * len(found)
                hashes += found
            if len(docs) >= INDEX_ROWS:
                yield _index_rows(docs, pages, hashes)
                docs, pages, hashes = [], [], []
        if docs:
            yield _index_rows(docs, pages, hashes)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("words", pa.array([key_words(k) for k in batch.column("key").to_pylist()], pa.int64()))


def index_of(pages: DataFrame) -> DataFrame:
    """The inverted index of pages (doc_id, page_number, text): doc_id, page_number and words, a hash of what stands there."""
    return pages.mapInArrow(_index, "doc_id string, page_number long, words long")


def candidates(keys: DataFrame, index: DataFrame) -> DataFrame:
    """keys (doc_id, key and others) with page_number of each page of the document that holds their first words."""
    keyed = keys.mapInArrow(_keyed, T.StructType([*keys.schema.fields, T.StructField("words", T.LongType())]))
    return index.join(keyed, ["doc_id", "words"]).drop("words")


def _alike(words: str) -> str:
    """A form that words share which are the same but for case."""
    return words.lower() if words.isascii() else words.translate(_ALIKE).casefold()


class _Letters:
    """What each character counts as in a word: a number that characters share which are the same but for case and accents;
    0 if it stands in none. Worked out when a character is first met."""

    def __init__(self):
        self.table = np.full(0x110000, _UNMET, np.uint32)

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        found = self.table[codes]
        unmet = found == _UNMET
        if unmet.any():
            for code in np.unique(codes[unmet]).tolist():
                c = plain(chr(code))
                same = _alike(c) if _WORDS.match(c) else "\0"
                self.table[code] = ord(same) if len(same) == 1 else xxhash.xxh32_intdigest(same) >> 1
            found = self.table[codes]
        return found


_letters = _Letters()


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE, and of its inverse."""
    out = np.full((2, n), [[BASE], [np.uint64(pow(int(BASE), -1, 1 << 64))]], np.uint64)
    out[:, 0] = 1
    return tuple(np.cumprod(out, 1))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts, one after another, and where the words of each text begin and end among them."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    letters = _letters[codes]
    inside = np.concatenate([[False], letters != 0])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(starts, first)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    up, down = _powers(1 << max(16, len(codes).bit_length()))
    h = np.add.reduceat(letters * up[: len(codes)], starts) * down[starts]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15), bounds


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of CHUNK characters or one text."""
    begun = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield begun, k
            begun, size = k, 0
        size += len(t) + 1
    if size:
        yield begun, len(texts)


def _mixed(total: np.ndarray, docs: np.ndarray) -> np.ndarray:
    h = total ^ docs
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _doc_hashes(docs: list[str]) -> np.ndarray:
    known = {d: xxhash.xxh64_intdigest(d, 1) for d in set(docs)}
    return np.array([known[d] for d in docs], np.uint64)


def slots(h: np.ndarray, log: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of hashes in a table of 2^log."""
    return h >> np.uint64(64 - log), (h >> np.uint64(4)) & np.uint64((1 << log) - 1)


def _begins(pairs: np.ndarray) -> np.ndarray:
    """Hashes for the table of bits by which pairs of words are known to begin longer values."""
    return pairs * np.uint64(0xD6E8FEB86659FD93)


def _run_keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys with the hash of their document and words, how many words that are, and of the first two words of more; 0 and 0 for
    keys without words."""
    for batch in batches:
        keys, docs = batch.column("key").to_pylist(), _doc_hashes(batch.column("doc_id").to_pylist())
        found, sizes, pairs = (np.zeros(len(keys), t) for t in (np.uint64, np.int32, np.uint64))
        for lo, hi in chunks(keys):
            words, bounds = word_hashes(keys[lo:hi])
            first, n = bounds[:-1], np.minimum(np.diff(bounds), RUN)
            total, doc = np.zeros(hi - lo, np.uint64), docs[lo:hi]
            for k in range(int(n.max())):
                more = np.flatnonzero(n > k)
                total[more] += words[first[more] + k] * _FACTORS[k]
                if k == 1:
                    pairs[lo:hi] = np.where(n > 2, _mixed(total, doc), 0)
            found[lo:hi], sizes[lo:hi] = np.where(n > 0, _mixed(total, doc), 0), n
        yield batch.append_column("words", pa.array(found.view(np.int64))).append_column("n", pa.array(sizes)).append_column("pair", pa.array(pairs.view(np.int64)))


def _bits(log: int):
    """Parts of the table of bits: number and bytes, from rows dealt out by the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            for part in np.unique(slot >> PART).tolist():
                bits = parts.setdefault(part, np.zeros(1 << PART, bool))
                bits[slot[slot >> PART == part] & ((1 << PART) - 1)] = True
        for part, bits in parts.items():
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    return run


def bit_table(keyed: DataFrame, log: int) -> bytes:
    """2^log bits, of which those of the hashes of all keys, and of the pairs that longer ones begin with, are set."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, pairs = (batch.column(c).to_numpy() for c in ("words", "n", "pair"))
            found = np.concatenate([words.view(np.uint64), _begins(np.unique(pairs[n > 2]).view(np.uint64))])
            yield pa.record_batch([pa.array(np.unique(np.concatenate(slots(found, log))).astype(np.int64))], names=["slot"])

    rows = keyed.where("n > 0").select("words", "n", "pair").mapInArrow(both, "slot long")
    table = bytearray((1 << log) // 8)
    size = (1 << PART) // 8
    for row in rows.repartition(F.shiftright("slot", PART)).mapInArrow(_bits(log), "part long, bits binary").toLocalIterator():  # 2^(log - PART) rows at most
        table[row.part * size : (row.part + 1) * size] = row.bits
    return bytes(table)


def _held(lengths: set[int], log: int, table):
    """Rows (doc_id, page_number, words) of pages: hashes of their runs that are in the table of bits; 0 if there are keys without
    words. Runs of three words or more are only made where two stand that a value begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint8)

        def set_(slot: np.ndarray) -> np.ndarray:
            return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1

        def hits(h: np.ndarray) -> np.ndarray:
            a, b = slots(h, log)
            may = np.flatnonzero(set_(a))
            return may[set_(b[may])]

        def runs(texts: list[str], docs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            words, bounds = word_hashes(texts)
            page = np.repeat(np.arange(len(texts)), np.diff(bounds))
            at, total, left = np.arange(len(words)), np.zeros(len(words), np.uint64), bounds[1:][page] - np.arange(len(words))
            for n in range(1, max(lengths, default=0) + 1):
                longer = left >= n
                at, total, left = at[longer], total[longer], left[longer]
                total += words[at + (n - 1)] * _FACTORS[n - 1]
                if n not in lengths and n != 2:
                    continue
                h = _mixed(total, docs[page[at]])
                if n in lengths:
                    may = hits(h)
                    yield page[at[may]], h[may].view(np.int64)
                if n == 2:
                    may = hits(_begins(h))
                    at, total, left = at[may], total[may], left[may]

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            docs = batch.column("doc_id").to_pylist()
            seeds = _doc_hashes([d or "" for d in docs])
            for lo, hi in chunks(texts):
                found = [*runs(texts[lo:hi], seeds[lo:hi])]
                if 0 in lengths:
                    found.append((np.arange(hi - lo), np.zeros(hi - lo, np.int64)))
                if not found:
                    continue
                page, h = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((h, page))
                page, h = page[order], h[order]
                new = np.concatenate([[True], (page[1:] != page[:-1]) | (h[1:] != h[:-1])])[: len(page)]
                page, h = page[new] + lo, h[new]
                for k in range(0, len(page), INDEX_ROWS):
                    here = pa.array(page[k : k + INDEX_ROWS])
                    rows = pa.table([batch.column("doc_id").take(here), batch.column("page_number").take(here), pa.array(h[k : k + INDEX_ROWS])], names=["doc_id", "page_number", "words"])
                    yield from rows.to_batches()

    return run


def met(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """keys (doc_id, key and others) with page_number of each page of the document that holds their words one after another."""
    keyed = stored(keys.mapInArrow(_run_keyed, T.StructType([*keys.schema.fields, T.StructField("words", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("pair", T.LongType())])))
    sizes = {r.n: r.rows for r in keyed.groupBy("n").agg(F.count("*").alias("rows")).collect()}  # RUN + 1 rows at most
    log = min(MOST, max(LEAST, (16 * sum(rows * (1 + (n > 2)) for n, rows in sizes.items())).bit_length()))
    table = keys.sparkSession.sparkContext.broadcast(bit_table(keyed, log))
    index = spread(pages).mapInArrow(_held(set(sizes), log, table), "doc_id string, page_number long, words long")
    return index.join(keyed.drop("n", "pair"), ["doc_id", "words"]).drop("words")


_pattern = lru_cache(maxsize=4096)(flex_pattern)


@lru_cache(maxsize=100_000)
def _searched(key: str) -> str | None:
    """The form in which a key is looked for in Page.flat; None if it has white space that stays as it is."""
    return None if _WHITE.search(key) or "  " in key else _alike(key)


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Page:
    """One page in the sweep: its text, and where its words stand. The first FEW values are looked for in a form of the text in
    which case and kinds of white space are alike; where its words stand is only worked out for more of them, or if they
    may stand with more white space between their words."""

    def __init__(self, text: str):
        self.text, self.plain = text, plain(text)
        low, self.ascii = self.plain.lower(), self.plain.isascii()
        self.low = low if len(low) == len(text) else ""
        same = self.low if self.ascii else _alike(self.plain)
        self.flat = _WHITE.sub(" ", same) if len(same) == len(text) else None
        self.single, self.asked = self.flat is not None and "  " not in self.flat, 0

    @cached_property
    def at(self) -> dict[tuple[str, ...], list[int]]:
        at: dict[tuple[str, ...], list[int]] = defaultdict(list)
        last = None
        for m in _WORDS.finditer(self.plain):
            word = _alike(m.group())
            at[(word,)].append(m.start())
            if last:
                at[last[0], word].append(last[1])
            last = word, m.start()
        return at

    def like(self, key: str) -> str | None:
        """What stands in `flat` wherever key stands in the text, if that can be told."""
        return _searched(key) if self.flat is not None and (self.single or " " not in key) else None

    def starts(self, key: str, first: re.Match) -> Iterator[int]:
        """Places where key may start, from left to right."""
        self.asked += 1
        if self.asked <= FEW and (same := self.like(key)) is not None:
            at = self.flat.find(same)
            while at >= 0:
                yield at
                at = self.flat.find(same, at + 1)
            return
        for at in self.at.get(tuple(map(_alike, _WORDS.findall(key)[:2])), ()):
            yield at - first.start()

    def end(self, key: str, at: int) -> int:
        """Where key ends if it stands at a place, else 0. A pattern is only needed for letters beyond ASCII and for white space
        of varying length, and only where the text is like the key."""
        if at < 0 or at and _in_word(self.plain[at - 1]):
            return 0
        end = at + len(key)
        if not self.low.startswith(key, at):
            same = self.like(key)
            if same is not None and not self.flat.startswith(same, at):
                return 0
            if same is None or not (self.ascii and key.isascii()):
                m = _pattern(key).match(self.plain, at)
                return m.end() if m else 0
        return 0 if end < len(self.plain) and _in_word(self.plain[end]) else end

    def read(self, key: str) -> Iterator[tuple[int, int]]:
        """Places of key as read from left to right, within words too; those that are bounded count, the others use up their text."""
        spaced = r"\s+".join(map(re.escape, key.split(" ")))
        return (m.span() for m in re.finditer(spaced, self.plain, re.IGNORECASE) if self.end(key, m.start()))

    def find(self, key: str) -> Iterator[tuple[int, int]]:
        first = _WORDS.search(key)
        if first is None or " " in key[: first.start()]:
            yield from (m.span() for m in _pattern(key).finditer(self.plain))
            return
        done = 0
        for at in self.starts(key, first):
            if at >= done and (end := self.end(key, at)):
                done = end
                yield at, end


class Taken:
    """Spans by start, and the longest of them, so that few are looked at."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []
        self.longest = 0

    def add(self, start: int, end: int) -> None:
        insort(self.spans, (start, end))
        self.longest = max(self.longest, end - start)

    def covers_half(self, start: int, end: int) -> bool:
        """Whether one span covers at least half of [start, end)."""
        i = bisect_left(self.spans, (start - self.longest, 0))
        while i < len(self.spans) and self.spans[i][0] < end:
            a, b = self.spans[i]
            if min(end, b) - max(start, a) >= 0.5 * (end - start):
                return True
            i += 1
        return False


def _sweep(batches: Iterator[pa.RecordBatch], least: int, in_words: bool = False) -> Iterator[pa.RecordBatch]:
    """New regions of pages, from rows ordered by page and step: 0 texts, 1 taken spans, 2 values in their order."""
    names = ("doc_id", "page_number", "step", "text", "start", "end", "ord", "pii_type", "confidence", "source")
    here, pages, taken, number, rows = None, [], {}, least, []
    for batch in batches:
        for doc, page, step, text, start, end, order, kind, confidence, source in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if (doc, page) != here:
                here, pages, taken, number = (doc, page), [], defaultdict(Taken), least
            if step == 0:
                pages.append(Page(text))
            elif step == 1:
                taken[kind].add(start, end)
                number = max(number, order + 1)
            else:
                spans = taken[kind]
                for p in pages:
                    for s, e in p.read(text) if in_words else p.find(text):
                        if not spans.covers_half(s, e):
                            spans.add(s, e)
                            rows.append((doc, page, number, s, e, p.text[s:e], kind, confidence, source))
                            number += 1
        if len(rows) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def occurrences(keys: DataFrame, regions: DataFrame, pages: DataFrame, least: int, index: DataFrame | None = None, in_words: bool = False) -> DataFrame:
    """New regions for all occurrences of keys on all pages of their documents.

    keys: doc_id, key, pii_type, confidence, source and turn, the order in which values are tried on a page; an
    occurrence counts unless a span of its type covers half of it: one of regions, or one found before it. New
    regions are numbered on after those of their page, from `least` at least, so (document, page, ord) stays unique.
    Values or pages without a doc_id, and values or texts that are null, give nothing; rows that repeat a page
    share its numbers and spans. index: that of these pages, if it is stored. in_words: values are read within words
    too (see Page.read)."""
    pages = pages.select(F.col("doc_id").cast("string"), F.col("page_number").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    keys = keys.where("doc_id IS NOT NULL AND key IS NOT NULL")
    found = stored(met(keys, pages) if index is None else candidates(keys, index))
    none = lambda kind: F.lit(None).cast(kind)
    turn = keys.schema["turn"].dataType
    value = found.select("doc_id", "page_number", F.lit(2).alias("step"), F.col("key").alias("text"), none("int").alias("start"), none("int").alias("end"), none("int").alias("ord"), "pii_type", "confidence", "source", "turn")
    here = found.select("doc_id", "page_number").distinct()
    text = pages.join(here, ["doc_id", "page_number"], "left_semi").select("doc_id", "page_number", F.lit(0).alias("step"), "text", *(none(k).alias(c) for c, k in (("start", "int"), ("end", "int"), ("ord", "int"), ("pii_type", "string"), ("confidence", "double"), ("source", "string"), ("turn", turn))))
    own = regions.join(here, ["doc_id", "page_number"], "left_semi").select("doc_id", "page_number", F.lit(1).alias("step"), none("string").alias("text"), "start", "end", "ord", "pii_type", none("double").alias("confidence"), none("string").alias("source"), none(turn).alias("turn"))
    context = pages.sparkSession.sparkContext
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * context.defaultParallelism)  # by their bytes alone, rows would be too few tasks for what each costs
    rows = text.unionByName(own).unionByName(value).repartition(parts, "doc_id", "page_number").sortWithinPartitions("doc_id", "page_number", "step", "turn", "text")
    return rows.drop("turn").mapInArrow(lambda batches: _sweep(batches, least, in_words), REGIONS)
