"""Geometry between tables: words from characters, and boxes of one table that no box of another covers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.operators.keys import join_nulls

PAGE = ["doc_id", "page_number"]
BOX = ["x0", "y0", "x1", "y1"]
#: Cells a page is cut into along its longer side.
CELLS = 32
#: Characters lower than this share of a word's median height (points, accents) say nothing about its direction.
LOW = 0.7
#: A word is rotated if the centres of its characters spread over more than this share of their mean height.
SPREAD = 0.65


def _changes(keys: list[pa.Array]) -> np.ndarray:
    """For each row but the first whether its keys differ from those of the row before; nulls are equal."""
    out = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        a, b = k.slice(1), k.slice(0, len(k) - 1)
        same = pc.equal(a, b)
        if k.null_count:
            same = pc.or_(pc.fill_null(same, False), pc.and_(pc.is_null(a), pc.is_null(b)))
        out |= ~same.to_numpy(zero_copy_only=False)
    return out


def _medians(height: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The median height of each word without regard to NaN; words begin at `at`."""
    low, high = np.fmin.reduceat(height, at), np.fmax.reduceat(height, at)
    mixed = np.flatnonzero(low < high)  # the heights of all other words are one
    if len(mixed):
        size = size[mixed]
        begin = np.cumsum(size) - size
        some = height[np.repeat(at[mixed] - begin, size) + np.arange(size.sum())]
        kinds = np.unique(some)  # NaN is the last
        code = np.repeat(np.arange(len(mixed)) * len(kinds), size) + np.searchsorted(kinds, some)
        code.sort()
        known = size - np.add.reduceat(np.isnan(some), begin, dtype=np.int64)
        middle = [kinds[code[begin + k] % len(kinds)] for k in ((known - 1) // 2, known // 2)]
        low[mixed] = np.where(middle[0] == middle[1], middle[0], middle[0] * 0.5 + middle[1] * 0.5)
    return low


def _words(rows: pa.RecordBatch, counted: int) -> tuple[pa.RecordBatch | None, int]:
    """The words of whole words' characters in order, and how many the last page has; `counted`: how many the first page had before."""
    turns = _changes([rows.column(c) for c in PAGE])
    inked = ~rows.column("blank").to_numpy(zero_copy_only=False)
    opens, closes = inked.copy(), inked.copy()
    opens[1:] &= ~inked[:-1] | turns
    closes[:-1] &= ~inked[1:] | turns
    first = np.flatnonzero(opens)
    size = np.flatnonzero(closes) - first + 1
    starts = np.flatnonzero(turns) + 1
    pages = np.searchsorted(starts, first, "right")
    number = np.arange(len(first)) - np.searchsorted(pages, pages) + np.where(pages == 0, counted, 0)
    count = int((pages == len(starts)).sum()) + (counted if not len(starts) else 0)
    if not len(first):
        return None, count
    inked = np.flatnonzero(inked)
    at = np.cumsum(size) - size
    real = lambda c: np.asarray(rows.column(c).to_numpy(zero_copy_only=False), float)[inked]
    flag = lambda c: np.add.reduceat(pc.fill_null(rows.column(c), False).to_numpy(zero_copy_only=False)[inked], at, dtype=np.int64) * 2 > size
    bottom, top = real("bottom"), real("top")
    height, high_page = top - bottom, np.fmax.reduceat(real("page_height"), at)
    says = height >= np.repeat(_medians(height, at, size) * LOW, size)
    said = np.add.reduceat(says, at, dtype=np.int64)
    centre = (bottom + top) / 2
    spread_ = np.maximum.reduceat(np.where(says, centre, -np.inf), at) - np.minimum.reduceat(np.where(says, centre, np.inf), at)
    rotated = (said >= 2) & (spread_ > np.add.reduceat(np.where(says, height, 0.0), at) / np.maximum(said, 1) * SPREAD)
    ch = rows.column("ch").take(pa.array(inked))
    _, offsets, held = ch.buffers()
    offsets = np.frombuffer(offsets, np.int32)[ch.offset : ch.offset + len(ch) + 1]
    text = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(offsets[at], offsets[-1]).astype(np.int32).tobytes()), held)
    box = [np.fmin.reduceat(real("left"), at), high_page - np.fmax.reduceat(top, at), np.fmax.reduceat(real("right"), at), high_page - np.fmin.reduceat(bottom, at)]
    heads = pa.array(first)
    head = lambda c: rows.column(c).take(heads)
    out = [*map(head, PAGE), pa.array(number.astype(np.int32)), text, *(pa.array(x, from_pandas=True) for x in box), pa.array(flag("bold")), pa.array(flag("italic")), head("font_size"), head("font_family")]
    return pa.record_batch(out, names=[*PAGE, "word_index", "text", *BOX, "is_bold", "is_italic", "font_size", "font_family"]).filter(pa.array(~rotated)), count


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of characters in order; the characters of a word that a batch does not end are held."""
    held, before, count = [], None, 0  # batches of an unfinished word, the last row settled, words of its page

    def settled(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal before, count
        rows = pa.concat_batches(parts) if len(parts) > 1 else parts[0]
        if before is not None and _changes([pa.concat_arrays([before.column(c), rows.column(c).slice(0, 1)]) for c in PAGE])[0]:
            count = 0
        words, count = _words(rows, count)
        before = parts[-1].slice(parts[-1].num_rows - 1)
        if words is not None and words.num_rows:
            yield words

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = batch.column("blank").to_numpy(zero_copy_only=False).copy()  # rows that are blank or begin a page
        ends[1:] |= _changes([batch.column(c) for c in PAGE])
        if held:
            ends[0] |= _changes([pa.concat_arrays([held[-1].column(c).slice(held[-1].num_rows - 1), batch.column(c).slice(0, 1)]) for c in PAGE])[0]
        elif not ends[0]:
            ends[0] = True
        if ends.any():
            cut = len(ends) - 1 - int(ends[::-1].argmax())
            cut += bool(batch.column("blank")[cut].as_py())
            if cut or held:
                yield from settled([*held, batch.slice(0, cut)] if cut else held)
            held = [batch.slice(cut)] if cut < batch.num_rows else []
        else:
            held.append(batch)
    if held:
        yield from settled(held)


def _schema(pages: T.StructType, fonts: dict[str, T.DataType]) -> T.StructType:
    kinds = [(c, pages[c].dataType) for c in PAGE] + [("word_index", T.IntegerType()), ("text", T.StringType()), *((c, T.DoubleType()) for c in BOX)]
    kinds += [("is_bold", T.BooleanType()), ("is_italic", T.BooleanType()), *fonts.items()]
    return T.StructType([T.StructField(*k) for k in kinds])


def _marked(chars: pa.RecordBatch) -> pa.RecordBatch:
    """chars with the column blank, as assemble_in_order has it."""
    ch = chars.column("ch")
    blank = pc.or_(pc.utf8_is_space(ch), pc.equal(pc.binary_length(ch), 0))
    return chars.append_column("blank", pc.fill_null(blank, True))


def assemble_extracted(pages: DataFrame, extract: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """assemble_words for characters that are taken out of their pages by the task that reads those: only pages and words pass
    between Spark and Python, and a character is never a row of Spark's.

    `extract` gives the characters of a batch of `pages` (doc_id, page_number and whatever it reads) in order, in batches of a size that a
    task may hold, with all columns of assemble_words but i; positions and page_height are doubles, font_size a double, font_family a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _assembled(_marked(chars) for batch in batches for chars in extract(batch))

    return pages.mapInArrow(run, _schema(pages.schema, {"font_size": T.DoubleType(), "font_family": T.StringType()}))


def assemble_in_order(chars: DataFrame) -> DataFrame:
    """assemble_words for characters whose pages stand together in their partitions, in order of i, as an extractor or an
    explosion of pages gives them: nothing is shuffled or sorted, and a task holds a batch and the word that it does not end."""
    blank = F.coalesce(F.col("ch"), F.lit("")).rlike("(?U)^[\\s\\x1c-\\x1f]*$")
    real = [F.col(c).cast("double") for c in ("left", "bottom", "right", "top", "page_height")]
    rows = chars.select(*PAGE, "ch", *real, "bold", "italic", "font_size", "font_family", blank.alias("blank"))
    return rows.mapInArrow(_assembled, _schema(rows.schema, {c: rows.schema[c].dataType for c in ("font_size", "font_family")}))


def assemble_words(chars: DataFrame) -> DataFrame:
    """Words (doc_id, page_number, word_index, text, x0, y0, x1, y1, is_bold, is_italic, font_size, font_family) of characters
    (doc_id, page_number, i, ch, left, bottom, right, top, bold, italic, font_size, font_family, page_height), rotated ones left out.

    Words are the islands between blank characters: characters in order are cut at blanks, and each word is reduced to its box.
    y grows upwards for characters and downwards for words. Styles go by majority, font and
    size by the first character. Rotated words keep their number in word_index. Null characters count as blank,
    null boxes leave corners to the other characters; repeated positions are taken in any order."""
    return assemble_in_order(chars.repartition(*PAGE).sortWithinPartitions(*PAGE, "i"))


def _cells(low: str, high: str, size: Column) -> Column:
    return F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))


def covered(boxes: DataFrame, others: DataFrame, share: float = 0.5) -> DataFrame:
    """The distinct boxes (doc_id, page_number, x0, y0, x1, y1) that share more than `share` of the smaller area with one of others.

    Both tables are exploded to the cells of a grid and meet in an equi-join by page and cell; the grid of a page follows from
    how far its boxes reach, so a box lies in CELLS squared cells at most. Of the cells that a pair shares only the one
    with the corner of its intersection counts, so each pair is judged once. Boxes with a corner that is null, infinite
    or out of order cover nothing and are not covered."""
    sound = F.lit(True)
    for c in BOX:
        sound = sound & F.col(c).isNotNull() & (F.abs(c) < 1e15) & ~F.isnan(c)
    sound = sound & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    a, b = (t.where(sound).select(*PAGE, *(F.col(c).cast("double").alias(c) for c in BOX)).distinct() for t in (boxes, others))
    reach = F.greatest(*(F.max(F.abs(c)) for c in BOX)).alias("reach")
    reach = a.unionByName(b).groupBy(*PAGE).agg(reach).select(*PAGE, F.greatest(F.lit(1.0), F.col("reach") / CELLS).alias("cell"))
    celled = [join_nulls(t, reach, PAGE).select("*", _cells("x0", "x1", F.col("cell")).alias("cx")).select("*", _cells("y0", "y1", F.col("cell")).alias("cy")) for t in (a, b)]
    other = celled[1].select(*PAGE, "cx", "cy", *(F.col(c).alias(f"o_{c}") for c in BOX))
    met = join_nulls(celled[0], other, [*PAGE, "cx", "cy"])
    ix0, iy0 = F.greatest("x0", "o_x0"), F.greatest("y0", "o_y0")
    ix1, iy1 = F.least("x1", "o_x1"), F.least("y1", "o_y1")
    area = lambda p: F.greatest((F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0")), F.lit(1.0))
    once = (F.col("cx") == F.floor(ix0 / F.col("cell"))) & (F.col("cy") == F.floor(iy0 / F.col("cell")))
    hit = (ix0 < ix1) & (iy0 < iy1) & ((ix1 - ix0) * (iy1 - iy0) > share * F.least(area(""), area("o_")))
    return met.where(once & hit).select(*PAGE, *BOX).distinct()


def merge_ocr(words: DataFrame, ocr: DataFrame) -> DataFrame:
    """words and those words of ocr (with the same columns) that no word covers by half of the smaller area."""
    hidden = covered(ocr, words).withColumn("__hidden", F.lit(True))
    doubles = ocr.select(*ocr.columns, *(F.col(c).cast("double").alias(f"__{c}") for c in BOX))
    named = hidden.select(*PAGE, *(F.col(c).alias(f"__{c}") for c in BOX), "__hidden")
    kept = join_nulls(doubles, named, [*PAGE, *(f"__{c}" for c in BOX)], "left").where("__hidden IS NULL")
    return words.unionByName(kept.select(*ocr.columns))
