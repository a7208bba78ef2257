"""Boxes against boxes, words from characters, and boxes drawn by hand."""

from __future__ import annotations

import math
import random
import statistics

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from inkveil import queries_geometry
from inkveil.operators import boxes, geometry
from inkveil.operators.spans import Config

BOXES = "doc_id string, page_number long, n int, x0 double, y0 double, x1 double, y1 double, text string"


def covers(a, b):
    w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
    area = lambda r: max((r[5] - r[3]) * (r[6] - r[4]), 1)
    return a[:2] == b[:2] and w > 0 and h > 0 and w * h > 0.5 * min(area(a), area(b))


def some_boxes(rng, n):
    out = []
    for k in range(n):
        x, y = rng.uniform(-50, 600), rng.uniform(-50, 800)
        w, h = rng.choice([(rng.uniform(1, 80), rng.uniform(4, 20)), (rng.uniform(0.1, 2), rng.uniform(0.1, 2)), (400, 500)])
        out.append((rng.choice(["a", "b", None]), rng.choice([1, 2]), k, x, y, x + w, y + h, f"t{k}"))
    return out


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e6])
def test_ocr_merge_is_as_brute_force(spark, scale):
    rng = random.Random(4)
    words, ocr = some_boxes(rng, 150), some_boxes(rng, 150)
    ocr += [(*w[:3], *(c + 1 for c in w[3:7]), "moved") for w in words[:30]] + words[:5] + ocr[:5]
    scaled = lambda rows: [(*r[:3], *(c * scale for c in r[3:7]), r[7]) for r in rows]
    words, ocr = scaled(words), scaled(ocr)
    odd = [("a", 1, 900, None, 0.0, 5.0, 5.0, "null"), ("a", 1, 901, 0.0, 0.0, float("inf"), 5.0, "far"), ("a", 1, 902, float("nan"), 0.0, 5.0, 5.0, "nan"), ("a", 1, 903, 9.0, 9.0, 5.0, 5.0, "turned")]
    got = geometry.merge_ocr(spark.createDataFrame(words, BOXES), spark.createDataFrame(ocr + odd, BOXES))
    expected = words + [o for o in ocr if not any(covers(o, w) for w in words)] + odd
    assert sorted((str(r.doc_id), r.n, r.text) for r in got.collect()) == sorted((str(r[0]), r[2], r[7]) for r in expected)
    assert scale < 1 or len(words) + len(odd) < len(expected) < len(words) + len(ocr)  # areas count as 1 at least


def test_the_share_is_exceeded(spark):
    words = spark.createDataFrame([("a", 1, 0, 0.0, 0.0, 10.0, 10.0, "w")], BOXES)
    ocr = spark.createDataFrame([("a", 1, 1, 5.0, 0.0, 15.0, 10.0, "half"), ("a", 1, 2, 4.9, 0.0, 14.9, 10.0, "more"), ("a", 1, 3, 0.0, 0.0, 0.5, 0.5, "dot"), ("b", 1, 4, 0.0, 0.0, 10.0, 10.0, "other")], BOXES)
    assert {r.text for r in geometry.merge_ocr(words, ocr).collect()} == {"w", "half", "dot", "other"}
    none = words.limit(0)
    assert geometry.merge_ocr(none, ocr).count() == 4 and geometry.merge_ocr(words, none).count() == 1


CHARS = "doc_id string, page_number long, i int, ch string, left double, bottom double, right double, top double, bold boolean, italic boolean, font_size double, font_family string, page_height double"


def set_chars(text, rise=0.0, heights=None, bold=()):
    return [("d", 1, i, c, 6.0 * i, 700 + rise * i, 6.0 * i + 5, 700 + rise * i + (heights or {}).get(c, 10.0), i in bold, None, 9.0 + i, f"f{i}", 800.0) for i, c in enumerate(text)]


def words_of(spark, rows):
    return {r.text: r for r in geometry.assemble_words(spark.createDataFrame(rows, CHARS).repartition(3)).collect()}


def test_words_of_characters(spark):
    got = words_of(spark, set_chars("  ab cde f \n", bold=(2, 3, 5, 6)))
    assert {t: r.word_index for t, r in got.items()} == {"ab": 0, "cde": 1, "f": 2}
    r = got["cde"]
    assert (r.x0, r.y0, r.x1, r.y1, r.is_bold, r.is_italic, r.font_size, r.font_family) == (30.0, 90.0, 47.0, 100.0, True, False, 14.0, "f5")
    assert got["ab"].is_bold and not got["f"].is_bold
    assert words_of(spark, []) == {} and words_of(spark, set_chars(" \t\x1f ")) == {}


@pytest.mark.parametrize("rise, kept", [(0.0, True), (3.25, True), (3.26, False), (-3.25, True), (-3.3, False)])
def test_spread_of_centres_at_its_threshold(spark, rise, kept):
    """Three characters of height 10: their centres spread over twice the rise; 6.5 is the most."""
    assert ("abc" in words_of(spark, set_chars("abc", rise))) == kept


@pytest.mark.parametrize("height, kept", [(6.9, True), (7.0, False), (3.0, True)])
def test_low_characters_do_not_turn_a_word(spark, height, kept):
    """A mark of under 0.7 of the median height is left out; at 0.7 its far centre counts."""
    rows = set_chars("abc.", heights={".": height})
    rows[3] = (*rows[3][:5], 720.0, rows[3][6], 720.0 + height, *rows[3][8:])
    assert ("abc." in words_of(spark, rows)) == kept


def test_rotated_words_keep_their_number(spark):
    got = words_of(spark, [*set_chars("ab ", 0.0), *((*r[:2], r[2] + 3, *r[3:]) for r in set_chars("xyzxyz", 9.0)), *((*r[:2], r[2] + 9, *r[3:]) for r in set_chars(" cd"))])
    assert {t: r.word_index for t, r in got.items()} == {"ab": 0, "cd": 2}


def test_words_in_order_cross_batches_and_pages(spark):
    """Characters that stand in order are not shuffled; words may end with a batch, a page or neither."""
    rng = random.Random(7)
    rows = []
    for d in (None, "a", "b"):
        for p in (1, None, 3):
            text = "".join(rng.choice("ab. \t,") if rng.random() < 0.5 else "c" for _ in range(rng.randrange(0, 120)))
            chars = set_chars(text, rng.choice([0.0, 4.0]), {".": 3.0, ",": 7.0}, bold=range(0, 90, 2))
            rows += [(d, p, r[2], r[3] if rng.random() < 0.95 else None, *(None if rng.random() < 0.05 else x for x in r[4:8]), *r[8:]) for r in chars]
    df = spark.createDataFrame(rows, CHARS)
    apart = sorted(map(repr, geometry.assemble_words(df.repartition(5)).collect()))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        for n in (1, 2, 7, 10_000):
            spark.conf.set(size, n)
            found = geometry.assemble_in_order(df.coalesce(1))
            assert sorted(map(repr, found.collect())) == apart and len(apart) > 20
    finally:
        spark.conf.unset(size)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def random_pages(rng):
    """Characters of pages in order, with gaps, nulls, askew lines and heights that differ."""
    rows = []
    for d in (None, "a", "b"):
        for p in (1, None, 3):
            text = "".join(rng.choice("ab. \t,") if rng.random() < 0.5 else "é" for _ in range(rng.randrange(0, 120)))
            chars = set_chars(text, rng.choice([0.0, 4.0]), {".": 3.0, ",": 7.0, "a": 8.5}, bold=range(0, 90, 2))
            rows += [(d, p, r[2], r[3] if rng.random() < 0.95 else None, *(None if rng.random() < 0.05 else x for x in r[4:8]), *r[8:]) for r in chars]
    return rows


def test_words_of_extracted_characters(spark):
    """Characters that an extractor gives in the task are cut as those of a table, wherever its batches end."""
    rows = random_pages(random.Random(11))
    apart = sorted(map(repr, geometry.assemble_words(spark.createDataFrame(rows, CHARS).repartition(5)).collect()))
    pages = spark.createDataFrame(list(dict.fromkeys(r[:2] for r in rows)), "doc_id string, page_number long").coalesce(1)
    kinds = dict(doc_id=pa.string(), page_number=pa.int64(), ch=pa.string(), left=pa.float64(), bottom=pa.float64(), right=pa.float64(), top=pa.float64(), bold=pa.bool_(), italic=pa.bool_(), font_size=pa.float64(), font_family=pa.string(), page_height=pa.float64())
    for n in (1, 2, 7, 10_000):

        def extract(batch, n=n):
            keys = list(zip(batch.column("doc_id").to_pylist(), batch.column("page_number").to_pylist(), strict=True))
            chars = [r[:2] + r[3:] for k in keys for r in rows if r[:2] == k]
            for k in range(0, len(chars), n):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*chars[k : k + n], strict=True), kinds.values(), strict=True)], names=list(kinds))

        found = geometry.assemble_extracted(pages, extract)
        assert sorted(map(repr, found.collect())) == apart and len(apart) > 20


def test_blank_characters_are_those_of_tables(spark):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000] + ["", "  ", " a", "\n", None]
    found = geometry._marked(pa.record_batch({"ch": pa.array(every)})).column("blank").to_pylist()
    blank = {c for c, b in zip(every, found, strict=True) if b}
    chars = spark.createDataFrame([(c,) for c in [*blank, *every[:0x3100], *every[-5:]]], "ch string").distinct()
    seen = {r.ch for r in chars.where("coalesce(ch, '') RLIKE '(?U)^[\\\\s\\\\x1c-\\\\x1f]*$'").collect()}
    assert seen == blank and {None, "", " ", "\x1c", "\u3000"} < blank


def test_medians():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 9, 500)
    height = np.where(rng.random(size.sum()) < 0.1, np.nan, rng.choice([3.0, 7.0, 10.0, 0.1, np.inf], size.sum()))
    height[rng.random(len(height)) < 0.2] = rng.random()
    at = np.cumsum(size) - size
    expected = [statistics.median([x for x in height[a : a + n] if x == x] or [np.nan]) for a, n in zip(at, size, strict=True)]
    assert np.array_equal(geometry._medians(height, at, size), expected, equal_nan=True) and np.isnan(expected).any()


ODD_TEXTS = [(0, "ill, al. "), (1, ""), (-6, "é漢😀 l\u00a0i"), (None, "null id. x"), (7, "x" * 200 + " " + "ab, " * 100), (-7, "ü"), (2**62, " big  "), (6, "a\nb\x1cc" * 40)]


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1 << 16])
def test_texts_are_set_from_any_window(size):
    """Characters, places and styles are those of a loop over the characters of each text, wherever windows end."""
    expected = []
    for doc, text in ODD_TEXTS:
        for i, c in enumerate(text):
            slant = i % 90 * (1 + int(math.fmod(doc, 3))) if doc is not None and math.fmod(doc, 5) < 2 else 0
            bottom = 780.0 - i // 90 % 60 * 12 + slant
            styles = (doc is not None and (i * 7 + doc) % 3 == 0, doc is not None and (i + doc) % 2 == 0)
            expected.append((doc, 1, c, i % 90 * 6.0, i % 90 * 6.0 + 5, bottom, bottom + {".": 3, ",": 3, "i": 7, "l": 7}.get(c, 10), 792.0, *styles, 9.0 + i // 90 % 3, "f"))
    docs, texts = zip((9, "before"), *ODD_TEXTS, (9, "after"), strict=True)
    batch = pa.record_batch({"doc_id": pa.array(docs, pa.int64()), "page_number": pa.array([1] * len(docs), pa.int32()), "text": pa.array(texts)}).slice(1, len(ODD_TEXTS))
    found = [tuple(r.values()) for c in queries_geometry._set(batch, size) for r in c.to_pylist()]
    assert found == expected
    assert not list(queries_geometry._set(batch.slice(1, 1), size)) and not list(queries_geometry._set(batch.slice(0, 0), size))


def test_characters_are_no_rows(spark, tmp_path):
    """A character that is a row of Spark's, or passes to Python as one, costs as much as hundreds of bytes of text."""
    texts = [(d, t.replace("\u00a0", " ").replace("\x1c", "\t")) for d, t in ODD_TEXTS if d is not None] + [(8, None), (9, "  \n ")]  # blank in SQL, too
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = entry.queries()["assembled_words"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.sql(entry.oracle_sql()["assembled_words"])
    assert found.columns == expected.columns
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected.fetchall())) and len(found.collect()) > 150
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


WORDS = "doc_id string, page_number long, n int, text string, x0 double, y0 double, x1 double, y1 double"
DRAWN = "box_id int, doc_id string, page_number long, x0 double, y0 double, x1 double, y1 double, pii_type string, text string"
PAGES = "doc_id string, page_number long, width double, height double"
REGIONS = "region_id string, doc_id string, page_number long, ord int, text string, pii_type string, action string, x0 double, y0 double, x1 double, y1 double"


@pytest.fixture(scope="module")
def page(spark):
    lines = [("Anna", 50, 100), ("Smith", 90, 100), ("lives", 50, 115), ("Far", 400, 100), ("Column", 440, 100), ("a@example.org", 50, 300)]
    words = [("d", 1, k, t, float(x), float(y), x + 30.004, y + 10.0) for k, (t, x, y) in enumerate(lines)]
    return spark.createDataFrame(words, WORDS), spark.createDataFrame([("d", 1, 600.0, 800.0)], PAGES)


def drawn(spark, *rows):
    return spark.createDataFrame([(k, "d", 1, *map(float, r), "PERSON", None) for k, r in enumerate(rows)], DRAWN)


def test_words_under_a_box(spark, page):
    rows = boxes.words_in_boxes(drawn(spark, (40, 95, 130, 130), (40, 90, 300, 112), (40, 90, 480, 112), (250, 90, 480, 112), (64, 99, 66, 106), (0, 500, 50, 520)), page[0])
    got = {r.box_id: r for r in rows.collect()}
    assert [got[k].text for k in range(6)] == ["Anna Smith lives", "Anna Smith", "Anna Smith", "Far Column", "Anna", boxes.NOTHING]
    assert (got[1].x0, got[1].y0, got[1].x1, got[1].y1) == (50.0, 100.0, 120.0, 110.0)
    assert (got[5].x0, got[5].y0, got[5].x1, got[5].y1) == (0.0, 500.0, 50.0, 520.0)


def test_manual_regions_double_nothing(spark, page):
    words, pages = page
    old = spark.createDataFrame([
        ("same", "d", 1, 3, "ANNA  Smith", "ORG", "PENDING", 500.0, 104.0, 510.0, 108.0), ("later", "d", 1, 4, "anna smith", "ORG", None, 50.0, 100.0, 120.0, 110.0),
        ("whole", "d", 1, 5, "Far Column x", "ORG", "REMOVE", 400.0, 100.0, 480.0, 110.0), ("gone", "d", 1, 0, "lives", "ORG", "CANCEL", 50.0, 115.0, 80.0, 125.0), ("part", "d", 1, 1, "Anna", "PERSON", "PENDING", 50.0, 100.0, 80.0, 110.0),
    ], REGIONS)
    added = boxes.add_manual(drawn(spark, (40, 95, 130, 112), (410, 95, 430, 112), (40, 114, 90, 126), (-20, 700, 900, 1000), (40, 95, 90, 130)), words, pages, old)
    got = {r.box_id: r for r in added.collect()}
    assert [(got[k].text, got[k].region_id) for k in range(5)] == [("Anna Smith", "same"), ("Far", "whole"), ("lives", None), (boxes.NOTHING, None), ("Anna lives", None)]
    assert (got[3].x0, got[3].y0, got[3].x1, got[3].y1) == (0.0, 700.0, 600.0, 800.0)


def test_reanalysis_of_a_box(spark, page):
    got = {r.box_id: tuple(r)[1:] for r in boxes.reanalyze(drawn(spark, (40, 290, 300, 320), (40, 95, 130, 112), (0, 500, 50, 520)), page[0], Config(language="en", names=frozenset({"anna"}))).collect()}
    assert got[0][:2] == ("a@example.org", "EMAIL") and got[0][2] > 0.5 and got[0][3] == "REGEX"
    assert got[1] == ("Anna Smith", "PERSON", 0.5, "NER") and got[2] == ("", "CUSTOM", 0.0, "MANUAL")
