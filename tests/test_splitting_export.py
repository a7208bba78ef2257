"""Splits against the loop they replace, and exports that overwrite nothing."""

from __future__ import annotations

import random

from inkveil.operators import splitting
from inkveil.operators.search import split_sizes
from inkveil.sources import export

PAGES = "doc_id string, page long, size long"


def loop_sizes(sizes):
    known = [i for i, n in enumerate(sizes) if n is not None]
    out = []
    for i in range(len(sizes)):
        lo, hi = max((k for k in known if k <= i), default=None), min((k for k in known if k >= i), default=None)
        lo, hi = hi if lo is None else lo, lo if hi is None else hi
        out.append(0 if lo is None else sizes[lo] if lo == hi else int(sizes[lo] + (i - lo) / (hi - lo) * (sizes[hi] - sizes[lo])))
    return out


def test_split_is_as_the_loop(spark):
    rng, docs = random.Random(2), {}
    for k in range(25):
        n = rng.choice([1, 2, 7, 40, 130])
        docs[f"d{k}"] = [None if k % 3 == 0 and rng.random() < 0.6 else rng.choice([0, 1, rng.randrange(1, 400), 950, 1000, 1001, 5000]) for _ in range(n)]
    docs[None] = [600, 600, 300]
    docs["none"] = [None, None]
    rows = [(d, p, n) for d, sizes in docs.items() for p, n in enumerate(sizes)]
    rng.shuffle(rows)
    got = {}
    for r in splitting.split(spark.createDataFrame(rows, PAGES).repartition(4), 1000).collect():
        got.setdefault(r.doc_id, {})[r.page] = (r.size, r.part)
    for d, sizes in docs.items():
        sizes = loop_sizes(sizes)
        part = {p: k + 1 for k, (a, b) in enumerate(split_sizes(sizes, 1000)) for p in range(a, b + 1)}
        assert got[d] == {p: (n, part[p]) for p, n in enumerate(sizes)}, d
    assert splitting.split(spark.createDataFrame([], PAGES), 10).count() == 0


def test_pages_to_measure(spark):
    pages = spark.range(200).selectExpr("'a' AS doc_id", "id AS page").unionByName(spark.range(517).selectExpr("'b' AS doc_id", "id AS page"))
    got = {}
    for r in splitting.to_measure(pages).collect():
        got.setdefault(r.doc_id, set()).add(r.page)
    assert got == {"a": set(range(200)), "b": {*range(0, 517, 10), 516}}


def test_names_and_ids(spark):
    names = ["a/b\\c.pdf", "..hidden", 'x<>:"|?*y', None, "", "\x07"]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, n string").select("i", export.safe_name(export.F.col("n")).alias("n")).collect()
    assert [r.n for r in sorted(rows)] == ["c.pdf", "hidden", "x_______y", "document", "document", "_"]
    ids = ["ab-C_9", "", "a/b", "x" * 64, "x" * 65, None, "a\n"]
    rows = spark.createDataFrame(list(enumerate(ids)), "i int, n string").select("i", export.is_document_id(export.F.col("n")).alias("ok")).collect()
    assert [r.ok for r in sorted(rows)] == [True, False, False, True, False, False, False]


def test_two_exports_overwrite_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    names = spark.createDataFrame([("a", "Report.pdf"), ("b", "other/Report.docx"), ("c", None), ("d", "Plan (2).pdf")], "doc_id string, original_filename string")
    pages = spark.createDataFrame([(d, p, f"text {d}{p}") for d in "abcd" for p in (1, 2)], "doc_id string, page_number long, text string")
    first = {r.doc_id: r.file_name for r in export.export_texts(pages, names, folder).collect()}
    assert first == {"a": "Report_anonymized.txt", "b": "Report_anonymized (1).txt", "c": "document_anonymized.txt", "d": "Plan (2)_anonymized.txt"}
    second = {r.doc_id: r.file_name for r in export.export_texts(pages, names, folder).collect()}
    assert second == {"a": "Report_anonymized (2).txt", "b": "Report_anonymized (3).txt", "c": "document_anonymized (1).txt", "d": "Plan (2)_anonymized (1).txt"}
    back = spark.read.parquet(folder)
    assert back.count() == 16 and back.select("file_name").distinct().count() == 8
    assert {tuple(r) for r in back.where("file_name = 'Report_anonymized (3).txt'").select("doc_id", "page_number", "text").collect()} == {("b", 1, "text b1"), ("b", 2, "text b2")}


def test_numbers_fill_gaps(spark):
    wanted = spark.createDataFrame([("1", "x", ".zip"), ("2", "x", ".zip"), ("3", "x", ".pdf"), ("4", "x (1)", ".zip")], "doc_id string, stem string, extension string")
    standing = spark.createDataFrame([("x.zip",), ("x (2).zip",), ("x (9).zip",)], "name string")
    got = {r.doc_id: r.file_name for r in export.numbered_names(wanted, standing).collect()}
    assert got == {"1": "x (1).zip", "2": "x (3).zip", "3": "x.pdf", "4": "x (4).zip"}


def test_no_window_is_read_again_for_every_page(spark):
    """A frame that runs on to the end of a document costs the square of its pages."""
    pages = spark.createDataFrame([("d", k, 10 if k % 3 else None) for k in range(7)], "doc_id string, page long, size long")
    sized = splitting.with_sizes(pages)
    assert "unboundedfollowing" not in sized._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r["size"] for r in sized.orderBy("page").collect()] == [10] * 7
