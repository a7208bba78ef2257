from __future__ import annotations

import pytest

from inkveil.operators import structured


@pytest.mark.parametrize(("runs", "by", "out"), [
    (["Joh", "n S", "mith is"], {"John Smith": "[P00001]"}, ["[P00001]", "", " is"]), (["a John b"], {"John": "X"}, ["a X b"]), (["John", " and John"], {"John": "X"}, ["X", " and X"]),
    (["x", "y"], {"z": "1"}, ["x", "y"]), (["a", "b"], {"ab": "ab!"}, ["ab!", ""]), ([], {"a": "b"}, []), (["ab"], {"": "x", "a": "b", "b": "c"}, ["cc"]), (["aa", "a"], {"aa": "b"}, ["b", "a"]),
])
def test_runs_keep_what_is_not_replaced(runs, by, out):
    assert structured.replace_in_runs(runs, by) == out


def test_documents_of_runs(spark):
    paragraphs = spark.createDataFrame([("d", 1, ["Jo", "hn x"]), ("d", 2, None), ("e", 1, ["John"])], "doc_id string, paragraph int, runs array<string>")
    by = spark.createDataFrame([("d", 2, "X", "Y"), ("d", 1, "John", "X")], "doc_id string, ord int, original string, replacement string")
    got = {(r.doc_id, r.paragraph): r.runs for r in structured.redact_runs(paragraphs, by).collect()}
    assert got == {("d", 1): ["Y", " x"], ("d", 2): None, ("e", 1): ["John"]}


def test_cells_there_and_back(spark):
    table = spark.createDataFrame([("r1", "John and Ann", 5, None), ("r2", "none", 6, "Ann")], "id string, a string, n int, b string")
    hidden = structured.redact_cells(table, [("John", "[P00001]"), ("Ann", "[P00002]"), ("", "x")], ("id",))
    assert sorted(map(tuple, hidden.collect())) == [("r1", "[P00001] and [P00002]", 5, None), ("r2", "none", 6, "[P00002]")]
    vault = spark.createDataFrame([("[P00001]", "John"), ("[P00002]", "Ann")], "token_string string, original_text string")
    assert sorted(map(tuple, structured.restore_cells(hidden, vault, "id").collect())) == sorted(map(tuple, table.collect()))
    assert structured.restore_cells(hidden, vault.limit(1), "id").where("a LIKE '%[P0000%' OR b LIKE '%[P0000%'").count() >= 1
    assert structured.redact_cells(table.select("n"), [("a", "b")]).columns == ["n"]
