from __future__ import annotations

import random

import pytest

from inkveil.functions.text import QUOTES, base_letter, plain_py
from inkveil.operators import layout, search, spans
from inkveil.operators.layout import Box, Word


def test_reading_order_and_offsets():
    words = [Word("world", 60, 51, 90, 63), Word("Hello", 20, 50, 50, 62), Word("below", 20, 80, 50, 92), Word("far", 400, 50, 420, 62)]
    text, offsets = layout.page_text(words)
    assert text == "Hello world\nfar\nbelow"
    assert all(text[a:b] == w.text for a, b, w in offsets)


def test_grid_text_keeps_words():
    text, offsets = layout.page_text(layout.grid_words("one two\nthree"))
    assert text == "one two\nthree" and len(offsets) == 3


def test_boxes_of_spans():
    text, offsets = layout.page_text(layout.grid_words("alpha beta\ngamma"))
    assert len(layout.line_boxes(0, len(text), offsets)) == 2
    assert layout.line_boxes(0, 5, offsets) == [Box(50, 50, 80, 64)]
    assert layout.line_boxes(0, 5, []) == []


def test_coherence_cuts_far_lines():
    words = [Word("a", 0, 0, 10, 10), Word("b", 0, 100, 10, 110)]
    _, offsets = layout.page_text(words)
    assert layout.coherent(0, 3, "ORG", offsets) == (0, 1)
    near = layout.page_text([Word("a", 0, 0, 10, 10), Word("b", 0, 35, 10, 45)])[1]
    assert layout.coherent(0, 3, "ADDRESS", near) == (0, 3) and layout.coherent(0, 3, "ORG", near) == (0, 1)


def test_areas_and_overlap_resolution():
    a, b = Box(0, 0, 100, 20), Box(50, 10, 150, 40)
    assert layout.overlap(a, b) == 500 and layout.overlap(a, Box(200, 0, 210, 10)) == 0
    assert layout.resolve_overlaps([(b, 0.5), (a, 0.9)]) == [(1, a), (0, Box(50, 20, 150, 40))]
    assert layout.resolve_overlaps([(a, 0.9), (Box(0, 19, 100, 20), 0.5)]) == [(0, a)]
    assert layout.clamp(Box(-5, 2, 700, 900), 612, 792) == Box(0, 2, 612, 792)


def test_proximity_groups():
    boxes = [Box(0, 0, 10, 10), Box(0, 12, 10, 22), Box(0, 200, 10, 210), Box(300, 12, 310, 22)]
    assert sorted(map(sorted, layout.proximity_groups(boxes))) == [[0, 1], [2], [3]]


def test_place_on_tables(spark):
    pages = spark.createDataFrame([("d", 1, "Please write to jane@example.org\nabout the Acme Widgets GmbH offer now"), ("e", 1, None)], "doc_id string, page_number long, text string")
    rows = layout.place(layout.with_grid(pages), spans.Config(language="en")).collect()
    assert {(r.pii_type, r.text) for r in rows} >= {("EMAIL", "jane@example.org")}
    assert all(r.x1 > r.x0 and r.doc_id == "d" for r in rows)


def test_terms():
    assert search.find_term("Café  Noir", "the CAFE\nnoir here") == [(4, 13)]
    assert search.find_term("Johnson", "mr jonson came", 0.8) == [(3, 9)] and not search.find_term("Johnson", "mr jonson came")
    assert search.find_term(" ", "x") == []


def test_fuzzy_terms_beside_exact_ones_and_in_words():
    text = "jonson met Johnson and McJohnsons, then johnsen"
    got = [text[a:b] for a, b in search.find_term("Johnson", text, 0.9)]
    assert got == ["jonson", "Johnson", "Johnson", "johnsen"]
    assert search.find_term("Café Noir", "a CAFE \n  noir", 0.9) == [(2, 14)]


@pytest.mark.parametrize(("needle", "text", "at"), [("abc", "xxabc", 2), ("ABC", "xxabc", 2), ("John Smith", "hello Jon Smith there", 5), ("zzz", "abc def", None), ("ab", "zz", None)])
def test_fuzzy_find(needle, text, at):
    assert search.fuzzy_find(needle, text) == at


def test_model_replies():
    text = "call Jane Doe now"
    want = [spans.Span(15, 23, "Jane Doe", "PERSON", 0.75)]
    for reply in ('[{"text": "Jane Doe", "type": "PERSON"}]', '```json\n[{"text": "Jane Doe", "type": "PERSON"}]\n```', 'Sure: [{"text": "Jane Doe", "type": "PERSON"}] done'):
        assert search.parse_reply(reply, text, 10) == want
    assert search.parse_reply("nothing", text) == [] and search.parse_reply('{"a": 1}', text) == []
    assert search.parse_reply('[{"text": "Jane Doe", "type": "ODD"}]', text)[0].kind == "CUSTOM"


def test_scale_and_chunks():
    assert [search.model_scale(x) for x in (0.2, 0.25, 0.5, 0.8, 0.99)] == [0.48, 0.5192, 0.715, 0.95, 0.95]
    a, b = spans.Span(0, 5, "a", "X", 0.5), spans.Span(3, 9, "b", "X", 0.4)
    assert search.dedupe_chunks([a, b]) == [b]
    assert search.split_sizes([5, 5, 5, 50, 1], 10) == [(0, 1), (2, 2), (3, 3), (4, 4)] and search.split_sizes([], 10) == []


def test_search_over_tables(spark):
    pages = spark.createDataFrame([("d", 1, "Acme and ACME"), ("e", 2, None)], "doc_id string, page_number long, text string")
    rows = search.search_terms(pages, [(1, "acme"), (2, "ACME "), (3, "")]).orderBy("ord").collect()
    assert [(r.term_id, r.start) for r in rows] == [(1, 0), (1, 9)]


def plain_edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_seeds_miss_no_misspelled_place():
    import random

    rng = random.Random(4)
    for _ in range(150):
        term = "".join(rng.choice("abcd ") for _ in range(rng.randrange(4, 14))).strip() or "abcd"
        key = " ".join(term.split())
        edits = max(1, round(len(key) * 0.2))
        bad = list(key)
        for _ in range(rng.randrange(edits + 1)):
            bad[rng.randrange(len(bad))] = rng.choice("abcdxyz")
        text = "".join(rng.choice("efgh ") for _ in range(20)) + "".join(bad) + "".join(rng.choice("efgh ") for _ in range(20))
        got = search.find_term(term, text, 0.8)
        assert got and all(plain_edits(key, text[a:b]) <= edits for a, b in got)
        assert all(b <= c for (_, b), (c, _) in zip(got, got[1:], strict=False))
        assert min(plain_edits(key, text[a:b]) for a, b in got) <= plain_edits(key, "".join(bad))


def test_long_passages_with_errors_and_lists_in_parts(spark, monkeypatch):
    passage = "The quick brown fox jumps over the lazy dog and then it runs across the wide green field towards home."
    broken = passage.replace("quick", "quikc").replace("lazy", "lzy").replace("field", "fiield").upper()
    pages = spark.createDataFrame([("d", 1, f"x {broken} y"), ("d", 2, passage), ("e", 1, "nothing"), ("e", 2, None)], "doc_id string, page_number int, text string")
    monkeypatch.setattr(search, "LIST_CHARS", 50)
    rows = search.search_terms(pages, [(7, passage), (8, "nothing"), (9, "")], 0.9).collect()
    assert sorted((r.term_id, r.doc_id, r.page_number) for r in rows) == [(7, "d", 1), (7, "d", 2), (8, "e", 1)]
    docs = spark.createDataFrame([(1, "abcabc"), (2, "bc"), (3, None), (4, "")], "n long, t string")
    got = search.containing(docs, [(1, "abc"), (2, "bc"), (3, ""), (4, "bc")], "n", "t").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 4), (4, 1), (4, 2)]
    assert search.containing(docs, [], "n", "t").count() == 0


def test_terms_of_a_table_in_texts(spark):
    from inkveil.operators.search import containing_terms

    texts = {1: "the quick brown foxes run", 2: "QUICK brown fox", 3: "", 4: None, 5: "a b c d e", 6: "déjà vu encore une fois", 7: "x" * 1000, 8: "a, b; c"}
    terms = {1: "quick brown fox", 2: "ick brown fo", 3: "", 4: None, 5: "b c d", 6: "jà vu encore un", 7: "xx", 8: ", b; ", 9: "none of these words", 10: "brown fox"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(list(terms.items()), "term_id long, term string")
    got = {tuple(r) for r in containing_terms(rows, table).collect()}
    assert got == {(k, i) for k, term in terms.items() for i, t in texts.items() if t is not None and term is not None and term in t}
    assert containing_terms(rows.limit(0), table).count() == containing_terms(rows, table.limit(0)).count() == 0


@pytest.mark.parametrize("fuzziness", [1.0, 0.9, 0.7])
def test_tables_of_terms_are_searched_as_lists_are(spark, monkeypatch, fuzziness):
    import random

    from inkveil.operators import term_seeds

    rng = random.Random(12)
    words = ["acme", "Öl", "widgets", "gmbh", "a", "north", "ﬁne", "x1", "of", "the"]
    phrase = lambda n: " ".join(rng.choice(words) for _ in range(n))
    terms = [(i, phrase(rng.randrange(1, 7))) for i in range(40)] + [(50, "é"), (51, ""), (52, None), (53, " \n"), (None, "north of the widgets"), (54, "x" * 300)]
    pages = [(rng.choice(["d", "e", None]), i, phrase(30).replace("c", rng.choice(["c", "k", ""])).replace(" ", rng.choice([" ", "\n", "  "]))) for i in range(25)]
    pages += [("d", None, terms[3][1]), ("r", 1, "the Acme"), ("r", 1, "the Acme"), ("z", 1, None), ("z", 2, ""), ("y", 1, "x" * 5000), ("y", 2, "E")]
    monkeypatch.setattr(term_seeds, "ROWS", 40)
    monkeypatch.setattr(term_seeds, "TERM_CHARS", 60)
    table = spark.createDataFrame([(i, t, "z") for i, t in terms], "term_id long, term string, seed string")
    got = search.search_terms(spark.createDataFrame([(*p, 0) for p in pages], "doc_id string, page_number long, text string, r1 int"), table, fuzziness)
    once: dict[str, tuple] = {}
    for i, t in sorted((x for x in terms if x[1] and x[1].strip()), key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        once.setdefault(" ".join(t.lower().split()), (i, t))
    finder = search.TermFinder(list(once.values()), fuzziness)
    want = [(i, d, n, k, a, b, text[a:b]) for d, n, text in pages if text for i, k, a, b in finder.find(text)]
    none_last = lambda row: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in (row[0], str(row[1]), *row[2:]))
    assert want and sorted(map(tuple, got.collect()), key=none_last) == sorted(want, key=none_last)
    assert search.search_terms(spark.createDataFrame(pages, "doc_id string, page_number long, text string"), [], fuzziness).count() == 0
    assert search.search_terms(spark.createDataFrame([], "doc_id string, page_number long, text string"), table, fuzziness).count() == 0


def test_words_of_pages_are_given_out_in_parts():
    """A batch of large pages never stands as objects all at once."""
    import pyarrow as pa

    text = "word " * (layout.CHARS // 10)
    batch = pa.record_batch([pa.array(["d"] * 7), pa.array(range(7), pa.int64()), pa.array([text, None, text, "a b", text, text, ""])], names=["doc_id", "page_number", "text"])
    parts = list(layout._gridded(iter([batch])))
    assert [b.column("page_number").to_pylist() for b in parts] == [[0, 1, 2], [3, 4, 5], [6]]
    assert [len(w) for b in parts for w in b.column("words").to_pylist()] == [layout.CHARS // 10, 0, layout.CHARS // 10, 2, layout.CHARS // 10, layout.CHARS // 10, 0]


def test_places_are_followed_on_from_a_seed_before_they_are_compared(monkeypatch):
    rng, calls = random.Random(11), []
    best = search.best_place
    monkeypatch.setattr(search, "best_place", lambda *a: calls.append(a) or best(*a))
    term = "the quick brown fox jumps over the lazy dog and the cat that sat on the mat"
    parts = [p for p, offset in search.term_seeds(term, 0.9)[2] if offset >= 0]
    assert search.find_term(term, " xyzzy ".join(parts * 3), 0.9) == [] and calls == []
    assert search.find_term(term, "so " + term.replace("brown", "brawm") + " it was", 0.9) == [(3, 3 + len(term))] and calls
    for _ in range(300):
        key, text = ("".join(rng.choices("ab ", k=rng.randint(0, n))) for n in (9, 14))
        least = int(search.edit_costs(search._codes(key), search._codes(text), False).min())
        assert all(search.least_edits(key, text, most) == min(least, most + 1) for most in range(5))


def test_plain_texts_of_all_characters():
    every = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    assert plain_py("".join(every)) == "".join(" " if (b := base_letter(c)) in QUOTES else b for c in every)
