"""The value index against a plain search of every value on every page."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from inkveil.functions.text import flex_pattern
from inkveil.operators import document, value_index
from inkveil.operators.detect import REGIONS
from inkveil.operators.partial import propagate_parts

PAGES = "doc_id string, page_number long, text string"


def spans(rows):
    return sorted((r.doc_id or "", r.page_number, r.pii_type, r.start, r.end, r.text) for r in rows)


def brute(values_of, regions, pages):
    """New regions: values by their first occurrence, matches from left to right, half-covered ones left out."""
    values, order = defaultdict(dict), sorted((r for r in values_of if r[0] is not None), key=lambda r: (r[1], r[2]))
    for r in order:
        key = " ".join(value_index.plain(r[5]).lower().split())
        if len(key) >= 2 and (key not in values[r[0]] or r[7] > values[r[0]][key][7]):
            values[r[0]][key] = r
    taken = defaultdict(list)
    for r in regions:
        taken[r[0], r[1], r[6]].append((r[3], r[4]))
    out = []
    for doc, page, text in pages:
        for key, r in values[doc].items() if doc is not None and text else ():
            have = taken[doc, page, r[6]]
            for m in flex_pattern(key).finditer(value_index.plain(text)):
                s, e = m.span()
                if not any(min(e, b) - max(s, a) >= 0.5 * (e - s) for a, b in have):
                    have.append((s, e))
                    out.append((doc, page, r[6], s, e, text[s:e]))
    return sorted(out)


def made(seed, n_docs, n_pages):
    rng = random.Random(seed)
    names = ["Anna Smith", "Smith Anna", "anna", "Élan  S.A.", "+1 (555) 010", "O'Neil", "\"Quoted Name\"", "a_b", "(Lead", "trail)", "((", "Straße 5", "x-y", "Smith", "日本 商事", "İstanbul"]
    pages, regions = [], []
    for d in range(n_docs):
        for p in range(n_pages):
            words = [rng.choice([*names, "élan s.a.", "ANNA\nSMITH", "Anna  Smith Anna", "xanna", "anna1", "and", "in", "+1 (555)  010."]) for _ in range(rng.randrange(0, 25))]
            text = "".join(w + rng.choice([" ", " ", "\n", ", ", "-"]) for w in words)
            pages.append((f"d{d}", p, text))
            for k in range(rng.randrange(0, 4)):
                v = rng.choice(names)
                at = text.find(v)
                if at >= 0:
                    regions.append((f"d{d}", p, k, at, at + len(v), v, rng.choice(["PERSON", "ORG", "CUSTOM"]), rng.choice([0.5, 0.7, 0.9]), "NER"))
    return pages, regions


def test_occurrences_are_as_brute_force(spark):
    pages, regions = made(1, 12, 15)
    pages += [(None, 1, "Anna Smith"), ("d0", 99, None), ("d1", 99, ""), ("lone", 1, "Anna Smith")]
    regions += [(None, 1, 0, 0, 10, "Anna Smith", "PERSON", 0.9, "NER")]
    p, r = spark.createDataFrame(pages, PAGES).repartition(5), spark.createDataFrame(regions, REGIONS).repartition(3)
    got = value_index.occurrences(document.templates(r), r, p, 1_000_000).collect()
    assert spans(got) == brute(map(tuple, document.propagatable(r).collect()), regions, pages)
    everything = document.propagate(r, p).where("doc_id IS NOT NULL").select("doc_id", "page_number", "ord")
    new = everything.where("ord >= 1000000")
    assert new.count() == len(got) and new.distinct().count() == len(got)


def test_ten_thousand_values_in_one_document(spark):
    """The result does not depend on how many values a document has."""
    n = 10_000
    values = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit(0).cast("long").alias("page_number"), F.col("id").cast("int").alias("ord"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.format_string("Value %d Name", "id").alias("text"), F.lit("PERSON").alias("pii_type"), F.lit(0.5).alias("confidence"), F.lit("NER").alias("source"))
    pair = spark.createDataFrame([("d", 0, n, 0, 0, "Anna Smith", "PERSON", 0.5, "NER"), ("d", 0, n + 1, 0, 0, "Smith Anna", "PERSON", 0.5, "NER")], REGIONS)
    pages = spark.createDataFrame([("d", 1, "then Anna Smith Anna came"), ("d", 2, " ".join(f"Value {i} Name" for i in range(n))), ("e", 1, "Value 1 Name")], PAGES)
    found = document.propagate(values.unionByName(pair), pages).where("page_number > 0").collect()
    assert [(r.start, r.end, r.text) for r in found if r.page_number == 1] == [(5, 15, "Anna Smith")]
    second = [r for r in found if r.page_number == 2]
    assert len(second) == n == len({r.ord for r in second}) and all(r.doc_id == "d" for r in found)


def test_parts_number_on_after_values(spark):
    pages = spark.createDataFrame([("d", 1, "Deutsche Bank AG"), ("d", 2, "Deutsche Bank AG, deutsche bank, Deutsche")], PAGES)
    first = spark.createDataFrame([("d", 1, 0, 0, 16, "Deutsche Bank AG", "ORG", 0.9, "REGEX")], REGIONS)
    all_ = propagate_parts(document.propagate(first, pages), pages).collect()
    assert spans(all_) == [("d", 1, "ORG", 0, 16, "Deutsche Bank AG"), ("d", 2, "ORG", 0, 16, "Deutsche Bank AG"), ("d", 2, "ORG", 18, 31, "deutsche bank"), ("d", 2, "ORG", 33, 41, "Deutsche")]
    assert len({(r.page_number, r.ord) for r in all_}) == len(all_)


def test_empty_tables(spark):
    pages, regions = spark.createDataFrame([], PAGES), spark.createDataFrame([], REGIONS)
    assert document.propagate(regions, pages).count() == 0 and propagate_parts(regions, pages).count() == 0


def test_values_that_start_alike_meet_only_their_pages(spark):
    """Values meet the pages that hold all their words, not all pages that hold their first two."""
    n = 60
    keys = spark.createDataFrame([("d", f"de la casa {i}" + " x" * 20) for i in range(n)] + [("d", "de la"), ("e", "de la casa 1"), ("d", "((")], "doc_id string, key string")
    pages = spark.createDataFrame([("d", i, f"De  la (casa {i}" + " x" * 20) for i in range(n)], PAGES)
    found = value_index.met(keys, pages).collect()
    assert sorted((r.key, r.page_number) for r in found if "casa" in r.key) == sorted((f"de la casa {i}" + " x" * 20, i) for i in range(n))
    assert sum(r.key == "de la" for r in found) == sum(r.key == "((" for r in found) == n and len(found) == 3 * n
    assert value_index.met(keys.limit(0), pages).count() == value_index.met(keys, pages.limit(0)).count() == 0


def test_places_are_those_of_the_pattern():
    """A text written like the key is settled without a pattern; others by it."""
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "B", "ſ", "s", "K", "é", "_", " ", "  ", "\n", ".", "(", "1", "İ", "ß", "σ", "ς"]) for _ in range(rng.randrange(1, 14)))
        key = " ".join(value_index.plain("".join(rng.choice(["a", "b", "s", "k", "e", "_", " ", ".", "(", "1", "i", "σ"]) for _ in range(rng.randrange(1, 5)))).lower().split())
        if key:
            assert list(value_index.Page(text).find(key)) == [m.span() for m in flex_pattern(key).finditer(value_index.plain(text))], (text, key)


def test_the_index_is_given_out_in_parts():
    import pyarrow as pa

    n = value_index.INDEX_ROWS // 1000
    batch = pa.table({"doc_id": ["d"] * 3 * n, "page_number": list(range(3 * n)), "text": [" ".join(f"w{i}x{k}" for k in range(600)) for i in range(3 * n)]}).to_batches()[0]
    parts = [b.num_rows for b in value_index._index(iter([batch]))]
    assert sum(parts) == 3 * n * 1200 and max(parts) < value_index.INDEX_ROWS + 1200 and len(parts) > 1


def test_few_values_need_no_table_of_words():
    rng = random.Random(6)
    words = ["Anna", "SMITH", "a_b", "(Lead", "trail)", "x-y", "S.A.", "Élan", "Straße", "İstanbul", "ıx", "日本", "O'Neil", "ﬁn", "FIN", "ſas", "ΣΑΣ", "Σας", "1", "aa", "ŉ"]
    for _ in range(3000):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "  ", "\xa0", ",", ""]) for _ in range(rng.randint(0, 9)))
        key = " ".join(value_index.plain(" ".join(rng.choices(words, k=rng.randint(1, 3)))).lower().split())
        one, many = value_index.Page(text), value_index.Page(text)
        many.asked = value_index.FEW
        assert list(one.find(key)) == list(many.find(key))
    page = value_index.Page("Anna Smith met\nANNA\nsmith")
    assert list(page.find("anna smith")) == [(0, 10), (15, 25)] and "at" not in vars(page)
    assert list(value_index.Page("Anna  Smith").find("anna smith")) == [(0, 11)]


def test_values_read_within_words_use_up_their_text():
    page = value_index.Page("eresat at at th")
    assert list(page.find("at at")) == [(7, 12)] and list(page.read("at at")) == []
    assert list(value_index.Page("At\nat, at at").read("at at")) == [(0, 5), (7, 12)]


def test_places_within_longer_words_need_no_pattern(monkeypatch):
    monkeypatch.setattr(value_index, "_pattern", None)
    page = value_index.Page("xanna annas ANNA\nsmith anna-smith anna smiths")
    assert list(page.find("anna")) == [(12, 16), (23, 27), (34, 38)] and list(page.find("anna smith")) == [(12, 22)]
    page.asked = value_index.FEW
    assert list(page.find("anna smith")) == [(12, 22)] and list(page.find("anna smith came")) == []


def test_words_are_hashed_alike_wherever_they_stand():
    rng = random.Random(7)
    bits = ["Anna", "SMITH", "Élan", "ſ", "s", "K", "k", "ı", "İ", "ß", "ŉ", "日本", "a_b", "1", "ﬁ", "ς", "σ", " ", "-", "\n", "’", "\u0345"]
    texts = ["", *("".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(2000))]
    hashes, bounds = value_index.word_hashes(texts)
    seen = defaultdict(set)
    for k, t in enumerate(texts):
        words = value_index._WORDS.findall(value_index.plain(t))
        assert len(words) == bounds[k + 1] - bounds[k]
        for word, h in zip(words, hashes[bounds[k] : bounds[k + 1]].tolist(), strict=True):
            seen[value_index._alike(word)].add(h)
    assert all(len(h) == 1 for h in seen.values()) and len(set().union(*seen.values())) == len(seen)


def test_longer_values_are_only_sought_where_their_first_words_stand(spark):
    """Runs of three words or more that no value begins with are never made, and pairs alone reach no join."""
    import numpy as np
    import pyarrow as pa

    keys = pa.table({"doc_id": ["d", "d"], "key": ["de la casa", "lone"]}).to_batches()[0]
    (keyed,) = value_index._run_keyed(iter([keys]))
    words, pairs = (keyed.column(c).to_numpy().view(np.uint64) for c in ("words", "pair"))
    log = 20
    bits = np.zeros(1 << log, bool)
    for h in (words, value_index._begins(pairs[:1])):
        bits[np.concatenate(value_index.slots(h, log)).astype(np.int64)] = True

    class Table:
        value = np.packbits(bits, bitorder="little").tobytes()

    pages = pa.table({"doc_id": ["d", "d", "d", "e", None], "page_number": [1, 2, 3, 4, 5], "text": ["de la", "De  la (casa", "LONE, de la\ncasa", "de la casa", "lone"]}).to_batches()[0]
    (found,) = value_index._held({1, 3}, log, Table)(iter([pages]))
    assert sorted(zip(found.column("page_number").to_pylist(), found.column("words").to_pylist(), strict=True)) == sorted(zip([2, 3, 3], words.view(np.int64)[[0, 0, 1]].tolist(), strict=True))
