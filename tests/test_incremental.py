"""Updates against full runs, and what they read."""

from __future__ import annotations

import random

from inkveil.operators import detect, document
from inkveil.operators.spans import Config
from inkveil.plans import incremental

PAGES = "doc_id string, page_number long, text string"
CONFIG = Config(language="en", min_chars=0)


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def text(rng):
    return ". ".join(rng.choice(["mail a@example.org now", "A@EXAMPLE.ORG again", "b.c@example.com", "phone: +1 (555) 123-4567", "see 10.20.30.40 there", "Acme Widgets Inc said", "nothing here", "acme widgets inc", "x@example.net"]) for _ in range(rng.randrange(1, 7)))


def test_updates_equal_full_runs(spark):
    rng = random.Random(3)
    pages = {(d, p): text(rng) for d in ("a", "b", "c", None) for p in range(6)}
    frame = lambda: spark.createDataFrame([(d, p, t) for (d, p), t in pages.items()], PAGES)
    tables = incremental.begin(frame(), CONFIG)
    for turn in range(4):
        changed = rng.sample(sorted(pages, key=str), 3)
        for k in changed:
            pages[k] = text(rng)
        if turn == 1:  # a page goes, another comes
            del pages[changed[0]]
            changed.append(("b", 50))
            pages["b", 50] = "mail q@example.org and a@example.org now"
        tables = incremental.update(tables, frame(), spark.createDataFrame(changed, "doc_id string, page_number long"), CONFIG)
        assert rows(tables.regions()) == rows(document.propagate(detect.detect(frame(), CONFIG), frame()))


def test_only_touched_pages_are_searched(spark):
    pages = {(d, p): f"page {p} of {d} tells nothing" for d in "ab" for p in range(20)}
    pages["a", 3], pages["a", 7], pages["b", 3] = "mail one@example.org now", "it says One@Example.org here", "it says one@example.org here"
    frame = lambda: spark.createDataFrame([(d, p, t) for (d, p), t in pages.items()], PAGES)
    tables = incremental.begin(frame(), CONFIG)
    pages["a", 5], pages["a", 9] = "Acme Widgets Inc said so", "and ACME widgets inc did"
    changed = spark.createDataFrame([("a", 5), ("a", 9)], "doc_id string, page_number long")
    tables = incremental.update(tables, frame(), changed, CONFIG)
    assert {tuple(r) for r in tables.searched.collect()} == {("a", 5), ("a", 9)}
    pages["a", 3] = "nothing any more"
    tables = incremental.update(tables, frame(), spark.createDataFrame([("a", 3)], "doc_id string, page_number long"), CONFIG)
    assert {tuple(r) for r in tables.searched.collect()} <= {("a", 3), ("a", 7)}
    assert rows(tables.regions()) == rows(document.propagate(detect.detect(frame(), CONFIG), frame()))
    same = incremental.update(tables, frame(), changed.limit(0), CONFIG)
    assert same.searched.count() == 0 and rows(same.regions()) == rows(tables.regions())
