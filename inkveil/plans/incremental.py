"""Propagation kept up to date: when pages change, only they are detected again, and only pages that a changed value
may touch are searched again.

What a run leaves is three tables: `found`, the regions that detection gives on each page; `index`, the words of each page
(value_index); and `spread`, the occurrences of values elsewhere. A page's occurrences follow from its text, its own regions
and the values that its words admit, with their types and order. So after a change the pages to search again are those
that changed and those whose words admit a value that is new, gone or different; the index finds them without their texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.operators import detect, document, value_index
from inkveil.operators.keys import join_nulls
from inkveil.operators.spans import Config
from inkveil.operators.store import spread, stored

PAGE = ["doc_id", "page_number"]
LEAST = 1_000_000


@dataclass(frozen=True)
class Tables:
    """What a run leaves, stored; `searched` has the pages (doc_id, page_number) that the last run searched for values."""

    found: DataFrame
    index: DataFrame
    spread: DataFrame
    searched: DataFrame

    def regions(self) -> DataFrame:
        """As document.propagate(detect(pages), pages)."""
        return self.found.unionByName(self.spread)


def _plain(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("doc_id").cast("string"), F.col("page_number").cast("long"), "text")


def _indexed(pages: DataFrame) -> DataFrame:
    return value_index.index_of(spread(pages.where("doc_id IS NOT NULL AND text IS NOT NULL")))


def _without(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows but for those of pages; a null document or number is a page as others are."""
    return join_nulls(rows, pages.withColumn("__off", F.lit(True)), PAGE, "left").where("__off IS NULL").drop("__off")


def begin(pages: DataFrame, config: Config = Config()) -> Tables:  # noqa: B008
    """Detect and propagate all pages (doc_id, page_number, text)."""
    pages = _plain(pages)
    found, index = stored(detect.detect(pages, config)), stored(_indexed(pages))
    more = value_index.occurrences(document.templates(found), found, pages, LEAST, index)
    return Tables(found, index, stored(more), pages.select(*PAGE).distinct())


def changed_values(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id and key of the values that are in one of two tables of templates only, or differ between them."""
    both = before.withColumn("__at", F.lit(1)).unionByName(after.withColumn("__at", F.lit(2)))
    told = F.to_json(F.struct(*[c for c in before.columns if c not in ("doc_id", "key")]))
    return both.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.count_distinct(told).alias("kinds")).where("n = 1 OR kinds > 1").select("doc_id", "key")


def update(tables: Tables, pages: DataFrame, changed: DataFrame, config: Config = Config()) -> Tables:  # noqa: B008
    """Tables after the pages of changed (doc_id, page_number) have changed, come or gone; pages has all texts as they are now.

    The result is that of begin(pages). Texts are read of changed pages and of those to search again only."""
    pages, ids = _plain(pages), stored(changed.select(F.col("doc_id").cast("string"), F.col("page_number").cast("long")).distinct())
    fresh = stored(join_nulls(pages, ids, PAGE))
    found = stored(_without(tables.found, ids).unionByName(detect.detect(fresh, config)))
    index = stored(_without(tables.index, ids).unionByName(_indexed(fresh)))
    now = stored(document.templates(found))
    differ = changed_values(document.templates(tables.found), now).where("doc_id IS NOT NULL")
    met = value_index.candidates(differ, index).select(*PAGE)
    touched = stored(met.unionByName(ids).distinct())
    again = pages.join(F.broadcast(touched) if touched.count() < 100_000 else touched, PAGE, "left_semi")
    part = index.join(touched, PAGE, "left_semi")
    keys = now.join(touched.select("doc_id").distinct(), "doc_id", "left_semi")
    more = value_index.occurrences(keys, found.join(touched, PAGE, "left_semi"), again, LEAST, part)
    return Tables(found, index, stored(_without(tables.spread, touched).unionByName(more)), touched)
