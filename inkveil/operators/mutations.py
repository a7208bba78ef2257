"""Edits of regions as relations: each takes the regions and the changes, and gives the regions after them.

regions have region_id and doc_id, and, where an operation needs them, linked_group, page_number, text,
pii_type, action, x0, y0, x1, y1. Changes that name no region do nothing. A change spreads to the
siblings of its region's linked group where the docstring says so. Where several changes reach one
region, its own comes first, then the one with the least region_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.operators.keys import join_nulls


def text_key(text: str | Column = "text") -> Column:
    return F.lower(F.trim(text))


def delete(regions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Regions but for the chosen (region_id) and their siblings."""
    ids = chosen.select("region_id").distinct()
    groups = regions.join(ids, "region_id").where("linked_group IS NOT NULL").select("doc_id", "linked_group").distinct().withColumn("__on", F.lit(True))
    return join_nulls(regions.join(ids, "region_id", "left_anti"), groups, ["doc_id", "linked_group"], "left").where("__on IS NULL").select(*regions.columns)


def batch_delete(regions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Regions but for the chosen, siblings untouched."""
    return regions.join(chosen.select("region_id").distinct(), "region_id", "left_anti").select(*regions.columns)


def batch_action(regions: DataFrame, chosen: DataFrame, action: str) -> DataFrame:
    """The chosen regions get the action, siblings do not."""
    ids = chosen.select("region_id").distinct().withColumn("__on", F.lit(True))
    return regions.join(ids, "region_id", "left").withColumn("action", F.when(F.col("__on"), action).otherwise(F.col("action"))).select(*regions.columns)


def _same_text(regions: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """regions with `column` as changes (region_id, `column`) say, spread to all regions of the document with the same text."""
    new = changes.select("region_id", F.col(column).alias("__own")).groupBy("region_id").agg(F.min("__own").alias("__own"))
    keyed = regions.withColumn("__key", text_key())
    told = keyed.join(new, "region_id").where("__key <> ''").groupBy("doc_id", "__key").agg(F.min_by("__own", "region_id").alias("__all"))
    out = keyed.join(new, "region_id", "left").join(told, ["doc_id", "__key"], "left")
    return out.withColumn(column, F.coalesce("__own", "__all", column)).select(*regions.columns)


def relabel(regions: DataFrame, changes: DataFrame) -> DataFrame:
    """The type of changes (region_id, pii_type) for their regions and all of the document with the same text."""
    return _same_text(regions, changes, "pii_type")


def edit_text(regions: DataFrame, changes: DataFrame) -> DataFrame:
    """The text of changes (region_id, text) for their regions and all of the document with the same old text."""
    return _same_text(regions, changes, "text")


def clamp(low: Column, high: Column, size: Column) -> tuple[Column, Column]:
    """An interval inside [0, size]."""
    return F.greatest(F.lit(0.0), F.least(low, size)), F.greatest(F.lit(0.0), F.least(high, size))


def _once(changes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row of changes for each region_id, its columns as __name."""
    least = changes.groupBy("region_id").agg(F.min(F.struct(*names)).alias("__least"))
    return least.select("region_id", *(F.col(f"__least.{c}").alias(f"__{c}") for c in names))


def move(regions: DataFrame, boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes of boxes (region_id, x0, y0, x1, y1) for their regions, clamped to the page (doc_id, page_number, width, height)
    if it is known; of boxes that repeat an id the least counts, of pages that repeat the largest sizes."""
    new = _once(boxes, ("x0", "y0", "x1", "y1"))
    sizes = pages.groupBy("doc_id", "page_number").agg(F.max("width").alias("__w"), F.max("height").alias("__h"))
    out = join_nulls(regions.join(new, "region_id", "left"), sizes, ["doc_id", "page_number"], "left")
    for a, b, size in (("x0", "x1", "__w"), ("y0", "y1", "__h")):
        lo, hi = clamp(F.col(f"__{a}"), F.col(f"__{b}"), F.col(size))
        for c, v in ((a, lo), (b, hi)):
            known = F.when(F.col(size).isNull(), F.col(f"__{c}")).otherwise(v)
            out = out.withColumn(c, F.when(F.col(f"__{c}").isNull(), F.col(c)).otherwise(known))
    return out.select(*regions.columns)


def sync(regions: DataFrame, state: DataFrame) -> DataFrame:
    """Action and box as state (region_id, action, x0, y0, x1, y1) says for the regions that it names; of states that
    repeat an id the least counts."""
    names = ("action", "x0", "y0", "x1", "y1")
    new = _once(state, names)
    out = regions.join(new, "region_id", "left")
    for c in names:
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    return out.select(*regions.columns)


def without_types(regions: DataFrame, types: list[str], scanned: DataFrame | None = None) -> DataFrame:
    """Regions but for the types ticked off, on scanned pages (doc_id, page_number) only if given; manual ones always stay."""
    off = F.coalesce(F.col("pii_type").isin(*types), F.lit(False)) & ~F.coalesce(F.col("source") == "MANUAL", F.lit(False))
    if scanned is None:
        return regions.where(~off)
    pages = scanned.select("doc_id", "page_number").distinct().withColumn("__on", F.lit(True))
    return join_nulls(regions, pages, ["doc_id", "page_number"], "left").where(~(off & F.coalesce("__on", F.lit(False)))).select(*regions.columns)


def redetected(regions: DataFrame, found: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions after pages (doc_id, page_number) are detected again: theirs are replaced by `found`, but for manual ones, which stay."""
    again = pages.select("doc_id", "page_number").distinct().withColumn("__on", F.lit(True))
    kept = join_nulls(regions, again, ["doc_id", "page_number"], "left").where(F.col("__on").isNull() | (F.col("source") == "MANUAL"))
    return kept.select(*regions.columns).unionByName(join_nulls(found, again, ["doc_id", "page_number"]).select(*regions.columns))


def on_pages(regions: DataFrame, pages: list[int], document: str | None = None) -> DataFrame:
    """Regions of some pages, of all documents or of one, by page and ord; without a page number they are on none."""
    rows = regions.where(F.col("page_number").isin(*pages) if pages else F.lit(False))
    return (rows if document is None else rows.where(F.col("doc_id") == document)).orderBy("doc_id", "page_number", "ord")


def debug_listing(regions: DataFrame) -> DataFrame:
    """pii_type, confidence, source and the first 80 characters of the text, surest first, then by type."""
    rows = regions.select("pii_type", "confidence", "source", F.substring("text", 1, 80).alias("text"), "page_number", "ord")
    return rows.orderBy(F.desc("confidence"), "pii_type", "page_number", "ord")
