"""Boxes that a user draws: the words under them, new regions without duplicates, and what a box holds.

boxes have box_id, doc_id, page_number, x0, y0, x1, y1; words doc_id, page_number, n (their order on the page), text and
a box; pages doc_id, page_number, width, height. Boxes meet words by page in an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.text import normalize_for_matching
from inkveil.operators import spans
from inkveil.operators.geometry import BOX, PAGE
from inkveil.operators.keys import join_nulls
from inkveil.operators.mutations import clamp

#: Columns lie apart by more than so many mean heights of the words in a box.
COLUMN_GAP = 5
NOTHING = "[manual selection]"


def _under(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """Each word of a box's page, as w_x0 and so on."""
    named = words.select(*PAGE, F.col("n").alias("w_n"), F.col("text").alias("w_text"), *(F.col(c).alias(f"w_{c}") for c in BOX))
    return join_nulls(boxes.select("box_id", *PAGE, *BOX), named, PAGE)


def clamped(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """boxes inside their pages; those of unknown pages stay as they are."""
    sizes = pages.groupBy(*PAGE).agg(F.max("width").alias("__w"), F.max("height").alias("__h"))
    out = join_nulls(boxes, sizes, PAGE, "left")
    for a, b, size in (("x0", "x1", "__w"), ("y0", "y1", "__h")):
        lo, hi = clamp(F.col(a), F.col(b), F.col(size))
        out = out.withColumns({a: F.when(F.col(size).isNull(), F.col(a)).otherwise(lo), b: F.when(F.col(size).isNull(), F.col(b)).otherwise(hi)})
    return out.select(*boxes.columns)


def words_in_boxes(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """boxes with the text under them, snapped to its words.

    A word counts if its centre lies in the box. Where the widest gap between neighbouring centres is more than COLUMN_GAP
    mean heights, the words are of two columns, and those whose mean centre is nearer to the box's stay (the left ones
    on a tie). Words are read by y0, then x0. A box without words keeps its corners, and its text says so."""
    cx, cy = (F.col("w_x0") + F.col("w_x1")) / 2, (F.col("w_y0") + F.col("w_y1")) / 2
    inside = _under(boxes, words).withColumn("cx", cx).where(F.col("cx").between(F.col("x0"), F.col("x1")) & cy.between(F.col("y0"), F.col("y1")))
    order, all_ = Window.partitionBy("box_id").orderBy("cx", "w_n"), Window.partitionBy("box_id")
    inside = inside.withColumns({"k": F.row_number().over(order), "gap": F.col("cx") - F.lag("cx").over(order), "mean_height": F.avg(F.col("w_y1") - F.col("w_y0")).over(all_)})
    inside = inside.withColumn("widest", F.max(F.struct("gap", (-F.col("k")).alias("k"))).over(all_))
    split = F.when(F.col("widest.gap") > COLUMN_GAP * F.col("mean_height"), -F.col("widest.k"))
    inside = inside.withColumn("right", F.coalesce(F.col("k") >= split, F.lit(False)))
    sides = inside.groupBy("box_id", "right").agg(F.avg("cx").alias("mean"), F.first((F.col("x0") + F.col("x1")) / 2).alias("drawn"))
    best = sides.groupBy("box_id").agg(F.min(F.struct(F.abs(F.col("mean") - F.col("drawn")).alias("off"), "right")).getField("right").alias("right"))
    kept = inside.join(best, ["box_id", "right"])
    read = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("w_y0", "w_x0", "w_n", "w_text"))), lambda w: w["w_text"]), " ")
    snapped = [F.round(f(f"w_{c}"), 2).alias(f"s_{c}") for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))]
    found = kept.groupBy("box_id").agg(F.trim(read).alias("found"), *snapped)
    out = boxes.join(found, "box_id", "left")
    return out.select(*(F.coalesce(f"s_{c}", c).alias(c) if c in BOX else F.col(c) for c in boxes.columns if c != "text"), F.coalesce("found", F.lit(NOTHING)).alias("text"))


def add_manual(boxes: DataFrame, words: DataFrame, pages: DataFrame, regions: DataFrame) -> DataFrame:
    """boxes (with pii_type) as regions to add: box_id, doc_id, page_number, the snapped box, text, pii_type and region_id, the id of
    the region that takes the type instead of a new one, else null.

    A region of the page that is not cancelled stands for a box if their texts are the same and their heights meet, or if the
    box's text is part of the region's and the boxes meet; of several the first (by ord, then id). The values of what was
    added are then looked for on all pages (highlight.highlight_all, document.propagate)."""
    found = words_in_boxes(clamped(boxes, pages), words).withColumn("__norm", F.when(F.col("text") != NOTHING, normalize_for_matching(F.col("text"))))
    old = regions.where("action IS NULL OR action <> 'CANCEL'").select(*PAGE, F.col("region_id").alias("r_id"), F.col("ord").alias("r_ord"), normalize_for_matching(F.col("text")).alias("r_norm"), *(F.col(c).alias(f"r_{c}") for c in BOX))
    pair = join_nulls(found, old, PAGE)
    same = (F.col("__norm") == F.col("r_norm")) & (F.col("r_y0") <= F.col("y1")) & (F.col("r_y1") >= F.col("y0"))
    meet = (F.greatest("x0", "r_x0") < F.least("x1", "r_x1")) & (F.greatest("y0", "r_y0") < F.least("y1", "r_y1"))
    part = (F.col("__norm") != F.col("r_norm")) & F.contains("r_norm", "__norm") & meet
    taken = pair.where((F.col("__norm") != "") & (same | part)).groupBy("box_id").agg(F.min(F.struct("r_ord", "r_id")).getField("r_id").alias("region_id"))
    return found.join(taken, "box_id", "left").select("box_id", *PAGE, *BOX, "text", "pii_type", "region_id")


def _best(config: spans.Config):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from inkveil.functions.language import language_py

        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                kind, confidence, source = "CUSTOM", 0.0, "MANUAL"
                language = language_py(text) if config.language in (None, "auto") else config.language
                layers = [("REGEX", spans.detect_patterns(text, config, language)), ("NER", spans.heuristic_names(text, config.names))] if text else []
                for name, found in layers:
                    for s in found:
                        if s.confidence > confidence:
                            kind, confidence, source = s.kind, s.confidence, name
                out.append((kind, confidence, source))
            kinds, confidences, sources = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), pa.array(confidences, pa.float64()), pa.array(sources, pa.string())], names=[*batch.schema.names, "pii_type", "confidence", "source"])

    return run


def reanalyze(boxes: DataFrame, words: DataFrame, config: spans.Config = spans.Config()) -> DataFrame:  # noqa: B008
    """box_id, text, pii_type, confidence and source of what a box holds: the words that it touches, in page order, and the
    surest find of the layers in them (patterns, then names); CUSTOM, 0 and MANUAL where there is none."""
    touches = (F.col("w_x0") < F.col("x1")) & (F.col("w_x1") > F.col("x0")) & (F.col("w_y0") < F.col("y1")) & (F.col("w_y1") > F.col("y0"))
    read = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("w_n", "w_text"))), lambda w: w["w_text"]), " ")
    text = _under(boxes, words).where(touches).groupBy("box_id").agg(F.trim(read).alias("found"))
    rows = boxes.select("box_id").join(text, "box_id", "left").select("box_id", F.coalesce("found", F.lit("")).alias("text"))
    kind = rows.schema["box_id"].dataType.simpleString()
    return rows.mapInArrow(_best(config), f"box_id {kind}, text string, pii_type string, confidence double, source string")
