"""Documents split into parts within a byte budget: sizes of unsampled pages interpolated, then greedy cuts in few rounds.

A greedy cut is where the pages since the last cut would pass the budget. Every page gets a pointer to the page that would
start the next part if a part started there; the starts are what pointers reach from page 0. Pointers are doubled: after k
rounds all starts within 2^k parts are known, so a document of any number of parts takes logarithmically many joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.operators.keys import join_nulls
from inkveil.operators.store import stored

#: Documents of more pages than EVERY are measured on some SAMPLES pages.
EVERY, SAMPLES = 200, 50


def to_measure(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page from 0) whose size is to be measured: all of a short document, else every so many and the last."""
    all_ = Window.partitionBy("doc_id")
    n = F.count("*").over(all_)
    step = F.greatest(F.lit(1), F.expr(f"n div {SAMPLES}"))
    out = pages.withColumn("n", n).withColumn("step", step)
    return out.where((F.col("n") <= EVERY) | (F.col("page") % F.col("step") == 0) | (F.col("page") == F.col("n") - 1)).drop("n", "step")


def with_sizes(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, size) with sizes that are null set between those of the nearest measured pages, rounded down; before
    the first or after the last of them its own size, 0 in a document without any."""
    order = Window.partitionBy("doc_id").orderBy("page")
    known = F.when(F.col("size").isNotNull(), F.struct("page", F.col("size").cast("long").alias("size")))
    # Both run from an end of the document to the page: a frame that runs on to the end is read again for every page.
    back = Window.partitionBy("doc_id").orderBy(F.desc("page"))
    lo, hi = (F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for w in (order, back))
    out = pages.withColumns({"__lo": lo, "__hi": hi})
    lo, hi = F.coalesce("__lo", "__hi"), F.coalesce("__hi", "__lo")
    between = lo["size"] + (F.col("page") - lo["page"]) / (hi["page"] - lo["page"]) * (hi["size"] - lo["size"])
    size = F.when(lo["page"] == hi["page"], lo["size"]).otherwise(between.cast("long"))
    return out.withColumn("size", F.coalesce("size", size, F.lit(0)).cast("long")).drop("__lo", "__hi")


def next_starts(pages: DataFrame, budget: int) -> DataFrame:
    """doc_id, page, next: where the next part starts if one starts at page; the number of pages if none does.

    Sums up to each page and the most that each start may reach stand in one order of a document, so one window counts
    for every start the pages that fit."""
    order = Window.partitionBy("doc_id").orderBy("page")
    upto = pages.withColumn("upto", F.sum("size").over(order))
    values = upto.select("doc_id", "page", F.explode(F.array(F.struct(F.col("upto").alias("value"), F.lit(0).alias("kind")), F.struct((F.col("upto") - F.col("size") + budget).alias("value"), F.lit(1).alias("kind")))).alias("v"))
    values = values.select("doc_id", "page", "v.*")
    fit = F.count_if(F.col("kind") == 0).over(Window.partitionBy("doc_id").orderBy("value", "kind", "page").rowsBetween(Window.unboundedPreceding, 0))
    return values.withColumn("fit", fit).where("kind = 1").select("doc_id", "page", F.greatest("fit", F.col("page") + 1).alias("next"))


def split(pages: DataFrame, budget: int) -> DataFrame:
    """pages (doc_id, page from 0, gapless, size) with size and part, from 1: parts hold at most `budget` bytes, filled in order;
    a larger page stands alone. Pages without a doc_id are one document; an empty table gives an empty result."""
    sized = stored(with_sizes(pages))
    jump = stored(next_starts(sized, budget))
    starts = stored(jump.where("page = 0").select("doc_id", "page"))
    known = starts.count()
    while known:
        reached = join_nulls(starts, jump, ["doc_id", "page"]).select("doc_id", F.col("next").alias("page"))
        more = stored(starts.unionByName(join_nulls(reached, jump.select("doc_id", "page"), ["doc_id", "page"])).distinct())
        found = more.count()
        if found == known:
            break
        starts, known = more, found
        ahead = jump.select("doc_id", F.col("page").alias("next"), F.col("next").alias("after"))
        jump = stored(join_nulls(jump, ahead, ["doc_id", "next"], "left").select("doc_id", "page", F.coalesce("after", "next").alias("next")))
    marked = join_nulls(sized, starts.withColumn("__start", F.lit(1)), ["doc_id", "page"], "left")
    return marked.withColumn("part", F.count("__start").over(Window.partitionBy("doc_id").orderBy("page"))).drop("__start")
