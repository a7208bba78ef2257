"""What is decided over a whole document: propagation of confirmed values to all its pages, one type per
value, the final sweep. A page is small; a document may have any number of pages, so pages stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.text import neutralise_quotes, strip_accents, ws_collapse
from inkveil.operators.detect import _NAMES
from inkveil.operators.spans import LEGAL, MIN_DIGITS
from inkveil.operators.value_index import occurrences


def value_key(text: Column, quotes: bool = True) -> Column:
    """What makes two texts the same value: no accents, quotes as spaces, single spaces, lower case."""
    return F.lower(ws_collapse(strip_accents(neutralise_quotes(text) if quotes else text)))


def legal_suffix(text: Column) -> Column:
    return F.trim(text).rlike("(?i)" + LEGAL.pattern)


def propagatable(r: DataFrame) -> DataFrame:
    """Regions whose value may be looked for elsewhere."""
    t, digits = F.trim("text"), F.length(F.regexp_replace("text", "[^0-9]", ""))
    org = (F.col("pii_type") == "ORG") & (t.rlike("^[0-9]+$") | (t.rlike("^[0-9]") & ~legal_suffix(t)) | (F.length(t) <= 2))
    few = F.lit(False)
    for kind, n in MIN_DIGITS.items():
        few = few | ((F.col("pii_type") == kind) & (digits < n))
    money = (F.col("pii_type") == "SSN") & t.rlike("[$€£]")
    return r.where((F.length(t) >= 2) & ~org & ~few & ~money)


def templates(regions: DataFrame) -> DataFrame:
    """Per document and value the best region: highest confidence, then page order; `turn` is where the value
    occurs first."""
    keyed = propagatable(regions).withColumn("key", value_key(F.trim("text")))
    best = F.struct((-F.col("confidence")).alias("c"), "page_number", "ord", "pii_type", "confidence", "source")
    found = keyed.groupBy("doc_id", "key").agg(F.min(best).alias("b"), F.min(F.struct("page_number", "ord")).alias("turn"))
    return found.select("doc_id", "key", "b.pii_type", "b.confidence", "b.source", "turn")


def propagate(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions and, on every page of a document, all further occurrences of its values, those first that
    occur first in the document (see value_index.occurrences)."""
    return regions.unionByName(occurrences(templates(regions), regions, pages, 1_000_000))


def unify_types(regions: DataFrame) -> DataFrame:
    """Every value of a document gets the type of its most confident region, the first on a tie; regions without a
    document keep their own."""
    keyed = regions.withColumn("key", value_key(F.trim("text"), quotes=False))
    best = keyed.where(F.length("key") >= 2).groupBy("doc_id", "key").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "page_number", "ord", "pii_type")).alias("b"))
    out = keyed.join(best.select("doc_id", "key", F.col("b.pii_type").alias("winner")), ["doc_id", "key"], "left")
    return out.withColumn("pii_type", F.coalesce("winner", "pii_type")).select(*_NAMES)


def drop_contained(regions: DataFrame) -> DataFrame:
    """Regions but for those inside a longer (or equal, earlier) region of the same type and page with as much confidence."""
    a, b = regions.alias("a"), regions.alias("b")
    longer = (F.col("b.end") - F.col("b.start")) > (F.col("a.end") - F.col("a.start"))
    tie = ((F.col("b.end") - F.col("b.start")) == (F.col("a.end") - F.col("a.start"))) & (F.col("b.ord") < F.col("a.ord"))
    inside = (F.col("b.start") <= F.col("a.start")) & (F.col("b.end") >= F.col("a.end")) & (F.col("b.confidence") >= F.col("a.confidence"))
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_number") == F.col("b.page_number")) & (F.col("a.pii_type") == F.col("b.pii_type"))
    return a.join(b, same & inside & (longer | tie), "left_anti").select(*_NAMES)


def final_sweep(regions: DataFrame) -> DataFrame:
    """Firms of two characters or fewer, of digits, or starting with a digit without a legal form go."""
    t = F.trim("text")
    bad = (F.length(t) <= 2) | t.rlike("^[0-9]+$") | (t.rlike("^[0-9]") & ~legal_suffix(t))
    return regions.where((F.col("pii_type") != "ORG") | ~bad)
