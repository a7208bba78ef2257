"""The plan of a whole collection: detection on pages, then what is decided over each document."""

from __future__ import annotations

from pyspark.sql import DataFrame

from inkveil.operators import detect, document, partial
from inkveil.operators.spans import Config
from inkveil.operators.store import stored


def document_regions(pages: DataFrame, config: Config = Config(), common: frozenset[str] = frozenset()) -> DataFrame:  # noqa: B008
    """Regions of pages (doc_id, page_number, text): detect, propagate values and parts of firms, drop contained,
    one type per value, final sweep. Each step reads the regions before it several times, so they are stored in
    between. Pages without a doc_id keep the regions found on them, but nothing spreads from or to them."""
    found = stored(document.propagate(stored(detect.detect(pages, config)), pages))
    found = stored(document.drop_contained(stored(partial.propagate_parts(found, pages, common))))
    return document.final_sweep(document.unify_types(found))
