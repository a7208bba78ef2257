"""Redaction and its undoing in structured documents: runs of formatted text, and tables of cells."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.operators.vault import TOKEN


def replace_in_runs(runs: list[str], replacements: dict[str, str]) -> list[str]:
    """Replacements, in order, in text that is cut into runs: a replacement stands in the run where its original
    began, the other runs lose what they held of it and keep the rest. What was put in is not searched again
    for the same original."""
    out = [r or "" for r in runs]
    for old, new in replacements.items():
        if not old:
            continue
        starts, joined, at = [0], "".join(out), 0
        for r in out:
            starts.append(starts[-1] + len(r))
        cuts = []
        while (at := joined.find(old, at)) >= 0:
            cuts.append((at, at + len(old)))
            at += len(old)
        for a, b in reversed(cuts):
            for k in range(len(out) - 1, -1, -1):
                lo, hi = max(a - starts[k], 0), min(b - starts[k], starts[k + 1] - starts[k])
                if lo < hi:
                    first = starts[k] <= a
                    out[k] = out[k][:lo] + (new if first else "") + out[k][hi:]
    return out


def redact_runs(paragraphs: DataFrame, replacements: DataFrame) -> DataFrame:
    """paragraphs (doc_id, paragraph, runs: array<string>) with the replacements of their document
    (doc_id, ord, original, replacement) made in order of ord; documents without any stay as they are."""
    lists = replacements.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "original", "replacement"))).alias("by"))
    rows = paragraphs.select("doc_id", "paragraph", "runs").join(lists, "doc_id", "left")
    schema = T.StructType([paragraphs.schema[c] for c in ("doc_id", "paragraph", "runs")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [x if x is None or not by else replace_in_runs(x, {p["original"]: p["replacement"] for p in by}) for x, by in zip(batch.column("runs").to_pylist(), batch.column("by").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("paragraph"), pa.array(runs, pa.list_(pa.string()))], names=["doc_id", "paragraph", "runs"])

    return rows.mapInArrow(run, schema)


def string_columns(table: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in table.schema if isinstance(f.dataType, T.StringType) and f.name not in but]


def redact_cells(table: DataFrame, replacements: list[tuple[str, str]], but: tuple[str, ...] = ()) -> DataFrame:
    """A table whose string columns have the replacements (original, replacement), in order; one document's list is
    short. Columns in `but`, and those of other types, stay."""
    out = {}
    for c in string_columns(table, but):
        value = F.col(c)
        for old, new in replacements:
            if old:
                value = F.replace(value, F.lit(old), F.lit(new))
        out[c] = value
    return table.withColumns(out) if out else table


def restore_cells(table: DataFrame, vault: DataFrame, key: str) -> DataFrame:
    """A table with the tokens in its string columns, but for its key, resolved from the vault (token_string,
    original_text): tokens of all cells are looked up by one join; unknown ones stay. Keys are distinct."""
    names = string_columns(table, (key,))
    if not names:
        return table
    tokens = F.flatten(F.array(*[F.coalesce(F.regexp_extract_all(c, F.lit(TOKEN), 0), F.array().cast("array<string>")) for c in names]))
    each = table.select(key, F.explode(F.array_distinct(tokens)).alias("token_string")).join(vault.select("token_string", "original_text"), "token_string")
    known = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("token_string", "original_text"))).alias("__known"))
    out = table.join(known, key, "left")
    none = F.array().cast(known.schema["__known"].dataType)
    made = {c: F.aggregate(F.coalesce("__known", none), F.col(c), lambda s, p: F.replace(s, p["token_string"], p["original_text"])) for c in names}
    return out.withColumns(made).select(*table.columns)
