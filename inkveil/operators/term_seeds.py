"""A table of terms searched with a tolerance: terms and pages meet by seeds, in an equi-join.

Each term has seeds, parts of which one at least stands unchanged in any place that counts (see search.term_seeds).
Pages give the distinct hashes of their parts of these lengths, if the table of bits of all seeds has them; terms
and pages that share a seed meet, and each page is searched for what met it, a part of the list at a time. So terms
never pass through the driver: what does is the table of bits, of one size whatever the list, and at most SEED
lengths. The bits only save rows. With a list so long that they fill up, more of a page's parts reach the join, where
hashes are compared in full; equal hashes of different parts cost a try, as terms are verified on the text.

Rows of one page are searched by one task; a seed that very many pages and terms share is left to the optimiser's
skew handling, and all pairs it makes have to be looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.operators import search
from inkveil.operators.store import spread, stored

#: Characters of a seed that are compared, bits of the table, pairs of one Arrow batch, characters of terms tried at once.
SEED, BITS, ROWS, TERM_CHARS = 12, 1 << 24, 100_000, 1_000_000
_FACTORS = np.random.Generator(np.random.PCG64(31)).integers(1, 1 << 63, SEED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(codes: np.ndarray, lengths: set[int]) -> dict[int, np.ndarray]:
    """For each length the 64-bit hashes of all parts of a text of that length, by their starts."""
    total, out = np.zeros(len(codes), np.uint64), {}
    wide = codes.astype(np.uint64) + np.uint64(1)
    for j in range(min(SEED, len(codes))):
        total = total[: len(codes) - j] + wide[j:] * _FACTORS[j]
        if j + 1 in lengths:
            h = (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            out[j + 1] = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
    return out


def _seeds(fuzziness: float):
    """Rows (tk, seed, n) of terms: the hash of each seed's first SEED characters, and how many these are; 0 for terms that any text may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tk, term in zip(batch.column("tk").to_pylist(), batch.column("term").to_pylist(), strict=True):
                key, edits, parts = search.term_seeds(term, fuzziness)
                if key and len(key) <= edits:
                    rows.append((tk, 0, 0))
                for part in {p[:SEED] for p, _ in parts}:
                    (h,) = hashes(search._codes(part), {len(part)})[len(part)].view(np.int64)
                    rows.append((tk, int(h), len(part)))
            if rows:
                tk, seed, n = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(tk, pa.int64()), pa.array(seed, pa.int64()), pa.array(n, pa.int32())], names=["tk", "seed", "n"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("key", pa.array([" ".join(t.lower().split()) for t in batch.column("term").to_pylist()], pa.string()))


def _held(lengths: set[int], table):
    """Rows (r1, r2, seed) of pages: the distinct hashes of their parts that are in the table of bits, and 0 if a term wants every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint64)

        def packed(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            n = [len(x) for _, _, x in rows]
            names = [np.repeat(np.array([row[i] for row in rows], np.int64), n) for i in (0, 1)]
            return pa.record_batch([pa.array(names[0]), pa.array(names[1]), pa.array(np.concatenate([x for _, _, x in rows]))], names=["r1", "r2", "seed"])

        for batch in batches:
            rows, held = [], 0
            for r1, r2, text in zip(*(batch.column(c).to_pylist() for c in ("r1", "r2", "text")), strict=True):
                found = [np.zeros(int(0 in lengths), np.uint64)]
                for h in hashes(search._codes(search._lower(search.plain_text(text))), lengths).values():
                    slot = h >> np.uint64(40)
                    found.append(h[(bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1])
                rows.append((r1, r2, np.unique(np.concatenate(found)).view(np.int64)))
                held += len(rows[-1][2])
                if held > ROWS:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

    return run


def _sweep(fuzziness: float):
    """Places, from rows ordered by page and step: 0 the page's text (as often as the row is repeated), 1 the terms that met it."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    names = [x.split()[0] for x in search.FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, pages, terms, chars, out = None, [], [], 0, []

        def settle() -> None:
            nonlocal terms, chars
            if terms:
                finder = search.TermFinder([(i, t) for i, (_, t) in enumerate(terms)], fuzziness)
                for doc, page, text in pages:
                    out.extend((terms[i][0], doc, page, k, a, b, text[a:b]) for i, k, a, b in finder.find(text))
            terms, chars = [], 0

        def flushed() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return got

        for batch in batches:
            for r1, r2, step, doc, page, text, term_id in zip(*(batch.column(c).to_pylist() for c in ("r1", "r2", "step", "doc_id", "page_number", "text", "term_id")), strict=True):
                if (r1, r2) != here:
                    settle()
                    here, pages = (r1, r2), []
                if step == 0:
                    pages.append((doc, page, text))
                else:
                    terms.append((term_id, text))
                    chars += len(text)
                    if chars > TERM_CHARS:
                        settle()
            if out:
                yield flushed()
        settle()
        if out:
            yield flushed()

    return run


def known_terms(terms: DataFrame) -> DataFrame:
    """(tk, term_id, term) of a table (term_id, term): terms that differ only in case or white space once, the one with
    the least id (and text); null and blank ones not at all. tk names a term by its hash."""
    rows = terms.select(F.col("term_id").cast("long").alias("term_id"), F.col("term").cast("string").alias("term")).where("term IS NOT NULL")
    rows = rows.mapInArrow(_keyed, "term_id long, term string, key string").where("key <> ''")
    rows = rows.groupBy("key").agg(F.min(F.struct(F.col("term_id").isNull().alias("none"), "term_id", "term")).alias("t"))
    return rows.select(F.xxhash64("key").alias("tk"), "t.term_id", "t.term")


def bit_table(seeds: DataFrame) -> bytes:
    """BITS bits, those of all seeds' hashes set, put together by words of 64 in a grouping."""
    words = seeds.where("n > 0").select((F.shiftrightunsigned("seed", 46)).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(seed, 40) & 63 as int))").alias("bits"))
    bits = np.zeros(BITS // 64, np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():  # BITS / 64 rows at most
        bits[row.word] = row.bits
    return bits.tobytes()


def search_table(pages: DataFrame, terms: DataFrame, fuzziness: float = 1.0) -> DataFrame:
    """All places (search.FOUND) of the terms (term_id, term) on all pages (doc_id, page_number, text), as
    search.TermFinder finds them. Other columns are ignored; null and empty texts hold nothing; pages that are repeated give their
    places as often; null documents, numbers and ids of terms stay null; no terms or no pages give no rows."""
    spark = pages.sparkSession
    known = stored(known_terms(terms))
    seeds = stored(known.select("tk", "term").mapInArrow(_seeds(fuzziness), "tk long, seed long, n int"))
    lengths = {r.n for r in seeds.select("n").distinct().collect()}  # SEED + 1 at most
    table = spark.sparkContext.broadcast(bit_table(seeds))
    own = ["doc_id", "page_number", "text"]
    rows = pages.select(F.col("doc_id").cast("string"), F.col("page_number").cast("long"), "text").where("text <> ''")
    rows = rows.withColumns({"r1": F.xxhash64(*own), "r2": F.xxhash64(F.lit("r2"), *reversed(own))})
    held = spread(rows.select("r1", "r2", "text")).mapInArrow(_held(lengths, table), "r1 long, r2 long, seed long")
    met = stored(held.join(seeds.select("tk", "seed"), "seed").select("r1", "r2", "tk").distinct())
    wanted = met.join(known, "tk").select("r1", "r2", F.lit(1).alias("step"), F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("long").alias("page_number"), F.col("term").alias("text"), "term_id")
    texts = rows.join(met.select("r1", "r2").distinct(), ["r1", "r2"], "left_semi").select("r1", "r2", F.lit(0).alias("step"), *own, F.lit(None).cast("long").alias("term_id"))
    # The number of partitions is set: what is read is small beside the work that it makes.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    dealt = texts.unionByName(wanted).repartition(parts, "r1", "r2").sortWithinPartitions("r1", "r2", "step", "term_id", "text")
    return dealt.mapInArrow(_sweep(fuzziness), search.FOUND)
