"""Best-fit packing of tokenized documents into sequences, bulk-synchronously.

Documents are tokenized where they are read; those longer than a sequence are cut into full pieces
(the first may be shorter). Pieces of more than half a sequence open one each. What is left is packed in supersteps over
one table, the state: gaps of sequences, and pieces without a place. A superstep is one job that reads a state and
writes the next one with the places found, and it counts what it leaves (Dataset.observe), so no job only looks.

* A sweep puts pieces and gaps in one order, by falling size, a gap before pieces of its size (the order is
  cut into buckets of one size, whose counts, summed in order, place every row). A piece takes the last gap before
  it that no earlier piece takes, which is its successor: the least gap that holds it. Conflicts are resolved by
  rank: with gaps counted up and pieces counted down, a piece and the gap that it takes stand at one level, next to
  each other among the rows of that level, so one window over the levels finds all matches of a sweep at once.
* Pieces of more than an eighth of a sequence are swept all together: what a piece does not get is taken by larger
  pieces, so a smaller piece never keeps a larger one from a gap. When no gap holds any of the class of the longest
  pieces left, these open sequences, filled in order of rank, and sweeps go on.
* Shorter ones are swept by classes of falling length, and a gap stands in the order once for each of the class's
  longest pieces that it holds. Gaps larger than any that best fit would take stay out of the sweep; they are found from
  a count for each size of gap (at most `capacity` numbers, the only rows that the driver reads).

Supersteps run without adaptive execution, which would make several jobs of each; their partitions follow the
rows of the state. Numbers in their plans are few, so compiled code is used again.

Defined results: a null or empty text is one piece with the end id; every row is packed, repeated
rows and null ids included; other columns are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import Scratch, arrow, load, release, tune, whole

#: Characters of whose class all Unicode versions agree; other texts go to the tokenizers library.
UNSAFE = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ‐-‧€]")
#: Rows of a state in a partition of a sweep. Bounds of gaps are multiples of STEP.
ROWS_PER_PART, STEP = 1 << 17, 64
_ENCODERS: dict[tuple[str, str], object] = {}


def encoder(json_path: str, ranks_path: str):
    """text -> ids as tokenizers gives them. tiktoken does the work where its rules agree surely."""
    key = (json_path, ranks_path)
    if key not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(json_path)
        tok.no_padding()
        tok.no_truncation()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        specials = [t.content for t in tok.get_added_tokens_decoder().values()]

        def encode(text: str) -> list[int]:
            if UNSAFE.search(text) or any(s in text for s in specials):
                return tok.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _ENCODERS[key] = encode
    return _ENCODERS[key]


def _pieces(json_path: str, ranks_path: str, capacity: int, end_id: int, with_ids: bool):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(json_path, ranks_path)
        out: list[list] = [[] for _ in range(6)]
        for i, text in enumerate(batch.column("text").to_pylist()):
            ids = encode(text)
            ids.append(end_id)
            raw, n = np.array(ids, "<u4").tobytes(), len(ids)
            first = n if n <= capacity else n % capacity or capacity
            for k, start in enumerate([0, *range(first, n, capacity)]):
                stop = first if not k else start + capacity
                part = raw[4 * start : 4 * stop]
                for column, value in zip(out, (i, k, start, stop - start, zlib.crc32(part), part if with_ids else None), strict=True):
                    column.append(value)
        rows = batch.column("row").take(pa.array(out[0], pa.int64()))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ["row", "piece", "start", "length", "ids_crc32", "ids"]
        return pa.record_batch([rows, *(pa.array(c, t) for c, t in zip(out[1:], kinds, strict=True))], names=names)

    return kernel


def classes(capacity: int) -> list[tuple[int, int]]:
    """(low, high) of the classes of lengths, low excluded: first by how many fit a sequence, then by halves."""
    found, top = [], capacity
    while top > max(16, capacity // 8):
        low = capacity // (capacity // top + 1)
        found.append((low, top))
        top = low
    while top:
        low = top // 2
        found.append((low, top))
        top = low
    return found


#: Gaps (id: the sequence, size) have kind 0, pieces without a place (id: the tie, size) 1, places found 2.
STATE = "id long, size long, seq long, offset long, kind int"


@contextmanager
def one_job(spark: SparkSession):
    """What runs inside becomes one job, whatever it shuffles."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def parts_for(rows: int) -> int:
    """Partitions for so many rows: a power of two, so that few different numbers come into plans."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows) / ROWS_PER_PART)))


def ranked(rows: str, by: str, ids: str, parts: int) -> str:
    """SQL of rows (size, step and the columns of `by` and `ids`) in one order by (size falling, then `by`): bucket, the
    number of the row's bucket; r, its rank there from 1; n_before and size_before, sums of `step` and of size over
    all buckets before. step is one for a bucket. Buckets are a row for each size, kind and part, and are broadcast."""
    return f"""(WITH dealt AS (SELECT /*+ REPARTITION({parts}, size, {by} salt) */ * FROM (SELECT *, pmod(xxhash64({ids}), {parts}) AS salt FROM {rows})),
  sums AS (SELECT size AS b_size, {by} salt AS b_salt, sum(step) AS n, sum(size) AS all FROM dealt GROUP BY size, {by} salt),
  buckets AS (SELECT *, row_number() OVER w AS bucket, coalesce(sum(n) OVER before, 0) AS n_before,
    coalesce(sum(all) OVER before, 0) AS size_before FROM sums WINDOW w AS (ORDER BY b_size DESC, {by} b_salt), before AS (ORDER BY b_size DESC, {by} b_salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT /*+ BROADCAST(b) */ d.*, b.bucket, b.n_before, b.size_before FROM (SELECT *, row_number() OVER (PARTITION BY size, {by} salt ORDER BY {ids}) AS r FROM dealt) d
  JOIN buckets b ON d.size = b_size AND {"d.kind = b.kind AND" if by else ""} d.salt = b_salt)"""


NONE = "CAST(NULL AS BIGINT)"


def sweep(state: DataFrame, capacity: int, low: int, high: int, most: int, several: bool, parts: int) -> DataFrame:
    """The next state: pieces in (low, high] meet gaps in (low, most]; several: a gap takes as many as it surely holds."""
    inside = f"size > {low} AND size <= IF(kind = 1, {high}, {most})"
    copies = f"IF(kind = 0, greatest(1, CAST(size div {high} AS INT)), 1)" if several else "1"
    rows = f"(SELECT kind, id, size, IF(kind = 0, 1, -1) AS step, explode(sequence(1, {copies})) AS turn FROM {{state}} WHERE {inside})"
    own = "OVER (PARTITION BY kind, id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND"
    sums = f"coalesce(sum(took) {own} 1 PRECEDING), 0) AS before, coalesce(sum(took) {own} UNBOUNDED FOLLOWING), 0) AS taken" if several else "0L AS before, coalesce(took, 0L) AS taken"
    return state.sparkSession.sql(
        f"""WITH levels AS (SELECT /*+ REPARTITION({parts}, level) */ * FROM (SELECT kind, id, size, turn, bucket, n_before + IF(kind = 0, r, 1 - r) AS level FROM {ranked(rows, "kind,", "id, turn", parts)})),
  met AS (SELECT kind, id, size, turn, lag(kind) OVER w AS last, lead(kind) OVER w AS next, lead(id) OVER w AS next_id, lead(size) OVER w AS next_size FROM levels WINDOW w AS (PARTITION BY level ORDER BY bucket)),
  took AS (SELECT {f"/*+ REPARTITION({parts}, kind, id) */" if several else ""} *, IF(kind = 0 AND next = 1, next_size, NULL) AS took FROM met),
  summed AS (SELECT *, {sums} FROM took),
  made AS (SELECT explode(array_compact(array(
    IF(took IS NOT NULL, named_struct('id', next_id, 'size', took, 'seq', id, 'offset', {capacity} - size + before, 'kind', 2), NULL),
    IF(kind = 0 AND turn = 1 AND size > taken, named_struct('id', id, 'size', size - taken, 'seq', {NONE}, 'offset', {NONE}, 'kind', 0), NULL),
    IF(kind = 1 AND NOT coalesce(last = 0, false), named_struct('id', id, 'size', size, 'seq', {NONE}, 'offset', {NONE}, 'kind', 1), NULL)))) AS e FROM summed)
  SELECT e.* FROM made UNION ALL SELECT id, size, {NONE}, {NONE}, kind FROM {{state}} WHERE NOT ({inside})""",
        state=state,
    )


def opened(state: DataFrame, capacity: int, low: int, high: int, count: int, total: int, base: int, parts: int) -> DataFrame:
    """The next state: pieces in (low, high] open sequences, so many to each by rank, or by the tokens before each,
    whichever needs fewer."""
    inside = f"kind = 1 AND size > {low} AND size <= {high}"
    each, width = capacity // high, capacity - high + 1
    number = f"rank div {each}" if -(-count // each) <= -(-total // width) else f"start div {width}"
    rows = f"(SELECT id, size, 1 AS step FROM {{state}} WHERE {inside})"
    return state.sparkSession.sql(
        f"""WITH placed AS (SELECT id, size, n_before + r - 1 AS rank, size_before + (r - 1) * size AS start FROM {ranked(rows, "", "id", parts)}),
  named AS (SELECT /*+ REPARTITION({parts}, seq) */ id, size, rank, {base}L + {number} AS seq FROM placed),
  filled AS (SELECT *, coalesce(sum(size) OVER before, 0L) AS offset, lead(rank) OVER w IS NULL AS last FROM named WINDOW w AS (PARTITION BY seq ORDER BY rank), before AS (PARTITION BY seq ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  made AS (SELECT explode(array_compact(array(
    named_struct('id', id, 'size', size, 'seq', seq, 'offset', offset, 'kind', 2),
    IF(last AND offset + size < {capacity}, named_struct('id', seq, 'size', {capacity} - offset - size, 'seq', {NONE}, 'offset', {NONE}, 'kind', 0), NULL)))) AS e FROM filled)
  SELECT e.* FROM made UNION ALL SELECT id, size, {NONE}, {NONE}, kind FROM {{state}} WHERE NOT ({inside})""",
        state=state,
    )


def begun(pieces: DataFrame, capacity: int) -> DataFrame:
    """The first state: pieces of more than half a sequence open one each."""
    return pieces.sparkSession.sql(
        f"""SELECT e.* FROM (SELECT explode(array_compact(CASE WHEN length > {capacity // 2} THEN array(
    named_struct('id', tie, 'size', length, 'seq', tie, 'offset', 0L, 'kind', 2),
    IF(length < {capacity}, named_struct('id', tie, 'size', {capacity}L - length, 'seq', {NONE}, 'offset', {NONE}, 'kind', 0), NULL))
  ELSE array(named_struct('id', tie, 'size', length, 'seq', {NONE}, 'offset', {NONE}, 'kind', 1)) END)) AS e
  FROM (SELECT CAST(tie AS BIGINT) AS tie, CAST(length AS BIGINT) AS length FROM {{pieces}}))""",
        pieces=pieces,
    )


def pack_lengths(pieces: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """(tie, length, seq, offset) for all pieces (tie, length); ties are distinct and below 2**52."""
    spark, half, spans = pieces.sparkSession, capacity // 2, classes(capacity)
    at: dict[str, int] = {}
    turn = 0
    sums = ["count_if(kind = 0) AS gaps", "max(IF(kind = 0, size, NULL)) AS widest"]
    for k, (low, high) in enumerate(spans):
        own = f"IF(kind = 1 AND size > {low} AND size <= {high}, size, NULL)"
        sums += [f"count({own}) AS n{k}", f"sum({own}) AS all{k}", f"min({own}) AS least{k}"]
    sums = [F.expr(x) for x in sums]

    def written(rows: DataFrame) -> DataFrame:
        """rows stored by kind; `at` gets the counts of what they leave."""
        nonlocal turn
        turn += 1
        seen = Observation()
        with one_job(spark):
            rows.observe(seen, *sums).write.partitionBy("kind").option("compression", "zstd").parquet(scratch.path(f"state-{turn}"))
        at.update({k: v or 0 for k, v in seen.get.items()})
        if turn > 1:  # places stay, the state before is not read again
            for kind in (0, 1):
                scratch.drop(f"state-{turn - 1}/kind={kind}")
        if turn % 4 == 0:
            release(spark)
        return spark.read.schema(STATE).parquet(scratch.path(f"state-{turn}")).where("kind < 2")

    state = written(begun(pieces, capacity))
    wide = [k for k, (low, high) in enumerate(spans) if low < half and high > max(16, capacity // 8)]
    for k, (low, high) in enumerate(spans):
        while high <= half and at[f"n{k}"]:
            if at["widest"] < at[f"least{k}"]:  # no gap holds any of the longest pieces left
                rows = at["gaps"] + at[f"n{k}"]
                state = written(opened(state, capacity, low, high, at[f"n{k}"], at[f"all{k}"], (k + 1) << 52, parts_for(rows)))
            elif k in wide:
                rows = at["gaps"] + sum(at[f"n{j}"] for j in wide)
                state = written(sweep(state, capacity, spans[wide[-1]][0], half, capacity, False, parts_for(rows)))
            else:
                with one_job(spark):
                    sizes = sorted((r.size, r["count"]) for r in state.where(f"kind = 0 AND size > {low}").groupBy("size").count().collect())
                enough, rows = at[f"n{k}"], at[f"n{k}"]
                for most, n in sizes:  # gaps beyond those that best fit would take stay out of the sweep
                    enough -= n * (most // high)
                    rows += n * max(1, most // high)
                    if enough <= 0:
                        break
                state = written(sweep(state, capacity, low, high, min(capacity, -(-most // STEP) * STEP), True, parts_for(rows)))
    done = [spark.read.schema(STATE).parquet(scratch.path(f"state-{t}")).where("kind = 2") for t in range(1, turn + 1)]
    return reduce(DataFrame.union, done).select(F.col("id").alias("tie"), F.col("size").alias("length"), "seq", "offset")


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = 1024, end_id: int = 2, text_col: str = "text", carry: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: `row` (a struct of the columns in carry, all by default), piece, start,
    length, ids_crc32, sequence_id, offset, and `ids` (little-endian, where with_ids asks for them)."""
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "packing")
    base = docs.select(F.struct(*[docs[c] for c in carry or docs.columns]).alias("row"), whole(text_col).alias("text"))
    schema = base.select("row").schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("ids", "binary")):
        schema = schema.add(name, kind)
    pieces = scratch.save(arrow(base, _pieces(json_path, ranks_path, capacity, end_id, with_ids), schema).withColumn("tie", F.monotonically_increasing_id()), "pieces")
    places = pack_lengths(pieces.select("tie", "length"), capacity, scratch).select("tie", F.col("seq").alias("sequence_id"), "offset")
    return pieces.join(places, "tie").select("row", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = pack_documents(load(spark, sf_dir, "documents"), *paths, carry=["doc_id"])
    return out.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
