"""Repair of conversations: the cheapest edits that leave turns of the form (system?(user assistant)+)?, or nothing.

Each turn is judged (blank, duplicate or truncated, the first that holds) and becomes one code of its role's
initial and its fault. Codes of a conversation stand in one string, as long as the edits that are the result; texts
never meet in it. A time-major dynamic program takes many conversations at once: they are bucketed by length,
a step updates the costs of all their states (nothing yet; after the system turn; after a user turn; after an
assistant turn) from the last turn to the first, the costs are stored, and edits are traced from the first turn to the
last, all conversations at once. Longer ones than SEGMENT turns are cut: segments are solved side by side for each
state that they may end in, their costs are chained, and they are traced from each state that they may start in.

Edits: Keep 0; Rerole to user or assistant 3; Delete 4 (the only one for blank and duplicate turns); Insert an
empty user or assistant turn anywhere 3; a truncated turn that stays costs 3 more. Of the cheapest edits those that
come first in ASCII (D, I, K, R) are taken: going forward the least edit that keeps the least cost is taken.

A turn's order: by turn, nulls first; turns of one number by role, then by a hash of the text. What is found per
value or turn is grouped and joined on keys that are unique, so a conversation may hold any share of all rows.
Repaired texts are made (or hashed) by one stream a conversation, in order, a batch in memory at a time.

Defined results: null roles and texts count as one space; a null id is one conversation; null turns have no part
in gaps; repeated rows are duplicates of the first; a role with no initial, or another than s, u and a, is never
kept; other columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import Scratch, arrow, load, tune

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 may end.
NEXT = np.array([2, 2, 3, 2])
ROLE = ("user", "user", "assistant", "user")  # of the turn that leads to NEXT
#: Initials and faults as they stand in codes: chr(FIRST + 4 * initial + fault).
S, U, A, OTHER = range(4)
FINE, BLANK, DUPLICATE, CUT = range(4)
FIRST, PAD = 65, 255
NEEDED = np.array([U, U, A, U])
ENDS = np.array([0, 2 * INSERT, INSERT, 0])
FAR = 1 << 28
SEGMENT, BLOCK = 1024, 256
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role and text of a table of turns, nulls of the latter two as one space, and d1 and d2, which name (role, text)."""
    out = rows.select(rows[conv].cast("long").alias("conv"), rows[turn].cast("long").alias("turn"), F.coalesce(rows[role], F.lit(" ")).alias("role"), F.coalesce(rows[text], F.lit(" ")).alias("text"))
    return out.select("*", F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit("d2"), "text", "role").alias("d2"))


def _code(initial: Column, fault: Column) -> Column:
    return F.char((F.lit(FIRST) + 4 * initial + fault).cast("long"))


def coded(rows: DataFrame) -> DataFrame:
    """conv, turn, role, d1, d2 and codes, for each distinct turn of each conversation."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    last = F.substring(end, -1, 1)
    light = rows.select("conv", "turn", "role", "d1", "d2", F.when(end == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(CUT).alias("fault"))
    alike = light.groupBy("conv", "turn", "role", "d1", "d2").agg(F.count("*").alias("n"), F.first("fault").alias("fault"))
    seen = light.groupBy("conv", "d1", "d2").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).getField("turn").alias("turn"))
    first = seen.select(*(F.col(c).alias(f"f_{c}") for c in seen.columns))
    same = [alike[c].eqNullSafe(first[f"f_{c}"]) for c in seen.columns]  # unique on both sides
    initial = F.substring("role", 1, 1)
    initial = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER)
    out = alike.join(first, on=same, how="left").withColumn("again", F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE))
    own = F.when(F.col("f_d1").isNotNull(), F.col("fault")).otherwise(F.col("again"))
    codes = F.concat(_code(initial, own), F.repeat(_code(initial, F.col("again")), (F.col("n") - 1).cast("int")))
    return out.select("conv", "turn", "role", "d1", "d2", codes.alias("codes"))


#: Nulls come first, as they do in Spark's ascending order.
ORDER = ["turn", "role", "d1", "d2"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of neighbouring rows of one conversation, joined; `k` counts them."""
    k = 0
    for batch in batches:
        conv, part = batch.column("conv"), batch.column("part")
        names = conv.to_pylist()
        at = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1])]
        codes = batch.column("codes").to_pylist()
        joined = ["".join(codes[a:b]) for a, b in zip(at, [*at[1:], len(codes)], strict=True)]
        yield pa.record_batch([conv.take(pa.array(at)), part.take(pa.array(at)), pa.array(range(k, k + len(at)), pa.int64()), pa.array(joined)], names=["conv", "part", "k", "codes"])
        k += len(at)


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least costs [T + 1, B, 4] from each state before each turn, for codes [T, B] and costs [B, 4] at the end."""
    n, width = codes.shape
    costs = np.empty((n + 1, width, 4), np.int32)
    costs[n] = end
    for i in range(n - 1, -1, -1):
        after = costs[i + 1]
        initial, fault = codes[i] >> 2, codes[i] & 3
        stays = np.where((fault == BLANK) | (fault == DUPLICATE), FAR, np.where(fault == CUT, TRUNCATED, 0)).astype(np.int32)[:, None]
        on = np.where(initial[:, None] == NEEDED, KEEP, REROLE) + after[:, NEXT] + stays
        on[:, 0] = np.where(initial == S, np.minimum(on[:, 0], after[:, 1] + stays[:, 0]), on[:, 0])
        row = np.minimum(on, after + DELETE)
        once = row[:, NEXT] + INSERT
        best = np.minimum(np.minimum(row, once), once[:, NEXT] + INSERT)
        costs[i] = np.where((codes[i] == PAD)[:, None], after, np.minimum(best, FAR))
    return costs


def trace(codes: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits [T, 3, B] (0: none) that come first in ASCII, and the states after the last turn."""
    n, width = codes.shape
    edits, state, b = np.zeros((n, 3, width), np.uint8), state.copy(), np.arange(width)
    for i in range(n):
        initial, fault = codes[i] >> 2, codes[i] & 3
        open_, extra = codes[i] != PAD, np.where(fault == CUT, TRUNCATED, 0)
        able = (fault == FINE) | (fault == CUT)
        for k in range(3):
            cost, to = costs[i, b, state], NEXT[state]
            d = open_ & (costs[i + 1, b, state] + DELETE == cost)
            ins = open_ & ~d & (costs[i, b, to] + INSERT == cost)
            system = (initial == S) & (state == 0) & (costs[i + 1, :, 1] + extra == cost)
            plain = (initial == NEEDED[state]) & (costs[i + 1, b, to] + extra + KEEP == cost)
            kept = open_ & ~d & ~ins & able & (system | plain)
            rest = open_ & ~d & ~ins & ~kept
            edits[i, k] = d * ord("D") + ins * ord("I") + kept * ord("K") + rest * ord("R")
            state = np.where(ins | rest | (kept & plain), to, np.where(kept, 1, state))
            open_ = ins
    return edits, state


def _columns(codes: list[np.ndarray]) -> np.ndarray:
    """Codes of conversations as columns, ends aligned."""
    out = np.full((max(map(len, codes)), len(codes)), PAD, np.uint8)
    for b, c in enumerate(codes):
        out[len(out) - len(c) :, b] = c
    return out


def _text(edits: np.ndarray) -> bytes:
    flat = edits.ravel()
    return flat[flat != 0].tobytes()


TAIL = (b"", b"II", b"I", b"")


def solve_long(codes: np.ndarray) -> tuple[int, bytes]:
    """Cost and edits of one conversation by segments of SEGMENT turns."""
    parts = [codes[i : i + SEGMENT] for i in range(0, len(codes), SEGMENT)]
    unit = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int32)
    through = []  # for each segment, costs [state at its end, state at its start]
    for i in range(0, len(parts), BLOCK):
        some = parts[i : i + BLOCK]
        got = backward(np.repeat(_columns(some), 4, axis=1), np.tile(unit, (len(some), 1)))[0]
        through.extend(got.reshape(len(some), 4, 4).astype(np.int64))
    ends = [ENDS.astype(np.int64)]
    for m in through[:0:-1]:
        ends.append((m + ends[-1][:, None]).min(axis=0))
    total = int((through[0] + ends[-1][:, None]).min(axis=0)[0])
    ends.reverse()
    near = [np.minimum(e - e.min(), FAR).astype(np.int32) for e in ends]  # only differences tell edits apart
    out, at = [], 0
    for i in range(0, len(parts), BLOCK):
        c = _columns(parts[i : i + BLOCK])
        n = c.shape[1]
        wide = np.repeat(c, 4, axis=1)
        costs = np.repeat(backward(c, np.array(near[i : i + n])), 4, axis=1)
        edits, state = trace(wide, costs, np.tile(np.arange(4), n))
        for k in range(n):
            out.append(_text(edits[:, :, 4 * k + at]))
            at = int(state[4 * k + at])
    return total, b"".join([*out, TAIL[at]])


def solve(codes: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """Least cost and edits of each conversation, given the codes of its turns (4 * initial + fault)."""
    out: list[tuple[int, bytes]] = [(0, b"")] * len(codes)
    sizes = np.array([len(c) for c in codes])
    bucket = np.where(sizes > SEGMENT, -1, np.ceil(np.log2(np.maximum(sizes, 1))))
    for size in np.unique(bucket):
        of = np.flatnonzero(bucket == size)
        if size < 0:
            for b in of:
                out[b] = solve_long(codes[b])
            continue
        c = _columns([codes[b] for b in of])
        costs = backward(c, np.tile(ENDS.astype(np.int32), (len(of), 1)))
        edits, state = trace(c, costs, np.zeros(len(of), np.int64))
        for k, b in enumerate(of):
            out[b] = int(costs[0, k, 0]), _text(edits[:, :, k]) + TAIL[state[k]]
    return out


def _solve(batch: pa.RecordBatch) -> pa.RecordBatch:
    codes = [np.frombuffer(c.encode(), np.uint8) - np.uint8(FIRST) for c in batch.column("codes").to_pylist()]
    faults = [np.bincount(c & 3, minlength=4) for c in codes]
    illegal = []
    for c in codes:
        a, b = c[:-1] >> 2, c[1:] >> 2
        illegal.append(int((~(((a == S) & (b == U)) | ((a == U) & (b == A)) | ((a == A) & (b == U)))).sum()))
    found = solve(codes)
    counts = [[int(f[k]) for f in faults] for k in (BLANK, DUPLICATE, CUT)]
    arrays = [*(pa.array(x, pa.int64()) for x in (*counts, illegal, [c for c, _ in found])), pa.array([e.decode() for _, e in found])]
    return pa.record_batch([batch.column("conv"), *arrays], names=["conv", *COUNTS, "audit"])


def judged(rows: DataFrame) -> DataFrame:
    """conv, the counts of faults and of illegal neighbours, cost and audit, for rows of `turns`."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    codes = Scratch(spark, "conversations").save(coded(rows), "codes")
    dealt = codes.repartitionByRange(parts, "conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    runs = dealt.select("conv", F.spark_partition_id().alias("part"), "codes").mapInArrow(_runs, "conv long, part int, k long, codes string")
    whole = runs.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "k", "codes"))), lambda r: r.codes), "").alias("codes"))
    return arrow(whole, _solve, RESULT)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, None, None, None) for each conversation, then (conv, role, text, edit) of what it holds after its edits."""
    conv = audit = None
    at = state = 0

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield conv, ROLE[state], "", "I"
            state, at = NEXT[state], at + 1

    for batch in batches:
        for c, edits, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "audit", "role", "text")), strict=True):
            if edits is not None:
                if audit is not None:
                    yield from inserted()
                conv, audit, at, state = c, edits, 0, 0
                yield conv, None, None, None
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                yield conv, role, text, edit
                state = 1 if state == 0 and role[:1] == "s" else NEXT[state]
            elif edit == "R":
                yield conv, ROLE[state], text, edit
                state = NEXT[state]
    if audit is not None:
        yield from inserted()


def _stream(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Every conversation in one partition, its edits before its turns, these in order."""
    head = results.select("conv", F.lit(0).alias("step"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), "audit", F.lit("").alias("text"))
    body = rows.select("conv", F.lit(1).alias("step"), "turn", "role", "d1", "d2", F.lit(None).cast("string").alias("audit"), "text")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = head.unionByName(body).repartition(parts, "conv").sortWithinPartitions("conv", "step", *ORDER)
    return dealt.select("conv", "audit", "role", "text")


def repaired(rows: DataFrame, results: DataFrame) -> DataFrame:
    """conv, place (from 0), role, text and edit of all turns after repair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = [], 0
        for conv, role, text, edit in _edited(batches):
            if edit is None:
                place = 0
                continue
            held.append((conv, place, role, text, edit))
            place += 1
            if len(held) == 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema=kinds)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema=kinds)

    names = ["conv", "place", "role", "text", "edit"]
    kinds = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)))
    return _stream(rows, results).mapInArrow(run, "conv long, place long, role string, text string, edit string")


def digests(rows: DataFrame, results: DataFrame) -> DataFrame:
    """conv and the SHA-256 of its repaired turns, role:text, joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        sha = None
        for conv, role, text, edit in _edited(batches):
            if edit is None:
                if sha is not None:
                    out.append((last, sha.hexdigest()))
                sha, last, begun = hashlib.sha256(), conv, False
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string()), strict=True)], names=["conv", "repaired_sha256"])
                    out = []
                continue
            sha.update(f"\n{role}:{text}".encode() if begun else f"{role}:{text}".encode())
            begun = True
        if sha is not None:
            out.append((last, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string()), strict=True)], names=["conv", "repaired_sha256"])

    return _stream(rows, results).mapInArrow(run, "conv long, repaired_sha256 string")


def gaps(rows: DataFrame) -> DataFrame:
    """conv and the numbers missing between its least and greatest turn; rows with `gone` only name conversations."""
    there = rows.groupBy("conv", "turn").agg(F.min("gone").alias("gone")).withColumn("turn", F.when(~F.col("gone"), F.col("turn")))
    missing = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return there.groupBy("conv").agg(missing.alias("gaps"))


def assess(rows: DataFrame, every: DataFrame) -> DataFrame:
    """judged(rows) with gaps, for every conversation of `every` (conv, turn, gone): zeros and no edits without rows."""
    found = judged(rows).withColumnRenamed("conv", "j_conv")
    out = gaps(every).join(found, on=F.col("conv").eqNullSafe(F.col("j_conv")), how="left")
    return out.select("conv", "gaps", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(a row a conversation with its faults, cost and edits; all turns after repair) of a table of turns."""
    tune(rows.sparkSession)
    own = turns(rows, conv, turn, role, text)
    scratch = Scratch(rows.sparkSession, "conversations")
    found = scratch.save(assess(own, own.select("conv", "turn", F.lit(False).alias("gone"))), "assessed")
    return found, repaired(own, found)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the damage that a checksum of their id and turn deals them; `gone` marks those it drops."""
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(fill("conv_id"), F.lit(":"), fill("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", fill("role").alias("role"), fill("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind", (F.col("kind") == 0).alias("gone"))
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    all_rows = damaged(load(spark, sf_dir, "conversations"))
    every = all_rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), "gone")
    own = turns(all_rows.where("NOT gone"))
    found = Scratch(spark, "conversations").save(assess(own, every), "assessed")
    sha = digests(own, found).withColumnRenamed("conv", "d_conv")
    out = found.join(sha, on=F.col("conv").eqNullSafe(F.col("d_conv")))
    return out.select(F.col("conv").alias("conv_id"), "gaps", *COUNTS, "audit", "repaired_sha256")


_EDGE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The same edits by comparing whole strings: g has, for each state, the least (cost, edits) of what follows a turn.
ORACLE_OP13 = f"""
WITH RECURSIVE t(i, c, k) AS (SELECT i, CAST(i AS UBIGINT), 0 FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS e FROM t WHERE k = 8),
q AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS word FROM conversations),
z AS (SELECT q.*, CAST(xor(list_reduce(list_transform(range(1, length(word) + 1), lambda i: CAST(ascii(substr(word, i, 1)) AS UBIGINT)),
  lambda s, x: xor(s >> 8, tab.e[CAST(xor(s, x) % 256 AS BIGINT) + 1]), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) % 20 AS INTEGER) AS kind FROM q, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM z WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, {_EDGE}) AS solid, substr(role, 1, 1) AS first FROM d),
f AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(first) OVER (PARTITION BY conv_id ORDER BY i) || first AS two FROM o),
s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
dp(conv_id, i, g) AS (SELECT conv_id, n + 1, [{{'c': 0, 'a': ''}}, {{'c': 6, 'a': 'II'}}, {{'c': 3, 'a': 'I'}}, {{'c': 0, 'a': ''}}] FROM s UNION ALL
  SELECT conv_id, i, list_transform([1, 2, 3, 4], lambda p: list_min([r[p], {{'c': r[[3, 3, 4, 3][p]].c + 3, 'a': 'I' || r[[3, 3, 4, 3][p]].a}}, {{'c': r[[4, 4, 3, 4][p]].c + 6, 'a': 'II' || r[[4, 4, 3, 4][p]].a}}])) FROM (
    SELECT dp.conv_id, f.i, list_transform([1, 2, 3, 4], lambda p: list_min([{{'c': g[p].c + 4, 'a': 'D' || g[p].a}},
      {{'c': CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 ELSE g[[3, 3, 4, 3][p]].c + CASE WHEN fault = '' THEN 0 ELSE 3 END + CASE WHEN first = ['u', 'u', 'a', 'u'][p] THEN 0 ELSE 3 END END, 'a': CASE WHEN first = ['u', 'u', 'a', 'u'][p] THEN 'K' ELSE 'R' END || g[[3, 3, 4, 3][p]].a}},
      {{'c': CASE WHEN p > 1 OR first <> 's' OR fault IN ('blank', 'duplicate') THEN 1000000 ELSE g[2].c + CASE WHEN fault = '' THEN 0 ELSE 3 END END, 'a': 'K' || g[2].a}}])) AS r
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i - 1)),
e AS (SELECT conv_id, g[1].c AS cost, g[1].a AS audit FROM dp WHERE i = 1),
w(conv_id, audit, k, p, i) AS (SELECT conv_id, audit, 1, 1, CAST(1 AS BIGINT) FROM e UNION ALL
  SELECT w.conv_id, audit, k + 1, CASE WHEN substr(audit, k, 1) = 'D' THEN p WHEN substr(audit, k, 1) = 'K' AND p = 1 AND first = 's' THEN 2 ELSE [3, 3, 4, 3][p] END, w.i + CASE WHEN substr(audit, k, 1) = 'I' THEN 0 ELSE 1 END
  FROM w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i WHERE k <= length(audit)),
m AS (SELECT w.conv_id, k, CASE substr(audit, k, 1) WHEN 'K' THEN role || ':' || text WHEN 'R' THEN ['user', 'user', 'assistant', 'user'][p] || ':' || text ELSE ['user', 'user', 'assistant', 'user'][p] || ':' END AS line
  FROM w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i WHERE k <= length(audit) AND substr(audit, k, 1) <> 'D'),
h AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS lines FROM m GROUP BY 1),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""
