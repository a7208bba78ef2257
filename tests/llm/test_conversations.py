from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from inkveil.llm import conversations as C

ROWS = "conv_id long, turn long, role string, text string, audit string, conv string, codes int, d1 string, step int, part string"
SHAPE = re.compile(r"(s?(ua)+)?")
NEXT, NAME = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "c", 1, "d", 2, "p") for r in rows], ROWS)


def best(initials, faults):
    """(cost, audit) by comparing whole strings, forwards over what the repaired turns end with."""

    @functools.cache
    def after(i, last, inserts):
        found = []
        if i == len(initials) and last in ("", "a"):
            found.append((0, ""))
        if inserts < 3:
            c, a = after(i, NEXT[last], inserts + 1)
            found.append((c + 3, "I" + a))
        if i < len(initials):
            c, a = after(i + 1, last, 0)
            found.append((c + 4, "D" + a))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                if initials[i] == NEXT[last] or (initials[i] == "s" and last == ""):
                    c, a = after(i + 1, initials[i], 0)
                    found.append((c + extra, "K" + a))
                c, a = after(i + 1, NEXT[last], 0)
                found.append((c + extra + 3, "R" + a))
        return min(found, default=(10**9, ""))

    return after(0, "", 0)


def brute(rows):
    """Contract's result for rows (conv_id, turn, role, text), after damage."""
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c]
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[c] += [(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        faults, seen = [], set()
        for _, role, text in turns:
            end = text.rstrip(C.SPACES)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in turns]
        cost, audit = best(initials, faults)
        kept, i, last = [], 0, ""
        for e in audit:
            if e == "I":
                last = NEXT[last]
                kept.append(f"{NAME[last]}:")
                continue
            if e != "D":
                last, role = (initials[i], turns[i][1]) if e == "K" else (NEXT[last], NAME[NEXT[last]])
                kept.append(f"{role}:{turns[i][2]}")
            i += 1
        assert SHAPE.fullmatch("".join(k[:1] for k in kept)) and i == len(turns)
        numbers = {t for t, _, _ in turns if t is not None}
        out[c] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                  sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def made(seed, n, longest=12):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "sage", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "Why?", "and then", "", " \n", None, "Fine. \n", "é…", "Yes.", f"n{rng.random()}."])
            rows.append((c, None if rng.random() < 0.02 else t * rng.choice([1, 1, 1, 2]) + 1000 * t, role, text))
    return rows


def op13(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op13(spark, str(tmp_path)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_repair_is_as_brute_force(spark, tmp_path):
    rows = made(1, 400) + [(None, 1, "user", "Hi."), (None, None, "assistant", None), (None, 2, None, "So.")]
    rows += [(900, None, "user", "Yes."), (900, None, "user", "Yes."), (901, None, None, None)]
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows.append((lost, 1, "user", "All dropped."))
    expected = brute(rows)
    assert op13(spark, rows, tmp_path) == expected
    assert expected[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_conversations(spark, tmp_path):
    assert op13(spark, [], tmp_path) == {}


@pytest.mark.parametrize("segment, block", [(7, 3), (1, 1), (64, 256)])
def test_segments_give_the_edits_of_the_whole(monkeypatch, segment, block):
    monkeypatch.setattr(C, "SEGMENT", segment)
    monkeypatch.setattr(C, "BLOCK", block)
    rng = np.random.default_rng(5)
    codes = [rng.choice(16, rng.integers(1, 200), p=[0.04] * 4 + [0.12, 0.05, 0.05, 0.1] * 2 + [0.05] * 4).astype(np.uint8) for _ in range(150)]
    for c, (cost, edits) in zip(codes, C.solve(codes), strict=True):
        assert (cost, edits.decode()) == best(tuple("sua_"[x >> 2] for x in c), tuple(("", "blank", "duplicate", "truncated")[x & 3] for x in c))


def test_every_short_conversation():
    codes = [np.array(c, np.uint8) for n in range(4) for c in itertools.product(range(16), repeat=n)]
    for c, (cost, edits) in zip(codes, C.solve(codes), strict=True):
        assert (cost, edits.decode()) == best(tuple("sua_"[x >> 2] for x in c), tuple(("", "blank", "duplicate", "truncated")[x & 3] for x in c))


def test_one_very_long_conversation_and_a_very_long_text(spark, tmp_path):
    """A hot conversation of 60,000 turns, a third of them alike; one turn of 30 MB."""
    n = 60_000
    turns = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "CASE id % 5 WHEN 0 THEN 'user' WHEN 4 THEN 'system' ELSE 'assistant' END AS role", "CASE WHEN id % 3 = 0 THEN 'Same.' WHEN id = 1 THEN repeat('long text ', 3000000) ELSE concat('turn ', id, '.') END AS text")
    found, after = C.repair(turns.unionByName(turns.limit(10).withColumn("conv_id", turns.conv_id + 1)))
    rows = {r.conv: r for r in found.collect()}
    codes, seen = [], set()
    for i in range(n):
        initial = {0: C.U, 4: C.S}.get(i % 5, C.A)
        again = i % 3 == 0 and initial in seen
        seen |= {initial} if i % 3 == 0 else set()
        codes.append(4 * initial + (C.DUPLICATE if again else C.CUT if i == 1 else C.FINE))
    cost, edits = C.solve([np.array(codes, np.uint8)])[0]
    assert (rows[7].cost, rows[7].audit) == (cost, edits.decode()) and set(rows) == {7, 8}
    kept = after.where("conv = 7").orderBy("place").collect()
    assert [r.place for r in kept] == list(range(len(kept))) and SHAPE.fullmatch("".join(r.role[:1] for r in kept))
    assert "".join(r.edit for r in kept) == edits.decode().replace("D", "")
