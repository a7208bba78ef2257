"""Quality rules by weak supervision.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the counts of
vote patterns (at most 3**rules of them, whatever the corpus) estimates each rule's accuracy and
the share of good documents without labels; a document is kept when the posterior probability that
it is good is at least one half. The hard base rule (too short, or too repetitive) always rejects.

Defined results: a null text has no words; a document without words fails the base rule and is not
kept; every row gives one row, repeated rows and null ids included; other columns are ignored,
whatever their names; an empty table gives an empty result. Texts are read whole, one batch at a
time; nothing but the vote patterns meets in one place.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm.common import Scratch, Words, arrow, load, tune, whole, windows

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
#: Names of the rules; see votes().
RULES = ("repetition", "symbols", "duplicate_lines", "word_length", "symbol_words", "length")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_symbol_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 5-word window which occurs twice or more in the list."""
    seen = Counter(tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1))
    covered = bytearray(len(words))
    for i in range(len(words) - WINDOW + 1):
        if seen[tuple(words[i : i + WINDOW])] > 1:
            covered[i : i + WINDOW] = b"\1" * WINDOW
    return sum(covered)


def _measure(texts: pa.Array) -> list[pa.Array]:
    w = Words.of(texts)
    counts = w.counts()
    strings = ["" if t is None else t for t in texts.to_pylist()]
    # A window hash that occurs twice in a text marks it for the exact count; no text with a repeat escapes.
    h = windows(w.hashes(), WINDOW)
    repeats = np.zeros(w.n_docs, bool)
    if len(h):
        doc = w.doc()
        own = doc[: len(h)] == doc[WINDOW - 1 :]
        keys = (h + doc[: len(h)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[own]
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        repeats[doc[: len(h)][own][order[1:][same]]] = True
    out: list[list[int]] = [[] for _ in range(6)]
    for i, text in enumerate(strings):
        lines = [x for x in text.split("\n") if x.strip(BLANKS)]
        symbols = sum(map(text.count, SYMBOLS))
        out[0].append(len(text) - sum(map(text.count, BLANKS)))
        out[1].append(symbols)
        out[2].append(len(lines) - len(set(lines)))
        out[3].append(repeated_words(text.encode().split()) if repeats[i] else 0)
        out[4].append(len(lines))
        out[5].append(sum(any(c in x for c in SYMBOLS) for x in text.split()) if symbols else 0)
    return [pa.array(counts, pa.int64())] + [pa.array(x, pa.int64()) for x in out]


def measure(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """One row per row of docs: `row`, a struct of the columns in carry (null if there are none), and `m`, the measures."""
    tune(docs.sparkSession)
    names = [x.split()[0] for x in MEASURES.split(", ")]
    row = F.struct(*[docs[c] for c in carry]) if carry else F.lit(None).cast("boolean")
    packed = docs.select(row.alias("row"), whole(text_col).alias("text"))
    schema = packed.select("row").schema.add("m", T.StructType([T.StructField(n, T.LongType()) for n in names]))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = pa.StructArray.from_arrays(_measure(batch.column("text")), names=names)
        return pa.record_batch([batch.column("row"), m], names=["row", "m"])

    return arrow(packed, kernel, schema)


def votes() -> list:
    """One column per rule: 1 good, -1 bad, 0 abstains. All are ratios, so length does not matter."""
    n, chars = F.col("m.n_words"), F.col("m.word_chars")
    return [
        F.when(F.col("m.n_repeat_words") * 100 > n * 20, -1).when(F.col("m.n_repeat_words") * 100 <= n * 5, 1).otherwise(0),
        F.when(F.col("m.n_symbols") * 100 > chars * 8, -1).when(F.col("m.n_symbols") * 100 <= chars * 2, 1).otherwise(0),
        F.when(F.col("m.n_dup_lines") * 100 > F.col("m.n_lines") * 30, -1).when((F.col("m.n_lines") > 1) & (F.col("m.n_dup_lines") * 10 <= F.col("m.n_lines")), 1).otherwise(0),
        F.when((chars > n * 20) | (chars < n * 2), -1).when((chars >= n * 3) & (chars <= n * 12), 1).otherwise(0),
        F.when(F.col("m.n_symbol_words") * 100 > n * 25, -1).when(F.col("m.n_symbol_words") * 100 <= n * 10, 1).otherwise(0),
        F.when(n < 10, -1).when(n >= 20, 1).otherwise(0),
    ]


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """EM for a mixture of good and bad documents with independent rules.

    patterns: one row of votes per distinct pattern; counts: documents that show it. Returns the
    share of good documents and, for each rule, P(vote | good) and P(vote | bad) over (-1, 0, 1).
    Each likelihood gets a pseudo-count that leans to the meaning of the vote, which keeps the two
    classes from swapping; the start is the plain majority of the votes."""
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    score = patterns.sum(axis=1)
    good = np.clip(0.5 + 0.4 * np.sign(score), 0.1, 0.9)
    lean = {True: np.array([0.1, 1.0, 2.0]), False: np.array([2.0, 1.0, 0.1])}
    prior, tables = 0.5, (np.zeros((patterns.shape[1], 3)),) * 2
    for _ in range(rounds):
        tables = []
        for right, weight in ((True, good), (False, 1 - good)):
            t = np.einsum("p,prv->rv", counts * weight, onehot) + lean[right]
            tables.append(t / t.sum(axis=1, keepdims=True))
        prior = float(((counts * good).sum() + 1) / (counts.sum() + 2))
        logs = [np.einsum("prv,rv->p", onehot, np.log(t)) for t in tables]
        odds = np.clip(np.log(prior / (1 - prior)) + logs[0] - logs[1], -700, 700)
        new = 1 / (1 + np.exp(-odds))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return prior, tables[0], tables[1]


def judge(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: `row` (a struct of the columns in carry, all by default), `m` (the
    measures), `p_good` (posterior), `base_failed` and `kept`. The vote counts need the measures before
    the verdicts do: they are stored once, but where the text is to be carried along, texts are
    measured again rather than stored."""
    carry = carry or docs.columns
    vote = F.array(*[v.cast("int") for v in votes()])
    if text_col in carry:
        measured = measure(docs, text_col, carry).withColumn("votes", vote)
        seen = measure(docs, text_col, []).groupBy(vote.alias("votes")).count().collect()  # at most 3**6 patterns
    else:
        measured = Scratch(docs.sparkSession, "quality").save(measure(docs, text_col, carry), "measured").withColumn("votes", vote)
        seen = measured.groupBy("votes").count().collect()  # at most 3**6 patterns
    seen.sort(key=lambda r: list(r[0]))  # sums of doubles depend on the order
    prior, good, bad = 0.5, np.full((len(RULES), 3), 1 / 3), np.full((len(RULES), 3), 1 / 3)
    if seen:
        prior, good, bad = fit(np.array([list(r[0]) for r in seen]), np.array([r[1] for r in seen], float))
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for k in range(len(RULES)):
        table = np.log(good[k]) - np.log(bad[k])
        odds = odds + F.element_at(F.array(*[F.lit(float(x)) for x in table]), F.col("votes")[k] + 2)
    n = F.col("m.n_words")
    out = measured.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("base_failed", (n < 10) | (F.col("m.n_repeat_words") * 100 > n * 20))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)).drop("votes")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(load(spark, sf_dir, "documents"), carry=["doc_id"])
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("row.doc_id", *[f"m.{c}" for c in cols], "base_failed", "kept", "p_good")
