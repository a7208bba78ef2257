"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

Sets are the distinct n-word shingles of lower-cased texts (64-bit hashes). Equal sets are merged
first (by size and two independent 64-bit sums); what follows works on one node per distinct set.

Light part. Two sets of sizes a <= b link iff they share a subset of c(a, b) = ceil(t(a+b)/(1+t))
elements. While sets are small that is all of a set or all but one or two elements, so every set
emits its c-subsets for each pair of sizes: equal keys (128 bits) prove a link.

Heavy part. The elements of all sets have one order, rarest first, and a set of s elements enters the
inverted lists of its first s - ceil(ts) + 1: linked sets share one of these. Rarity comes from one
aggregate over all documents, a table of counters that shingles are hashed to; where counters are
shared the order is less sharp, never wrong, as any order that all sets obey gives whole results. Elements of
passages that many documents share come last, so lists hold near copies and a few strangers.

Scanning. First every set of a list is tested against the list's hub, the set with the fewest rarer
elements; the links found join near copies to components. Then lists that still hold sets of
different components are scanned, in pairs of chunks of bounded size: of two sets of different
components whose sizes, places in the list and sketches allow a link, the TOP best of each pair of
components are verified, and if one of the rest may still matter, the scan is repeated with more. A
sketch holds the parities of a set's elements hashed to bits: two sketches differ in at most as many
bits as the sets differ in elements. Every link between components is therefore found, while links
inside one are not looked for. Nothing is grouped transitively before it is verified.

The boundary between the parts is the size at which the expected cost, from the histogram of set
sizes over all documents, is least.

Defined results: null and empty texts have an empty set and link with nothing; fewer words than n are
one shingle; null ids form no component with others (component_id null unless an equal or linked
set has an id); repeated rows each give a row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import Scratch, Words, arrow, load, mix, ranges, release, row_key, signed, tune, whole, windows
from inkveil.llm.components import components

#: Cost of one entry in an inverted list, with its share of verification, in subset keys.
LIST_COST = 6
#: Largest size that the light part may take.
LIGHT_MAX = 24
#: Counters of the rarity table (its size is fixed: one byte each goes to every worker), and their chunks.
COUNTERS, COUNTER_CHUNK = 1 << 21, 1 << 15
#: Nodes of a list in one chunk, entries of small lists in one task, pairs of components' candidates at first.
CHUNK_NODES, TASK_ENTRIES, TOP = 1024, 4000, 8
#: Least bits of a sketch.
SKETCH_BITS = 1024
#: Ranks of hubs above this are taken as equal.
HUB_RANKS = 8191


class Threshold:
    """Jaccard similarity >= num / den, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a, b):
        """Least overlap of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def largest(self, a: int) -> int:
        return a * self.den // self.num

    def smallest(self, b):
        return -(-b * self.num // self.den)

    def prefix(self, s):
        """Elements of a set of size s that go into lists."""
        return s - self.smallest(s) + 1

    def partners(self, s: int, x: int) -> list[tuple[int, int, int]]:
        """(a, b, c) of the size pairs that s takes part in and whose smaller size is x at most."""
        pairs = [(min(s, o), max(s, o)) for o in range(self.smallest(s), self.largest(s) + 1)]
        found = [(a, b, self.overlap(a, b)) for a, b in pairs if a <= x]
        return [(a, b, c) for a, b, c in found if c <= a]


def boundary(sizes: dict[int, int], t: Threshold) -> int:
    """The light part's largest size, by cost. sizes: number of sets of each size up to LIGHT_MAX * 2."""

    def cost(x: int) -> float:
        total = 0.0
        for s, n in sizes.items():
            total += n * sum(comb(s, c) for _, _, c in t.partners(s, x))
            total += n * LIST_COST * t.prefix(s) * (s > x)
        return total

    return min(range(LIGHT_MAX + 1), key=cost)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and their offsets."""
    w = Words.of(texts, lower=True)
    h, counts, doc = w.hashes(), w.counts(), w.doc()
    grams = windows(h, n)
    pos = np.arange(len(grams))
    inside = pos + n <= w.first[doc[: len(grams)] + 1]
    d1, g1 = doc[: len(grams)][inside], grams[inside]
    # A short text is one shingle: its words in order, told apart from long ones by their number.
    d2, g2 = np.flatnonzero((counts > 0) & (counts < n)), []
    for i in d2:
        v = np.uint64(counts[i])
        for x in h[w.first[i] : w.first[i + 1]]:
            v = mix(np.array([v * np.uint64(0x9E3779B97F4A7C15) + x]))[0]
        g2.append(v)
    doc, gram = np.concatenate([d1, d2]), np.concatenate([g1, np.array(g2, np.uint64)])
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    doc, gram = doc[new], gram[new]
    return gram, np.searchsorted(doc, np.arange(w.n_docs + 1))


def sketches(gram: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """Of each set the parities of its elements hashed to bits; about half a bit an element, SKETCH_BITS at least."""
    sizes = np.diff(offs)
    bits = np.maximum(SKETCH_BITS, 1 << np.floor(np.log2(np.maximum(sizes, 2) / 2)).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(bits)])
    at = (mix(gram ^ np.uint64(0xA4093822299F31D0)) & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at + np.repeat(first[:-1], sizes), minlength=first[-1]) & 1
    raw = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [raw[a // 8 : b // 8] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _sets(n: int):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            gram, offs = shingle_sets(batch.column("text"), n)
            sums = []
            for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                total = np.zeros(len(gram) + 1, np.uint64)
                np.cumsum(mix(gram ^ np.uint64(salt)), out=total[1:])
                sums.append(pa.array(signed(total[offs[1:]] - total[offs[:-1]])))
            made = pa.array(sketches(gram, offs), pa.binary())
        return pa.record_batch([batch.column("doc_id"), batch.column("r1"), batch.column("r2"), pa.array(np.diff(offs)), *sums, made], names=["doc_id", "r1", "r2", "n", "s1", "s2", "sketch"])

    return kernel


def counter(gram: np.ndarray) -> np.ndarray:
    return (mix(gram ^ np.uint64(0x082EFA98EC4E6C89)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _count(n: int):
    """The counters of one task, in chunks of those that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            with np.errstate(over="ignore"):
                gram, _ = shingle_sets(batch.column("text"), n)
                total += np.bincount(counter(gram), minlength=COUNTERS).astype(np.uint32)
        part = TaskContext.get().partitionId()
        for k in range(0, COUNTERS, COUNTER_CHUNK):
            piece = total[k : k + COUNTER_CHUNK]
            if piece.any():
                yield pa.record_batch([pa.array([k // COUNTER_CHUNK], pa.int32()), pa.array([part], pa.int32()), pa.array([piece.astype("<u8").tobytes()])], names=["chunk", "part", "counts"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for chunk, part, raw in zip(*(batch.column(c).to_pylist() for c in ("chunk", "part", "counts")), strict=True):
            v = np.frombuffer(raw, "<u8")
            total[chunk, part] = total[chunk, part] + v if (chunk, part) in total else v
    for (chunk, part), v in total.items():
        yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([part], pa.int32()), pa.array([v.tobytes()])], names=["chunk", "part", "counts"])


def rarity(base: DataFrame, n: int, scratch: Scratch) -> np.ndarray:
    """A level for each counter, by how far it is above the median one: one byte each, COUNTERS in all.

    Tasks add up their counters, then groups of 64 tasks, then all: no task adds more than a part of them."""
    kind = "chunk int, part int, counts binary"
    counts = scratch.save(base.select("text").mapInArrow(_count(n), kind), "counters")
    step = counts.withColumn("part", F.pmod("part", F.lit(64))).repartition("chunk", "part").mapInArrow(_add, kind)
    step = step.withColumn("part", F.lit(0)).repartition("chunk").mapInArrow(_add, kind)
    total = np.zeros(COUNTERS, np.uint64)
    for r in step.select("chunk", "counts").collect():  # COUNTERS numbers in all
        total[r.chunk * COUNTER_CHUNK : (r.chunk + 1) * COUNTER_CHUNK] = np.frombuffer(r.counts, "<u8")
    over = np.maximum(total.astype(np.float64) - np.median(total), 0)
    return np.minimum(np.floor(8 * np.log2(1 + over)), 255).astype(np.uint8)


KEYS = "key long, key2 long, node long, size int, pos int, light int"


def _keys(t: Threshold, n: int, x: int, levels):
    """Keys of both parts for each node: `light` is 0 for lists, else twice the set's size,
    plus one where the key stands for two sets of equal size."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        with np.errstate(over="ignore"):
            gram, offs = shingle_sets(batch.column("text"), n)
            node, sizes = batch.column("node").to_numpy(), np.diff(offs)
            out: list[tuple] = []
            own = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((gram, levels.value[counter(gram)], own))
            pos = np.arange(len(gram)) - np.repeat(offs[:-1], sizes)
            take = (pos < t.prefix(sizes)[own]) & (sizes > x)[own]
            who = own[take]
            out.append((gram[order[take]], np.zeros(len(who), np.uint64), node[who], sizes[who], pos[take], np.zeros(len(who), np.int64)))
            for i in np.flatnonzero((sizes > 0) & (sizes <= t.largest(x))):
                s = int(sizes[i])
                mixed = [mix(gram[offs[i] : offs[i + 1]] ^ np.uint64(salt)) for salt in (0, 0x452821E638D01377)]
                for a, b, c in t.partners(s, x):
                    drop = list(combinations(range(s), s - c))
                    tag = np.uint64((a << 32) + b) * np.uint64(0x9E3779B97F4A7C15)
                    keys = [mix(m.sum() - np.array([sum(int(m[k]) for k in d) & 0xFFFFFFFFFFFFFFFF for d in drop], np.uint64) + tag) for m in mixed]
                    k = len(drop)
                    out.append((*keys, np.full(k, node[i]), np.full(k, s), np.zeros(k, np.int64), np.full(k, 2 * s + (a == b))))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        arrays = [pa.array(signed(c)) for c in columns[:2]] + [pa.array(columns[2])] + [pa.array(c.astype(np.int32)) for c in columns[3:]]
        return pa.record_batch(arrays, names=["key", "key2", "node", "size", "pos", "light"])

    return kernel


def _items(n: int):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            gram, offs = shingle_sets(batch.column("text"), n)
        items = [gram[offs[i] : offs[i + 1]].tobytes() for i in range(batch.num_rows)]
        return pa.record_batch([batch.column("node"), pa.array(items, pa.binary())], names=["node", "items"])

    return kernel


class Sketches:
    """Sketches of one batch, by their width."""

    def __init__(self, raw: list[bytes]):
        widths = np.array([len(x) for x in raw])
        self.width, self.row, self.of = widths, np.zeros(len(raw), np.int64), {}
        for w in np.unique(widths):
            at = np.flatnonzero(widths == w)
            self.row[at] = np.arange(len(at))
            self.of[int(w)] = np.frombuffer(b"".join(raw[i] for i in at), np.uint64).reshape(len(at), -1)


def apart(a: Sketches, i: np.ndarray, b: Sketches, j: np.ndarray) -> np.ndarray:
    """Bits in which sketches i of a and j of b differ; wider ones are folded."""
    out = np.zeros(len(i), np.int64)
    for wa in np.unique(a.width[i]):
        for wb in np.unique(b.width[j]):
            at = np.flatnonzero((a.width[i] == wa) & (b.width[j] == wb))
            x, y = a.of[int(wa)], b.of[int(wb)]
            while x.shape[1] != y.shape[1]:
                x, y = (_fold(x), y) if x.shape[1] > y.shape[1] else (x, _fold(y))
            for k in range(0, len(at), 1 << 16):
                p = at[k : k + (1 << 16)]
                out[p] = np.bitwise_count(x[a.row[i[p]]] ^ y[b.row[j[p]]]).sum(axis=1)
    return out


def _fold(x: np.ndarray) -> np.ndarray:
    half = x.shape[1] // 2
    return x[:, :half] ^ x[:, half:]


def _near(t: Threshold):
    """Of pairs with both sketches, those that may be linked."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [batch.column(c).to_numpy().astype(np.int64) for c in ("a_size", "b_size")]
        own = [Sketches(batch.column(c).to_pylist()) for c in ("a_sketch", "b_sketch")]
        at = np.arange(batch.num_rows)
        least = t.overlap(*sizes)
        ok = (least <= np.minimum(*sizes)) & (apart(own[0], at, own[1], at) <= sizes[0] + sizes[1] - 2 * least)
        return pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return kernel


def _linked(t: Threshold):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for a, b in zip(batch.column("a_items"), batch.column("b_items"), strict=True):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            ok.append(t.den * shared >= t.num * (len(a) + len(b) - shared))
        return pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return kernel


CANDIDATES = "a long, b long, a_label long, b_label long, more boolean"


def _scan(t: Threshold, top: int):
    """Candidates between components in the lists of one task: left sets against right ones, the best `top` of each two components."""

    def kernel(group: pa.Table) -> pa.Table:
        columns = {c: group.column(c).to_numpy() for c in ("key", "node", "label", "size", "pos", "left", "right")}
        own = Sketches(group.column("sketch").to_pylist())
        left, right = (np.flatnonzero(columns[c]) for c in ("left", "right"))
        right = right[np.argsort(columns["key"][right], kind="stable")]
        lo, hi = (np.searchsorted(columns["key"][right], columns["key"][left], side) for side in ("left", "right"))
        kept = []
        size, pos, label, node = (columns[c].astype(np.int64) for c in ("size", "pos", "label", "node"))
        ends = np.cumsum(hi - lo)
        a = 0
        while a < len(left):  # rows whose pairs are about a million
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 20), "right")))
            i, j = np.repeat(left[a:b], hi[a:b] - lo[a:b]), right[ranges(lo[a:b], hi[a:b] - lo[a:b])]
            a = b
            ok = (label[i] != label[j]) & (node[i] != node[j])
            i, j = i[ok], j[ok]
            least = t.overlap(size[i], size[j])
            ok = np.minimum(size[i] - pos[i], size[j] - pos[j]) >= least
            i, j, least = i[ok], j[ok], least[ok]
            slack = size[i] + size[j] - 2 * least - apart(own, i, own, j)
            ok = slack >= 0
            kept.append((i[ok], j[ok], slack[ok]))
        i, j, slack = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (np.empty(0, np.int64),) * 3
        low = node[i] < node[j]
        i, j = np.where(low, i, j), np.where(low, j, i)
        one, two = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        order = np.lexsort((node[j], node[i], -slack, two, one))
        i, j, one, two = i[order], j[order], one[order], two[order]
        new = np.ones(len(i), bool)
        new[1:] = (node[i][1:] != node[i][:-1]) | (node[j][1:] != node[j][:-1])
        i, j, one, two = i[new], j[new], one[new], two[new]
        start = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))[: len(i)] if len(i) else np.empty(0, np.int64)
        n = np.diff(np.append(start, len(i)))
        rank, many = np.arange(len(i)) - np.repeat(start, n), np.repeat(n > top, n)
        take = rank < top
        return pa.table({"a": node[i][take], "b": node[j][take], "a_label": label[i][take], "b_label": label[j][take], "more": many[take]})

    return kernel


def tasks(lists: DataFrame) -> DataFrame:
    """Entries (key, node, label, size, pos) with the tasks (task, i, j) in which they are left or right.

    Small lists share tasks; a large list's nodes are dealt into chunks, and each two chunks meet in one task."""
    sizes = lists.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("one"), F.max("label").alias("two")).where("one <> two").select("key", "n")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    lists = lists.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / CHUNK_NODES).cast("int"))
    small = lists.where("chunks = 1").select("key", "node", "label", "size", "pos", F.pmod(F.xxhash64("key"), F.lit(1 + total // TASK_ENTRIES)).alias("task"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("left"), F.lit(True).alias("right"))
    large = lists.where("chunks > 1").withColumn("c", F.pmod(F.xxhash64("node", "key"), F.col("chunks")).cast("int"))
    large = large.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    large = large.select("key", "node", "label", "size", "pos", F.col("key").alias("task"), (F.least("c", "o") + 1).alias("i"), (F.greatest("c", "o") + 1).alias("j"), (F.col("c") <= F.col("o")).alias("left"), (F.col("c") >= F.col("o")).alias("right"))
    return small.union(large)


def jaccard_components(docs: DataFrame, num: int = 90, den: int = 100, n: int = 3, id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """doc_id, n_shingles, component_id, group, r1, r2 for every row of docs: component_id is the least id
    reachable over links of Jaccard similarity >= num / den between sets of n-word shingles; (r1, r2) names
    the row's id and text (common.row_key)."""
    spark = docs.sparkSession
    tune(spark)
    t, scratch = Threshold(num, den), Scratch(spark, "jaccard")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    base = base.select("doc_id", *row_key("doc_id", "text"), "text")
    sets = scratch.save(arrow(base, _sets(n), "doc_id long, r1 long, r2 long, n long, s1 long, s2 long, sketch binary"), "sets")
    # One row of each set gives its text: the one with the least r1, then the least r2.
    nodes = sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("least"), F.min("r1").alias("r1"))
    nodes = nodes.join(sets.groupBy("n", "s1", "s2", "r1").agg(F.min("r2").alias("r2")), ["n", "s1", "s2", "r1"])
    nodes = scratch.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    small = {r.n: r["count"] for r in nodes.where(F.col("n") <= 2 * LIGHT_MAX).groupBy("n").count().collect()}
    x = boundary(small, t)
    levels = spark.sparkContext.broadcast(rarity(base, n, scratch))

    def texts(of: DataFrame) -> DataFrame:
        """(node, text), one row for each of the nodes; repeated rows are merged before the shuffle."""
        once = base.groupBy("r1", "r2").agg(F.first("text").alias("text"))
        return once.join(of.select("r1", "r2", "node"), ["r1", "r2"]).select("node", "text")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that are linked; only the sets that stand in a pair are read."""
        pairs = scratch.save(pairs.distinct(), f"{name}-pairs")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "r1", "r2"), "node")
        items = scratch.save(arrow(texts(wanted), _items(n), "node long, items binary"), f"{name}-items")
        met = pairs.join(items.select(F.col("node").alias("a"), F.col("items").alias("a_items")), "a")
        met = met.join(items.select(F.col("node").alias("b"), F.col("items").alias("b_items")), "b")
        out = scratch.save(arrow(met.select("a", "b", "a_items", "b_items"), _linked(t), "a long, b long"), name)
        scratch.drop(f"{name}-items")
        return out

    keys = scratch.save(arrow(texts(nodes), _keys(t, n, x, levels), KEYS), "keys")
    # Light keys: all sets of a key are linked with its least node, or those of either size with each other.
    light = keys.where("light > 0")
    proven = light.groupBy("key", "key2").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.min("light").alias("small"), F.max("light").alias("large"))
    proven = proven.where("first < last AND (small % 2 = 1 OR small < large)").select("key", "key2", "first")
    proven = scratch.save(light.join(proven, ["key", "key2"]).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")), "proven")
    # Lists: the hub is the node with the fewest rarer elements; rank and node are packed in one number.
    rank = F.least("pos", F.lit(HUB_RANKS)).cast("long")
    lists = keys.where("light = 0")
    shared = lists.groupBy("key").agg(F.min(F.shiftleft(rank, 50).bitwiseOR(F.col("node"))).alias("hub"), F.count("*").alias("n")).where("n > 1")
    shared = shared.select("key", F.col("hub").bitwiseAND(F.lit((1 << 50) - 1)).alias("hub"))
    lists = scratch.save(lists.join(shared, "key").select("key", "node", "size", "pos", "hub"), "lists")
    for done in ("counters", "keys"):
        scratch.drop(done)
    release(spark)

    drawn = lists.select("node", "size").distinct().join(nodes.select("node", "r1", "r2"), "node")
    drawn = drawn.join(sets.select("r1", "r2", "sketch").dropDuplicates(["r1", "r2"]), ["r1", "r2"]).select("node", "size", "sketch")
    drawn = scratch.save(drawn, "sketches")
    stars = lists.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    stars = stars.join(drawn.select(F.col("node").alias("a"), F.col("sketch").alias("a_sketch"), F.col("size").alias("a_size")), "a")
    stars = stars.join(drawn.select(F.col("node").alias("b"), F.col("sketch").alias("b_sketch"), F.col("size").alias("b_size")), "b")
    near = arrow(stars.select("a", "b", "a_size", "b_size", "a_sketch", "b_sketch"), _near(t), "a long, b long")
    links = scratch.save(linked(near, "stars").union(proven), "links-0")

    turn = 0
    while True:
        labels = components(links, scratch, f"components-{turn}")
        named = lists.select("key", "node", "size", "pos").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        dealt = tasks(scratch.save(named, f"named-{turn}")).join(drawn.select("node", "sketch"), "node")
        found = scratch.save(dealt.groupBy("task", "i", "j").applyInArrow(_scan(t, top), CANDIDATES), f"found-{turn}")
        # The candidates of two components may come from many lists: a few of them will do, unless they fail.
        new = linked(found.select("a", "b"), f"new-{turn}")
        scratch.drop(f"named-{turn}")
        turn += 1
        if not new.limit(1).count():
            if not found.where("more").limit(1).count():
                break
            top *= 16
            continue
        links = scratch.save(links.union(new), f"links-{turn}")
        if not found.where("more").limit(1).count():
            labels = components(links, scratch, f"components-{turn}")
            break
        top *= 4
    for done in ("lists", "sketches"):
        scratch.drop(done)
    return _rows(sets, nodes, labels, scratch)


def _rows(sets: DataFrame, nodes: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Least ids per component, then back to the sets and to the rows."""
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = scratch.save(named.select("n", "s1", "s2", "label", "least"), "labelled")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = scratch.save(named.join(least, "label").select("n", "s1", "s2", "component_id", F.col("label").alias("group")), "least")
    release(sets.sparkSession)
    out = sets.where("n > 0").join(named, ["n", "s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "group", "r1", "r2")
    empty = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"), "r1", "r2")
    return out.union(empty)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
