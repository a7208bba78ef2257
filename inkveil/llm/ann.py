"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Equal vectors become one node, so copies do not crowd a graph. A first, poor graph comes from STARTS
random cuts of the space: nodes on the same side of some hyperplanes are dealt by hash into cells of
about CELL nodes and compared there, a small and falling share of all pairs.

Then NN-descent: in each round a node's neighbours and reverse neighbours (up to REVERSE of these, new
ones first) meet at the node with their vectors; of any two that meet, of which one is new to the node,
each learns of the other, up to LEARN a meeting, and of all it learns a node keeps the best DEGREE.
Nodes around which no edge is new are left out. Rounds go on until at most SETTLED of all edges are
new. All work is joins on node ids, with rows dealt to tasks by hash of the node; a node's meeting is
bounded by DEGREE + REVERSE vectors. Vectors travel in half precision, less their common centre c: with
h = v - c, the products v_i . h_j rank the neighbours of i as v_i . v_j do.

Queries start at their own node's neighbours and at ENTRIES nodes drawn by hash, and open all unopened nodes of
their beam, round by round, until none is left. Scores are recomputed on the original vectors in double
precision.

The graph is the approximate part of the method, and its recall is measured against brute force in the
tests. Copies of a vector stand behind their node with their least ids, as many as a result can hold.

Vectors of different dimensions have no inner product: each dimension has its own cells, edges, entries and end of
rounds, all worked on in the same jobs. What the driver holds is one centre a dimension.

Defined results: vectors that are null, all zero, or hold null or non-finite components take no part;
a vector is near to those of its own dimension only; fewer candidates than k give all of them; ties go to the smaller id; null ids take no part; rows that
repeat an id count once; other columns are ignored; an empty table gives an empty result. Made for
vectors of like length: with lengths that differ much, short vectors may be found less often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.llm.common import Scratch, load

#: Neighbours of a node, reverse ones at a meeting, pairs that a node learns there, and the share of new edges at which rounds end.
DEGREE, REVERSE, LEARN, SETTLED = 50, 40, 8, 0.001
#: Cuts, nodes of a cell, nodes whose meetings are one task's group, and meetings whose news are packed together.
STARTS, CELL, GROUP, PACKED = 2, 64, 2000, 32
ENTRIES = 8


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an array<float> column, all of one dimension."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def halves(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a binary column of half-precision vectors."""
    raw = b"".join(col.to_pylist())
    return np.frombuffer(raw, np.float16).reshape(len(col), -1).astype(np.float32)


def of_widths(widths: np.ndarray) -> Iterator[tuple[int, pa.Array]]:
    """Each different width, with the rows that have it."""
    for d in np.unique(widths).tolist():
        yield d, pa.array(np.flatnonzero(widths == d))


FOUND = "dim int, node long, ids binary, sims binary, fresh binary"


def packed(dim: int, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, fresh: np.ndarray) -> pa.Table:
    """One row for each run of equal nodes of one dimension, with its ids (int64), sims (float32) and flags."""
    cut = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))[: len(nodes)] if len(nodes) else np.empty(0, np.int64)
    ends = np.append(cut[1:], len(nodes)) if len(cut) else cut
    columns = []
    for values, kind in ((ids, np.int64), (sims, np.float32), (fresh, np.uint8)):
        raw, width = values.astype(kind).tobytes(), np.dtype(kind).itemsize
        columns.append(pa.array([raw[a * width : b * width] for a, b in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary()))
    return pa.table([pa.array(np.full(len(cut), dim), pa.int32()), pa.array(nodes[cut], pa.int64()), *columns], names=["dim", "node", "ids", "sims", "fresh"])


def unpacked(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """nodes, ids, sims and flags of rows of FOUND, one element for each id."""
    ids, sims, fresh = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("ids", np.int64), ("sims", np.float32), ("fresh", np.uint8)))
    n = np.array([len(x) // 8 for x in rows.column("ids").to_pylist()], np.int64)
    return np.repeat(rows.column("node").to_numpy(), n), ids, sims, fresh


def _cell(degree: int, centres: dict[int, np.ndarray]):
    """All pairs of a cell, the best `degree` of each node."""

    def kernel(group: pa.Table) -> pa.Table:
        nodes, v = group.column("node").to_numpy(), halves(group.column("half"))
        dim = v.shape[1]
        sims = (v + centres[dim]) @ v.T
        np.fill_diagonal(sims, -np.inf)
        k = min(degree, len(nodes) - 1)
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else np.empty((len(nodes), 0), np.int64)
        return packed(dim, np.repeat(nodes, k), nodes[at].ravel(), np.take_along_axis(sims, at, 1).ravel(), np.ones(at.size))

    return kernel


def _merge(degree: int):
    """The best `degree` of all that a group of nodes of one dimension has and has learnt. Ids that were there keep their flag, 0; learnt ones are new."""

    def kernel(group: pa.Table) -> pa.Table:
        node, ids, sims, fresh = unpacked(group)
        order = np.lexsort((fresh, ids, node))
        node, ids, sims, fresh = node[order], ids[order], sims[order], fresh[order]
        once = np.ones(len(node), bool)
        once[1:] = (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])
        node, ids, sims, fresh = node[once], ids[once], sims[once], fresh[once]
        order = np.lexsort((ids, -sims, node))
        node, ids, sims, fresh = node[order], ids[order], sims[order], fresh[order]
        rank = np.arange(len(node)) - np.searchsorted(node, node)
        keep = rank < degree
        return packed(group.column("dim")[0].as_py(), node[keep], ids[keep], sims[keep], fresh[keep])

    return kernel


def _meet(learn: int, centres: dict[int, np.ndarray]):
    """Of the nodes that meet at a node each learns of the best others, where one of the two is new there."""

    def kernel(group: pa.Table) -> pa.Table:
        at, member = group.column("node").to_numpy(), group.column("member").to_numpy()
        fresh, least, v = group.column("fresh").to_numpy().astype(bool), group.column("least").to_numpy(), halves(group.column("half"))
        dim, centre = v.shape[1], centres[v.shape[1]]
        order = np.lexsort((~fresh, member, at))
        once = np.ones(len(order), bool)
        once[1:] = (at[order][1:] != at[order][:-1]) | (member[order][1:] != member[order][:-1])
        order = order[once]
        ends = np.flatnonzero(np.append(at[order][1:] != at[order][:-1], True)) + 1
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        news, start = [], 0

        def pack() -> None:
            # What a node learns at a few meetings is one row. Rows grow with the meetings, whatever a group holds.
            if out:
                node, ids, sims = (np.concatenate(c) for c in zip(*out, strict=True))
                order = np.lexsort((ids, node))
                news.append(packed(dim, node[order], ids[order], sims[order], np.ones(len(order))))
                out.clear()

        for k, end in enumerate(ends.tolist()):
            rows, start = order[start:end], end
            new = fresh[rows]
            if len(rows) >= 2 and new.any():
                sims = (v[rows] + centre) @ v[rows].T
                sims[~(new[:, None] | new[None, :])] = -np.inf
                np.fill_diagonal(sims, -np.inf)
                sims[sims <= least[rows][:, None]] = -np.inf
                best = min(learn, len(rows) - 1)
                to = np.argpartition(-sims, best - 1, axis=1)[:, :best]
                s = np.take_along_axis(sims, to, 1)
                i, j = np.nonzero(s > -np.inf)
                out.append((member[rows[i]], member[rows[to[i, j]]], s[i, j]))
            if k % PACKED == PACKED - 1:
                pack()
        pack()
        return pa.concat_tables(news) if news else packed(dim, *(np.empty(0, np.int64),) * 4)

    return kernel


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        vec = batch.column("vec")
        for d, rows in of_widths(pc.list_value_length(vec).to_numpy()):
            total[d] = total.get(d, 0.0) + matrix(vec.take(rows)).sum(axis=0, dtype=np.float64)
    for d, sums in total.items():
        yield pa.record_batch([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(sums)], names=["dim", "at", "total"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            node, ids, _, fresh = unpacked(batch)
            yield pa.record_batch([pa.array(node), pa.array(ids), pa.array(fresh.astype(bool))], names=["node", "to", "fresh"])


def _least(degree: int):
    """Of each list the least similarity that still improves it, and how many of its edges are new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sims = [np.frombuffer(x, np.float32) for x in batch.column("sims").to_pylist()]
                fresh = [sum(x) for x in batch.column("fresh").to_pylist()]
                least = [float(s.min()) if len(s) >= degree else float("-inf") for s in sims]
                yield pa.record_batch([batch.column("dim"), batch.column("node"), pa.array(least, pa.float32()), pa.array(fresh, pa.int64())], names=["dim", "node", "least", "n_fresh"])

    return run


def start_graph(nodes: DataFrame, counts: dict[int, int], degree: int, centres: dict[int, np.ndarray], starts: int = STARTS, cell: int = CELL) -> DataFrame:
    """Rows of FOUND from random cuts. nodes: (dim, node, half); counts: nodes of each dimension. Sides of hyperplanes, as many as
    leave a cell's nodes on one side of all if nodes lie evenly, name a region; a region with more is dealt into cells by hash."""
    planes = {d: max(0, int(np.ceil(np.log2(max(1, n / cell))))) for d, n in counts.items()}

    def sides(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, rows in of_widths(batch.column("dim").to_numpy()):
                    part = batch.take(rows)
                    v = halves(part.column("half"))
                    cuts = np.random.default_rng(977 + turn).normal(size=(d, planes[d]))
                    region = ((v @ cuts > 0) @ (1 << np.arange(planes[d], dtype=np.int64))).astype(np.int64)
                    yield pa.record_batch([part.column("dim"), pa.array(region), part.column("node"), part.column("half")], names=["dim", "region", "node", "half"])

        return run

    lists = None
    for turn in range(starts):
        dealt = nodes.mapInArrow(sides(turn), "dim int, region long, node long, half binary")
        sizes = dealt.groupBy("dim", "region").agg(F.count("*").alias("n"))
        dealt = dealt.join(sizes, ["dim", "region"]).withColumn("cell", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("n") / (2 * cell))))
        found = dealt.groupBy("dim", "region", "cell").applyInArrow(_cell(degree, centres), FOUND)
        lists = found if lists is None else lists.union(found)
    return lists


def build_graph(nodes: DataFrame, scratch: Scratch, degree: int = DEGREE, settled: float = SETTLED, rounds: int | None = None) -> DataFrame:
    """Rows of FOUND: about the `degree` nearest nodes of each node. nodes: (node, vec). rounds: the most that are made, if given."""
    peaks = nodes.groupBy(F.size("vec").alias("dim")).agg(F.max(F.array_max(F.transform("vec", F.abs))).alias("m"), F.count("*").alias("n")).collect()
    counts, scales = {r.dim: r.n for r in peaks}, {r.dim: r.m or 1.0 for r in peaks}
    n = sum(counts.values())
    means: dict[int, list[float]] = {d: [] for d in counts}
    for r in nodes.select("vec").mapInArrow(_sums, "dim int, at int, total double").groupBy("dim", "at").agg(F.sum("total").alias("total")).orderBy("dim", "at").collect():
        means[r.dim].append(r.total / counts[r.dim] / scales[r.dim])
    centres = {d: np.array(m, np.float32) for d, m in means.items()}

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows in of_widths(pc.list_value_length(batch.column("vec")).to_numpy()):
                part = batch.take(rows)
                raw, width = (matrix(part.column("vec")) / scales[d] - centres[d]).astype(np.float16).tobytes(), 2 * d
                yield pa.record_batch([pa.array(np.full(len(rows), d, np.int32)), part.column("node"), pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())], names=["dim", "node", "half"])

    half = scratch.save(nodes.mapInArrow(shrink, "dim int, node long, half binary"), "halves")
    groups = F.pmod(F.xxhash64("node"), F.lit(1 + n // GROUP)).alias("group")
    graph = start_graph(half, counts, degree, centres).groupBy("dim", groups).applyInArrow(_merge(degree), FOUND)
    graph = scratch.save(graph, "graph-0")
    k = 0
    while True:
        known = scratch.save(graph.select("dim", "node", "sims", "fresh").mapInArrow(_least(degree), "dim int, node long, least float, n_fresh long"), f"known-{k}", tidy=False)
        fresh = known.groupBy("dim").agg(F.sum("n_fresh").alias("n")).collect()
        if all(r.n <= settled * counts[r.dim] * degree for r in fresh) or k == rounds:
            return graph
        k += 1
        edges = graph.mapInArrow(_edges, "node long, to long, fresh boolean")
        # Reverse neighbours: the window's rank limit is applied before the shuffle too, so no task meets all edges to a hub.
        draw = Window.partitionBy("node").orderBy(F.desc("fresh"), F.xxhash64("node", "member", F.lit(k)))
        back = edges.select(F.col("to").alias("node"), F.col("node").alias("member"), "fresh")
        back = back.withColumn("rank", F.row_number().over(draw)).where(F.col("rank") <= REVERSE).drop("rank")
        meets = edges.select("node", F.col("to").alias("member"), "fresh").union(back)
        active = meets.where("fresh").select("node").distinct()
        about = half.join(known.select("node", "least"), "node", "left").select(F.col("node").alias("member"), "dim", "half", F.coalesce("least", F.lit(float("-inf")).cast("float")).alias("least"))
        met = meets.join(active, "node", "left_semi").join(about, "member")
        learnt = met.groupBy("dim", groups).applyInArrow(_meet(LEARN, centres), FOUND)
        # Edges that were there have been met now: they are no longer new.
        old = graph.select("dim", "node", "ids", "sims", F.expr("unhex(repeat('00', cast(octet_length(ids) div 8 as int)))").alias("fresh"))
        nxt = scratch.save(learnt.union(old).groupBy("dim", groups).applyInArrow(_merge(degree), FOUND), f"graph-{k}")
        scratch.drop(f"graph-{k - 1}")
        graph = nxt


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, rows in of_widths(pc.list_value_length(batch.column("q")).to_numpy()):
            part = batch.take(rows)
            sims = np.einsum("ij,ij->i", matrix(part.column("q")).astype(np.float64), matrix(part.column("vec")).astype(np.float64))
            yield pa.record_batch([part.column("query"), part.column("cand"), pa.array(sims)], names=["query", "cand", "sim"])


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, scratch: Scratch, beam: int) -> DataFrame:
    """(query, cand, sim, done): the beam of each query (query, q, home) after the search; home may be null."""
    drawn = Window.partitionBy("dim").orderBy(F.xxhash64("node"), "node")
    doors = nodes.select(F.size("vec").alias("dim"), "node").withColumn("k", F.row_number().over(drawn)).where(F.col("k") <= ENTRIES)
    doors = scratch.save(doors.select("dim", F.col("node").alias("cand")), "doors")
    # ENTRIES rows for each dimension: small whatever the table.
    start = queries.select("query", F.size("q").alias("dim")).join(F.broadcast(doors), "dim").select("query", "cand")
    start = start.union(queries.where("home IS NOT NULL").select("query", "home"))
    start = start.union(queries.select("query", F.col("home").alias("node")).join(graph.select("node", "ids"), "node").transform(_targets))

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.join(nodes.select(F.col("node").alias("cand"), "vec"), "cand").join(queries.select("query", "q"), "query")
        return met.select("query", "cand", "q", "vec").mapInArrow(_score, "query long, cand long, sim double").withColumn("done", F.lit(False))

    def top(rows: DataFrame) -> DataFrame:
        best = Window.partitionBy("query").orderBy(F.desc("sim"), "cand")
        return rows.withColumn("k", F.row_number().over(best)).where(F.col("k") <= beam).select("query", "cand", "sim", "done")

    state = scratch.save(top(scored(start.distinct())), "beam-0")
    k = 0
    while state.where(~F.col("done")).limit(1).count():
        k += 1
        opened = state.where("NOT done").select("query", F.col("cand").alias("node"))
        reached = opened.join(graph.select("node", "ids"), "node").transform(_targets).distinct()
        fresh = reached.join(state.select("query", "cand"), ["query", "cand"], "left_anti")
        state = scratch.save(top(state.withColumn("done", F.lit(True)).union(scored(fresh))), f"beam-{k}")
        scratch.drop(f"beam-{k - 1}")
    return state


def _targets(rows: DataFrame) -> DataFrame:
    """(query, cand) for the packed ids of rows (query, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = batch.column("ids").to_pylist()
                n = np.array([len(x) // 8 for x in raw])
                yield pa.record_batch([pa.array(np.repeat(batch.column("query").to_numpy(), n)), pa.array(np.frombuffer(b"".join(raw), np.int64))], names=["query", "cand"])

    return rows.select("query", "ids").mapInArrow(run, "query long, cand long")


def nearest(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest other rows."""
    spark = table.sparkSession
    scratch = Scratch(spark, "ann")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("vec"))
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & good)
    # Copies: the least k + 1 ids of each vector, cut per scan partition first.
    local = rows.withColumn("part", F.spark_partition_id()).groupBy("vec", "part").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    classes = local.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = classes.select("node", "vec")
    graph = build_graph(nodes, scratch)
    wanted = rows.where(F.pmod("vec_id", F.lit(every)) == 0).join(nodes, "vec").select(F.col("vec_id").alias("query_id"), "node").distinct()
    wanted = scratch.save(wanted, "queries")
    # Queries with equal vectors are searched once, from their node.
    asked = wanted.select("node").distinct().join(nodes, "node").select(F.col("node").alias("query"), F.col("vec").alias("q"), F.col("node").alias("home"))
    asked = scratch.save(asked, "asked")
    state = search(asked, nodes, graph, scratch, beam=2 * k)
    pairs = state.select("query", "cand").union(asked.select("query", F.col("query").alias("cand"))).distinct()
    pairs = pairs.join(classes.select(F.col("node").alias("cand"), "ids", "vec"), "cand").join(asked.select("query", "q"), "query")
    dot = F.aggregate(F.zip_with("q", "vec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    pairs = pairs.select("query", "ids", dot.alias("score"))
    # Per query node the best k + 1 rows; then each query drops itself.
    ranked = pairs.select("query", "score", F.explode("ids").alias("vec_id")).groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1).alias("near"))
    out = wanted.join(ranked, wanted.node == ranked["query"])
    out = out.select("query_id", F.slice(F.filter("near", lambda e: e.vec_id != F.col("query_id")), 1, k).alias("near"))
    out = out.select("query_id", F.posexplode("near").alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"))
