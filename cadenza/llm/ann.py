"""Approximate nearest neighbours: an NN-descent graph by iterative Spark joins, greedy search on it.

Vectors that are equal fold into one node first, so a vector with a third of all rows is one node.
The graph starts from blocks: nodes in the order of a random sign code, cut into blocks of bounded
size, several times over; within a block all distances are computed. Each round then joins every
node with its neighbours and reverse neighbours, and the local join of a node proposes them to each
other: neighbours of neighbours, until a round changes few. A round costs nodes x members vectors of shuffle. Search keeps a
beam for each query, starts at the query's own node and expands its nearest unexpanded nodes by
joining with the graph and the vectors, until all of every beam is expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, stored

EDGE = "id long, other long, d double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal-sized vectors, in the type they have."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances; x (..., m, d), y (..., n, d)."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = (x * x).sum(-1)[..., :, None] + (y * y).sum(-1)[..., None, :] - 2 * (x @ np.swapaxes(y, -1, -2))
    return np.nan_to_num(np.maximum(d, 0), nan=np.inf, posinf=np.inf)


def usable_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v`` without null, zero, or non-finite vectors and null ids; floats stay floats, the rest is doubles."""
    v = F.col(f"`{vec_col}`")
    if table.select(v).schema[0].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(fine)


def start_graph(nodes: DataFrame, k: int, tables: int, block: int, seed: int) -> DataFrame:
    """Neighbours found within blocks of ``tables`` random orders; ``EDGE`` rows, repeats included."""
    bounded_batches(nodes.sparkSession)
    out = None
    for t in range(tables):
        def code(batches: Iterator[pa.RecordBatch], t=t) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                x = _matrix(batch.column(1))
                planes = np.random.RandomState(seed + t).randn(x.shape[1], 31).astype(np.float32)
                bits = (x @ planes > 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bits @ (1 << np.arange(30, -1, -1))), batch.column(0), batch.column(1)], ["code", "id", "v"])

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, count = [], 0
            for batch in batches:
                held.append(batch)
                count += len(batch)
                if count >= 4 * block:
                    x = pa.Table.from_batches(held).combine_chunks()
                    whole = count // block * block
                    yield from blocks(x.slice(0, whole))
                    held, count = x.slice(whole).to_batches(), count - whole
            if count > 1:
                yield from blocks(pa.Table.from_batches(held).combine_chunks())

        def blocks(x: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, v = x.column("id").to_numpy(), _matrix(x.column("v").combine_chunks())
            for lo in range(0, len(ids), block):
                a, i = v[lo : lo + block], ids[lo : lo + block]
                if len(i) < 2:
                    continue
                d = _distances(a, a)
                np.fill_diagonal(d, np.inf)
                m = min(k, len(i) - 1)
                best = np.argpartition(d, m - 1, axis=1)[:, :m]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, m)), pa.array(i[best].ravel()), pa.array(np.take_along_axis(d, best, 1).ravel().astype(np.float64))], ["id", "other", "d"])

        coded = nodes.mapInArrow(code, f"code long, id long, v {nodes.schema['v'].dataType.simpleString()}")
        found = coded.repartitionByRange("code", "id").sortWithinPartitions("code", "id").mapInArrow(near, EDGE)
        out = found if out is None else out.unionByName(found)
    return out


def best_edges(edges: DataFrame, k: int) -> DataFrame:
    """``id, near`` where ``near`` has the ``k`` nearest distinct others as ``struct(d, other)``."""
    ranked = edges.dropDuplicates(["id", "other"]).withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy("d", "other"))).filter(F.col("_r") <= k)
    return ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "other"))).alias("near"))


def descend(graph: DataFrame, nodes: DataFrame, k: int, members: int, proposals: int, turn: int) -> DataFrame:
    """One round: the graph after every node has introduced its neighbours to each other."""
    edges = graph.select("id", F.explode("near").alias("e")).select("id", F.col("e.other").alias("other"), F.col("e.d").alias("d"))
    forward = edges.select(F.col("id").alias("centre"), F.col("other").alias("member"))
    back = edges.select(F.col("other").alias("centre"), F.col("id").alias("member"), F.xxhash64(F.lit(turn), "id", "other").alias("h"))
    back = back.withColumn("_r", F.row_number().over(W.partitionBy("centre").orderBy("h", "member"))).filter(F.col("_r") <= members).select("centre", "member")
    who = forward.union(back).distinct()
    worst = graph.select(F.col("id").alias("node"), F.when(F.size("near") >= k, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf"))).alias("worst"))
    carried = nodes.join(worst, F.col("id") == F.col("node"), "left").select(F.col("id").alias("member"), "v", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
    rows = who.join(carried, "member").select("centre", "member", "worst", "v").repartition("centre").sortWithinPartitions("centre", "member")

    def introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            x = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            centre = x.column("centre").to_numpy()
            cut = int(np.searchsorted(centre, centre[-1]))
            if cut:
                yield from local(x.slice(0, cut), centre[:cut])
            rest = x.slice(cut)
        if rest is not None and len(rest):
            yield from local(rest, rest.column("centre").to_numpy())

    def local(x: pa.Table, centre: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = x.combine_chunks()
        v, ids, worst = _matrix(x.column("v").combine_chunks() if isinstance(x.column("v"), pa.ChunkedArray) else x.column("v")), x.column("member").to_numpy(), x.column("worst").to_numpy()
        bounds = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1], True])
        one, two, dist = [], [], []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo < 2:
                continue
            d = _distances(v[lo:hi], v[lo:hi])
            np.fill_diagonal(d, np.inf)
            m = min(proposals, hi - lo - 1)
            best = np.argpartition(d, m - 1, axis=1)[:, :m]
            near = np.take_along_axis(d, best, 1)
            a, b = np.nonzero(near < worst[lo:hi, None])
            one.append(ids[lo + a])
            two.append(ids[lo + best[a, b]])
            dist.append(near[a, b])
        if one:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(two)), pa.array(np.concatenate(dist).astype(np.float64))], ["id", "other", "d"])

    new = rows.mapInArrow(introduce, EDGE)
    return best_edges(edges.unionByName(new), k)


def build_graph(nodes: DataFrame, k: int = 32, tables: int = 6, block: int = 512, least_change: float = 0.02, members: int = 32, proposals: int = 12, seed: int = 11) -> DataFrame:
    """``id, near`` for ``nodes(id, v)``: the ``k`` nearest others found for each node.

    Rounds of descent go on until one changes less than ``least_change`` of the neighbours; distances
    only shrink, so that ends.
    """
    graph = stored(best_edges(start_graph(nodes, k, tables, block, seed), k), "ann-graph")
    turn = 0
    while True:
        better = stored(descend(graph, nodes, k, members, proposals, turn), "ann-graph")
        was = graph.select(F.col("id").alias("_id"), F.col("near.other").alias("_was"))
        fresh = F.size(F.array_except("near.other", F.coalesce("_was", F.array().cast("array<bigint>"))))
        counts = better.join(was, F.col("id") == F.col("_id"), "left").agg(F.sum(fresh).alias("fresh"), F.sum(F.size("near")).alias("all")).first()
        graph, turn = better, turn + 1
        if (counts["fresh"] or 0) <= least_change * (counts["all"] or 0):
            return graph


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, beam: int, expand: int) -> DataFrame:
    """``qid, id, d`` - the beam of every query ``(qid, q)``, whose own node is ``qid``.

    Links count both ways. Each round expands the ``expand`` nearest nodes not yet expanded, until all
    of every beam are; nodes enter a beam by being nearer than those that leave, so that ends.
    """
    edges = graph.select("id", F.explode("near.other").alias("other"))
    links = stored(edges.union(edges.select("other", "id")).distinct(), "ann-links")
    seen = stored(queries.select("qid", F.col("qid").alias("id"), F.lit(0.0).alias("d"), F.lit(False).alias("done")), "ann-beam")
    q = queries.select("qid", "q")
    order = W.partitionBy("qid").orderBy("d", "id")
    while True:
        open_ = seen.filter(~F.col("done")).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= expand).select("qid", "id")
        open_ = stored(open_, "ann-open")
        if open_.isEmpty():
            return seen.select("qid", "id", "d")
        found = open_.join(links, "id").select("qid", F.col("other").alias("id")).distinct().join(seen.select("qid", "id"), ["qid", "id"], "left_anti")
        near = found.join(nodes, "id").join(q, "qid").select("qid", "id", _exact("q", "v").alias("d"), F.lit(False).alias("done"))
        was = seen.join(open_.withColumn("_now", F.lit(True)), ["qid", "id"], "left").select("qid", "id", "d", (F.col("done") | F.coalesce("_now", F.lit(False))).alias("done"))
        merged = was.unionByName(near).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= beam).drop("_r")
        seen = stored(merged, "ann-beam")


def _exact(a: str, b: str):
    """Euclidean distance in double precision."""
    squares = F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def nearest(
    table: DataFrame,
    is_query,
    top: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    beam: int = 256,
    expand: int = 48,
    **graph_options,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest other rows found for each query row.

    ``is_query`` is a predicate on ``vec_id``. Distances are Euclidean, ties go to the smaller id.
    Null, empty, zero and non-finite vectors and null ids take no part; vectors must have one
    dimension. Of rows that repeat an id and a vector one takes part. Fewer candidates give fewer
    rows; no queries or no rows give no rows. Extra columns are ignored.
    """
    rows = stored(usable_vectors(table, id_col, vec_col).dropDuplicates(["vec_id", "v"]), "ann-vectors")
    groups = rows.groupBy("v").agg(F.min("vec_id").alias("id"))
    nodes = stored(groups.select("id", "v"), "ann-nodes")
    named = stored(rows.join(nodes, "v").select("vec_id", "id"), "ann-names")
    graph = build_graph(nodes, **graph_options)
    asking = named.filter(is_query)
    queries = stored(asking.select(F.col("id").alias("qid")).distinct().join(nodes, F.col("qid") == F.col("id")).select("qid", F.col("v").alias("q")), "ann-queries")
    found = search(graph, nodes, queries, max(beam, top + 1), expand)
    # of equal vectors, the smallest ids come first; one more than asked for, as a query is not its own answer
    first = W.partitionBy("id").orderBy("vec_id")
    few = named.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= top + 1).drop("_r")
    best = found.withColumn("_r", F.row_number().over(W.partitionBy("qid").orderBy("d", "id"))).filter(F.col("_r") <= top + 1).drop("_r")
    answers = best.join(few, "id").select("qid", "vec_id", "d")
    answers = answers.withColumn("_r", F.row_number().over(W.partitionBy("qid").orderBy("d", "vec_id"))).filter(F.col("_r") <= top + 1).drop("_r")
    pairs = asking.select(F.col("vec_id").alias("query_id"), F.col("id").alias("qid")).join(answers, "qid").filter("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("d", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", F.col("d").alias("score"))
