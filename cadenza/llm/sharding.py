"""K-d tree partitioning of documents into shards of near equal bytes. DataFrame operations only.

Nodes are split at distributed weighted medians along the widest metadata dimension until every
leaf is one shard, i.e. holds the target bytes. Where single rows are so large that a cut misses the median by
more than ``MISS``, the next widest dimensions are tried and the nearest cut counts. A node of m shards is cut where its bytes divide as
floor(m/2) : ceil(m/2). All nodes of a level are cut together, by radix descent on an
order-preserving 60-bit key: each round sums bytes per node and next 12 bits, so that the driver
sees at most nodes x 4096 sums, and a node is done when the digit that holds its cut has less than
``tolerance`` of a shard's bytes. Below the value, a key has hashed bits of the text and then of text and
id: rows of one text and one place lie next to each other and are parted only by a cut that falls
between them. Rows are read as often as there are rounds, four numbers each, and never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Bits of a dimension's value in a sort key, and below it those of the text's and of the row's hash.
VALUE_BITS, TEXT_BITS, ROW_BITS, DIGIT = 24, 24, 12, 12
TIE_BITS = TEXT_BITS + ROW_BITS
#: A cut that misses its goal by a larger share is tried along the other dimensions, too.
MISS = 0.002


def kd_shards(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    dimensions: dict[str, Column] | None = None,
    overhead: int = 8,
    tolerance: float = 1e-3,
    slot_rows: int = 20_000,
) -> DataFrame:
    """``id_col, size, text_crc32, shard, slot`` for every row of ``docs``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus ``overhead``. ``dimensions`` are numeric
    columns or expressions of ``docs`` (default: length, hashed source, hashed language); null and
    non-finite values lie at the lower end. Slots count from 0 in each shard, by the hash of text
    and id; rows alike in both share a shard and are dealt slots in any order. Ids may be null or
    repeat. Fewer rows than shards leave shards empty. No rows give no rows. Extra columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    if dimensions is None:
        unit = lambda c: F.xxhash64(F.col(c)) / 2.0**63
        dimensions = {"length": F.log2(F.octet_length(text) + 1.0)} | {c: unit(c) for c in ("source", "lang") if c in docs.columns}
    names = [f"_d{i}" for i in range(len(dimensions))]
    rows = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
        *[d.cast("double").alias(n) for n, d in zip(names, dimensions.values(), strict=True)],
    )
    rows = stored(rows, "shard-rows")
    box = [r for n in names for r in (F.min(_finite(n)).alias(f"{n}_lo"), F.max(_finite(n)).alias(f"{n}_hi"))]
    bounds = rows.agg(F.count("*").alias("rows"), F.sum("size").alias("all"), *box).first()
    tie = F.shiftleft(F.shiftrightunsigned("_text", 64 - TEXT_BITS), ROW_BITS) + F.shiftrightunsigned(F.xxhash64("_text", "_id"), 64 - ROW_BITS)
    keys = [_key(n, bounds[f"{n}_lo"], bounds[f"{n}_hi"]).alias(n) for n in names]
    items = rows.select("_id", "size", "text_crc32", "_text", tie.alias("_tie"), *keys)
    tree = grow(items.select(F.col("size").alias("_bytes"), "_tie", *names), names, shards, (bounds["all"] or 0) / shards * tolerance)
    placed = items.select("_id", "size", "text_crc32", "_text", tree.alias("shard"))
    return _slots(placed, bounds["rows"], slot_rows).select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def _finite(name: str) -> Column:
    c = F.col(name)
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300), c)


def _key(name: str, lo: float | None, hi: float | None) -> Column:
    """The value on a grid over its range: an integer of VALUE_BITS bits."""
    if lo is None or hi is None or hi <= lo:
        return F.lit(0).cast("long")
    step = (2.0**VALUE_BITS - 1) / (hi - lo)
    return F.coalesce(F.floor((_finite(name) - lo) * step), F.lit(0)).cast("long")


def grow(items: DataFrame, names: list[str], shards: int, tolerance: float = 0) -> Column:
    """The tree over ``items(_bytes, _tie, names...)`` as an expression for the shard.

    A cut may miss its place by less than ``tolerance`` bytes.
    """
    # nodes by number: first shard and shards, then dimension, key of the cut, left and right child once cut
    nodes: list[list] = [[0, shards, None, None, None, None]]
    frontier = [0] if shards > 1 else []
    while frontier:
        base = items.withColumn("_node", _walk(nodes, names)).filter(_of(nodes, frontier, lambda i: True, "boolean"))
        stats = {r["_node"]: r for r in base.groupBy("_node").agg(F.sum("_bytes").alias("bytes"), *[(F.max(n) - F.min(n)).alias(n) for n in names]).collect()}
        order = {i: sorted(range(len(names)), key=lambda c: (-r[names[c]], c)) for i, r in stats.items()}  # noqa: B023
        goal = {i: r["bytes"] * (nodes[i][1] // 2) / nodes[i][1] for i, r in stats.items()}
        best: dict[int, tuple[float, int, int]] = {}  # miss, dimension, key of the cut
        for place in range(len(names)):
            # the next dimension only where single rows are too large for a cut along the ones before
            wanted = {i: order[i][place] for i in stats if i not in best or best[i][0] > MISS * goal[i]}
            if not wanted:
                break
            for i, (cut, miss) in _cuts(base, nodes, names, wanted, goal, tolerance).items():
                if i not in best or miss < best[i][0]:
                    best[i] = miss, wanted[i], cut
        before, frontier = frontier, []
        for i in before:
            first, count = nodes[i][:2]
            half = count // 2
            children = [len(nodes), len(nodes) + 1]
            nodes += [[first, half, None, None, None, None], [first + half, count - half, None, None, None, None]]
            # a node without rows may be cut anywhere
            nodes[i][2:] = [*best.get(i, (0, 0, 0))[1:], *children]
            frontier += [c for c in children if nodes[c][1] > 1]
    leaf = _walk(nodes, names)
    return F.element_at(F.array(*[F.lit(n[0]) for n in nodes]), leaf + 1).cast("int")


def _cuts(base: DataFrame, nodes: list[list], names: list[str], along: dict[int, int], goal: dict[int, float], tolerance: float) -> dict[int, tuple[int, float]]:
    """Key of the cut of each node along a dimension, and the bytes by which it misses the goal."""
    key = F.element_at(F.array(*[_wide(n) for n in names]), _of(nodes, along, lambda i: along[i] + 1, "int"))
    keyed = base.select("_node", "_bytes", key.alias("_key"))
    found = dict.fromkeys(along, (0, 0))  # digits of the cut so far, bytes below it
    cut: dict[int, tuple[int, float]] = {}
    for done in range(DIGIT, VALUE_BITS + TIE_BITS + 1, DIGIT):
        left = VALUE_BITS + TIE_BITS - done
        open_ = [i for i in found if i not in cut]
        within = F.shiftright("_key", left + DIGIT) == _of(nodes, open_, lambda i: found[i][0], "long")
        digit = F.shiftright("_key", left).bitwiseAND((1 << DIGIT) - 1)
        sums: dict[int, list[tuple[int, int]]] = {}
        for r in keyed.filter(within).groupBy("_node", digit.alias("digit")).agg(F.sum("_bytes").alias("b")).collect():
            sums.setdefault(r["_node"], []).append((r["digit"], r["b"]))
        for i, parts in sums.items():
            prefix, below = found[i]
            for d, b in sorted(parts):
                if below + b > goal[i]:
                    break
                below += b
            else:  # all of it lies below the cut
                d, b = d + 1, 0
            found[i] = ((prefix << DIGIT) + d, below)
            if b <= tolerance or not left:
                # a digit that is not taken apart goes to the side that it leaves nearer to the goal
                after = b > 0 and below + b - goal[i] < goal[i] - below
                cut[i] = found[i][0] + int(after) << left, abs(below + b * after - goal[i])
        if len(cut) == len(found):
            break
    return cut


def _wide(name: str) -> Column:
    """Sort key of a row along a dimension."""
    return F.col(name) * (1 << TIE_BITS) + F.col("_tie")


def _of(nodes: list[list], some, value, kind: str) -> Column:
    """``value`` of a row's node if it is one of ``some``, else null; by one lookup, whatever the tree's size."""
    known = set(some)
    return F.element_at(F.array(*[F.lit(value(i) if i in known else None).cast(kind) for i in range(len(nodes))]), F.col("_node") + 1)


def _walk(nodes: list[list], names: list[str]) -> Column:
    """Number of the node that a row comes to, a step a level; small for any tree, as nodes are looked up."""
    depth, level = 0, [0]
    while level := [c for i in level for c in nodes[i][4:] if c is not None]:
        depth += 1
    if not depth:
        return F.lit(0)
    table = [F.array(*[F.lit(n[c] if n[c] is not None else d).cast("long") for n in nodes]) for c, d in ((2, 0), (3, 0), (4, -1), (5, -1))]
    keys = F.array(*[_wide(n) for n in names])

    def step(at: Column, _: Column) -> Column:
        dim, cut, left, right = (F.element_at(x, at + 1) for x in table)
        return F.when(left < 0, at).when(F.element_at(keys, (dim + 1).cast("int")) >= cut, right.cast("int")).otherwise(left.cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def _slots(placed: DataFrame, total: int, slot_rows: int) -> DataFrame:
    """Numbers from 0 within each shard, by bins of a hash and a prefix sum over bins."""
    bins = max(1, -(-total // slot_rows))
    hashed = F.xxhash64("_text", "_id")
    binned = placed.withColumn("_hash", hashed).withColumn("_bin", F.shiftrightunsigned(F.shiftrightunsigned("_hash", 32) * bins, 32))
    keys = ["shard", "_bin"]
    sums = binned.groupBy(*keys).agg(F.count("*").alias("_n"))
    sums = sums.withColumn("_before", F.sum("_n").over(W.partitionBy("shard").orderBy("_bin")) - F.col("_n")).drop("_n")
    order = W.partitionBy(*keys).orderBy("_hash", "_id")
    return binned.withColumn("_at", F.row_number().over(order)).join(sums, keys).withColumn("slot", (F.col("_before") + F.col("_at") - 1).cast("long"))
