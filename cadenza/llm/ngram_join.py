"""Jaccard self-join on word shingles by adaptive multi-match prefixes, and its components.

All documents share one order of shingles: those that are not known to be frequent come first, by
hash; frequent ones come last, rarer before more frequent. A set of n shingles that reaches the
similarity with another shares at least t = ceil(n * num / den) shingles with it, so the first
n - t + l shingles of both have at least l in common. A document whose prefix would cost many
candidates (the estimate adds up the known counts of its prefix) gets a longer prefix, larger l,
and a pair is verified only if the two prefixes share min(l, l') shingles.

Passes: (1) counts: every document adds its lowest hashed shingles to distributed counts, of which
the ``frequent_max`` largest become the frequent list, a fixed bound; the list only sets the order,
so results never depend on it. (2) signatures: sizes, prefix and a 128-bit sum of the whole set;
equal sets fold into one class. (3) classes meet in the lists of their prefix shingles; those with
too few shared ones go at once. Every list is dealt into chunks of about ``block`` classes, each class
into one. A chunk counts shared prefix shingles by pair and passes on its groups of candidates; a
pair counts in the list of its first common shingle only. (4) the sets of candidates are computed
again from whole texts and verified exactly; of the links found, each group passes on a spanning
forest, and components follow. A pair that has its first common shingle at places i and j of its sets
shares at most min(n - i, n' - j); where that is too little, in a list or in a pair, it goes unverified.

Lists of more than one chunk still lack the pairs across chunks. Only pairs of different components
matter, so lists whose classes are all in one component are done. The others are dealt again, at
random, and the members of a list with most links so far join all of its chunks: a text that many are
near copies of finds them at once. That goes on as long as it at least halves what lies outside the
largest component of its list: a group of g near copies grows together within two or three deals,
each of which moves every member once. At last all pairs across components that remain, and no others, are compared by pairs of blocks:
the members of a list's largest component meet the rest, never each other. That is exact, and its
work grows with a list's members times those that link with none of them, as candidates do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, lean, small_enough, stored
from .components import connected_components, extended_components
from .textkernels import mix, shingle_sets


class Order:
    """The common order of shingles: frequent ones last, by count."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        by = np.argsort(frequent)
        self.frequent, self.counts = frequent[by], counts[by]

    def arrange(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles in order, and the known count of each (1 if not known)."""
        counts = np.ones(len(grams), np.int64)
        if len(self.frequent) and len(grams):
            at = np.minimum(np.searchsorted(self.frequent, grams), len(self.frequent) - 1)
            known = self.frequent[at] == grams
            counts[known] = self.counts[at[known]]
            by = np.argsort(counts, kind="stable")  # grams come sorted by hash
            return grams[by], counts[by]
        return grams, counts


def prefix_length(counts: np.ndarray, n: int, num: int, den: int, cost: int, least: int, longest: int) -> tuple[int, int]:
    """(prefix length, l): l is ``least`` and one more for every ``cost`` of estimated candidates."""
    t = -(-n * num // den)
    shortest = n - t + 1
    spent = int((counts[:shortest] - 1).sum())
    more = min(longest, least + spent // cost)
    more = min(more, t)
    return n - t + more, more


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), _signed(flat.astype(np.uint64)))


def _count_rows(k: int, least: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                held.append(s[: max(least, len(s) * percent // 100)])
                size += len(held[-1])
                if size > 1_000_000:
                    yield emit(held)
                    held, size = [], 0
        if size:
            yield emit(held)

    def emit(held):
        grams, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(grams), pa.array(counts.astype(np.int64))], ["gram", "n"])

    return run


def _signature_rows(k: int, num: int, den: int, cost: int, least: int, longest: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Order(*order.value)
        for batch in batches:
            sizes, one, two, prefixes, ells = [], [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                arranged, counts = frequent.arrange(s)
                p, ell = prefix_length(counts, len(s), num, den, cost, least, longest) if len(s) else (0, 0)
                sizes.append(len(s))
                a, b = _sums(s)
                one.append(a)
                two.append(b)
                prefixes.append(arranged[:p])
                ells.append(ell)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), _signed(np.array(one, np.uint64)), _signed(np.array(two, np.uint64)), _lists(prefixes), pa.array(ells, pa.int32())],
                ["id", "n", "sum_a", "sum_b", "prefix", "ell"],
            )

    return run


def _sums(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that stand for a whole set."""
    return s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)


def _set_rows(k: int):
    """``rep, grams`` of the rows ``rep, sum_a, sum_b, text`` whose set is the class's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (1, 2))
            reps, sets = [], []
            for rep, a, b, s in zip(batch.column(0).to_pylist(), one, two, shingle_sets(batch.column(3), k), strict=True):
                if _sums(s) == (a, b):
                    reps.append(rep)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sets, pa.binary())], ["rep", "grams"])

    return run


def candidate_groups(shared: list[np.ndarray], places: list[np.ndarray], ells: list[int], sizes: list[int], at: list[int], sides: list[int], parts: list[int], num: int, den: int) -> list[list[int]]:
    """Groups of positions that are tied by candidate pairs of one list.

    ``shared`` has the members' prefix shingles in the common order, ``places`` their places in the
    whole sets and ``at`` the place of the list's shingle. A pair is a candidate if it shares min(l, l')
    prefix shingles, is of two components (``parts``) and not of one side (``sides``; -1 meets all), has
    no common shingle before the list's, and may still share as many as the similarity asks for.
    """
    size, ell, side, part = (np.array(x) for x in (sizes, ells, sides, parts))
    rest = size - np.array(at)  # nothing before the list's shingle is shared
    asked = num * np.add.outer(size, size)
    ok = (num + den) * np.minimum.outer(rest, rest) >= asked
    ok &= np.not_equal.outer(part, part) & (np.not_equal.outer(side, side) | (side < 0))
    ok = np.triu(ok, 1)
    if ok.any():
        both = _products(shared)
        beyond = -(-size * num // den) - ell  # what lies after the prefix
        ok &= (both >= np.minimum.outer(ell, ell)) & ((num + den) * (both + np.maximum.outer(beyond, beyond)) >= asked)
    if ok.any():
        ok &= _products([s[: np.searchsorted(p, i)] for s, p, i in zip(shared, places, at, strict=True)]) == 0
    root = _forest(len(shared), zip(*np.nonzero(ok), strict=True))[0]
    groups: dict[int, list[int]] = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(i)
    return [g for g in groups.values() if len(g) > 1]


def links_within(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between the sets of one group, by position."""
    m = len(sets)
    if m <= 6:
        pairs = [(i, j) for i in range(m) for j in range(i + 1, m) if _linked(sets[i], sets[j], num, den)]
    else:
        sizes = np.array([len(s) for s in sets])
        inter = _products(sets)
        pairs = zip(*np.nonzero(np.triu(den * inter >= num * (np.add.outer(sizes, sizes) - inter), 1)), strict=True)
    return _forest(m, pairs)[1]


def _forest(m: int, pairs) -> tuple[list[int], list[tuple[int, int]]]:
    """Root of every position, and the pairs that joined two trees."""
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            forest.append((int(i), int(j)))
    return [find(i) for i in range(m)], forest


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if den * small < num * large:
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return den * both >= num * (small + large - both)


def _products(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over ``columns`` shingles at a time."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.flatnonzero(times > 1)
    name = np.full(len(grams), -1)
    name[common] = np.arange(len(common))
    code = name[code]
    keep = code >= 0
    code, owner = code[keep], owner[keep]
    by = np.argsort(code, kind="stable")
    code, owner = code[by], owner[by]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for lo in range(0, len(common), columns):
        a, b = np.searchsorted(code, [lo, lo + columns])
        part = np.zeros((len(sets), min(columns, len(common) - lo)), np.float32)
        part[owner[a:b], code[a:b] - lo] = 1
        out += np.rint(part @ part.T).astype(np.int64)
    return out


def _by_list(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows of each list; rows come sorted by list (the first ``width`` columns) and may run over batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() if not pa.types.is_list(c.type) else _arrays(c) for c in batch.columns), strict=True):
            if row[:width] != key:
                if len(rows) > 1:
                    yield rows
                key, rows = row[:width], []
            rows.append(row)
    if len(rows) > 1:
        yield rows


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat.view(np.uint64) if flat.dtype == np.int64 else flat
    at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _group_rows(num: int, den: int):
    """Groups of candidates from rows ``gram, x, y, rep, grams, places, ell, n, place, side, part`` in runs by list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _by_list(batches, 3):
            ids = [r[3] for r in rows]
            out += [[ids[i] for i in g] for g in candidate_groups(*([r[c] for r in rows] for c in range(4, 11)), num, den)]
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["members"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["members"])

    return run


def _link_rows(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _by_list(batches, 1):
            out += [(rows[i][1], rows[j][1]) for i, j in links_within([np.frombuffer(r[2], np.uint64) for r in rows], num, den)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


#: What tells classes of equal sets apart.
SAME = ["n", "sum_a", "sum_b"]


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row of ``docs``; ``options`` as in ``classes``.

    Two documents link when ``den * |A & B| >= num * |A | B|`` for their shingle sets; the component
    is the smallest id reachable by links. Null, empty and wordless texts have no shingles and are
    their own component. Ids are integers; a null id is reported with null component and links
    nothing. Each row is a document of its own: rows that repeat an id may be of several components.
    Other columns are ignored and may have any name. No rows give no rows.
    """
    signed, found = classes(docs, id_col, text_col, **options)
    # rows without a class go past the join: there may be many of them, all of one key
    classed = F.col("id").isNotNull() & (F.col("n") > 0)
    named = signed.filter(classed).join(found.select(*SAME, "least_id"), SAME).select("id", "n", "least_id")
    alone = signed.filter(~classed).select("id", "n", F.col("id").alias("least_id"))
    return named.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least_id").alias("component_id"))


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    num: int = 80,
    den: int = 100,
    frequent_max: int = 262_144,
    frequent_least: int = 4,
    cost: int = 256,
    least: int = 4,
    longest: int = 8,
    block: int = 256,
    deals: int = 8,
    broadcast_rows: int = 500_000,
) -> tuple[DataFrame, DataFrame]:
    """Signatures ``id, n, sum_a, sum_b`` of all rows, and the classes of equal sets.

    Classes have ``n, sum_a, sum_b, first_id, least_id``, the smallest id of the class and of its
    component, and ``first``: whether the class is the one of its component that is kept, of those with
    the smallest id the first by sums.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counted = rows.select("text").mapInArrow(lean(_count_rows(k, 64, min(100, -(-150 * (den - num) // den)))), "gram long, n long")
    frequent = counted.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= frequent_least).orderBy(F.desc("n"), "gram").limit(frequent_max).toArrow()
    order = spark.sparkContext.broadcast((frequent.column("gram").to_numpy().view(np.uint64), frequent.column("n").to_numpy()))
    signed = rows.mapInArrow(lean(_signature_rows(k, num, den, cost, least, longest, order)), "id long, n long, sum_a long, sum_b long, prefix array<long>, ell int")
    signed = stored(signed, "ngram-signatures")

    # the prefix follows from the set, so any row's will do
    kinds = signed.filter("n > 0 and id is not null").groupBy(*SAME).agg(F.min("id").alias("first_id"), F.first("ell").alias("ell"), F.first("prefix").alias("prefix"))
    kinds = stored(kinds.withColumn("rep", F.monotonically_increasing_id()), "ngram-classes")
    index = kinds.select("rep", "n", F.posexplode("prefix").alias("place", "gram"))
    # a pair's first common shingle leaves as many behind it as the similarity asks for, in both sets
    opens = (F.col("n") - F.col("place")) * den >= F.col("n") * num
    often = index.groupBy("gram").agg(F.count("*").alias("all"), F.count_if(opens).alias("m"), F.min(F.when(opens, F.col("n"))).alias("low")).filter("all > 1").drop("all")
    # the partner of a set of n shingles has at least n * num / den of them, so this bounds min(l, l')
    need = F.least(F.col("ell"), F.greatest(F.lit(1), F.least(F.lit(least), F.ceil(F.ceil(F.col("n") * num / den) * num / den).cast("int"))))
    shared = index.join(often, "gram").groupBy("rep").agg(F.array_sort(F.collect_set(F.struct("place", "gram", "m", "low"))).alias("grams"))
    shared = shared.join(kinds.select("rep", "ell", "n"), "rep").filter(F.size("grams") >= need)
    shared = stored(shared.select("rep", "ell", "n", "grams"), "ngram-shared")
    traits = shared.select("rep", F.col("grams.gram").alias("grams"), F.col("grams.place").alias("places"), "ell", "n")

    def links(lists: DataFrame, parts: DataFrame | None) -> DataFrame:
        """Links found among rows ``gram, x, y, rep, place, side`` of lists; classes of one of ``parts`` need none."""
        members = lists.join(traits, "rep")
        if parts is not None:
            members = members.join(parts, members["rep"] == parts["id"], "left")
        part = F.col("rep") if parts is None else F.coalesce("component", "rep")
        members = members.select("gram", "x", "y", "rep", "grams", "places", "ell", "n", "place", "side", part.alias("part"))
        members = members.repartition("gram", "x", "y").sortWithinPartitions("gram", "x", "y", "rep")
        groups = stored(members.mapInArrow(lean(_group_rows(num, den)), "members array<long>").distinct(), "ngram-groups")
        near = stored(groups.select(F.explode("members").alias("rep")).distinct().join(kinds.select("rep", "first_id", "sum_a", "sum_b"), "rep"), "ngram-candidates")
        wanted = F.broadcast(near) if small_enough(near, broadcast_rows) else near
        texts = rows.join(wanted, F.col("id") == F.col("first_id")).select("rep", "sum_a", "sum_b", "text")
        # dealt by rep alone, which serves the dropping of repeats and the join: whole sets move once less
        sets = texts.mapInArrow(lean(_set_rows(k)), "rep long, grams binary").repartition("rep").dropDuplicates(["rep", "grams"])
        grouped = groups.select(F.xxhash64("members").alias("list"), F.explode("members").alias("rep")).join(sets, "rep")
        grouped = grouped.select("list", "rep", "grams").repartition("list").sortWithinPartitions("list", "rep")
        return stored(grouped.mapInArrow(lean(_link_rows(num, den)), "a long, b long"), "ngram-links")

    # the largest partner that what is left of a set allows; a list without one so small has none for it
    most = F.floor((F.col("n") - F.col("place")) * (num + den) / num) - F.col("n")
    listed = shared.select("rep", "n", F.explode("grams").alias("g")).select("rep", "n", "g.*").filter(opens & (F.col("m") > 1)).withColumn("most", most).filter("most >= low").drop("low")
    edges = links(_dealt(listed, 0, block), None)
    parts = connected_components(edges)
    hot = listed.filter(F.col("m") > block)
    if not hot.isEmpty():
        parts = _across(stored(hot, "ngram-hot"), edges, parts, links, block, deals)

    at = kinds.select(*SAME, "rep", "first_id").join(parts, F.col("rep") == F.col("id"), "left").select(*SAME, "rep", "first_id", F.coalesce("component", "rep").alias("component"))
    at = stored(at, "ngram-components")
    best = at.groupBy(F.col("component").alias("_c")).agg(F.min(F.struct("first_id", "sum_a", "sum_b", "rep")).alias("best"))
    found = at.join(best, F.col("component") == F.col("_c")).select(*SAME, "first_id", F.col("best.first_id").alias("least_id"), (F.col("rep") == F.col("best.rep")).alias("first"))
    return signed.select("id", *SAME), stored(found, "ngram-found")


def _dealt(listed: DataFrame, turn: int, block: int, part: str | None = None, everywhere: DataFrame | None = None) -> DataFrame:
    """Rows ``gram, x, y, rep, place, side`` of lists: chunks of about ``block`` classes, each class in one.

    The rows of ``everywhere``, a bounded share of a chunk, join all chunks of their lists. Chunks of
    the same members stand for the pairs of all of them once, in the list of the first shingle by the
    common order (that is, by its place in any member): all members share it, so no pair's first
    common shingle is a later one. Chunks within one ``part`` go.
    """
    chunks = F.ceil(F.col("m") / block).cast("int")
    rows = listed.withColumn("x", F.pmod(F.xxhash64(F.lit(turn), "rep"), chunks).cast("int"))
    if everywhere is not None:
        rows = rows.unionByName(everywhere.withColumn("x", F.explode(F.sequence(F.lit(0), chunks - 1))))
    lists = rows.groupBy("gram", "x").agg(F.array_sort(F.collect_set(F.struct("rep", "place"))).alias("members"), *([F.min(part).alias("lo"), F.max(part).alias("hi")] if part is not None else []))
    lists = lists.filter("size(members) > 1" + (" and lo <> hi" if part is not None else ""))
    lists = lists.groupBy(F.col("members.rep").alias("reps")).agg(F.min(F.struct(F.col("members")[0]["place"].alias("first"), "gram", "x", F.col("members.place").alias("places"))).alias("of"))
    lists = lists.select("of.gram", "of.x", F.explode(F.arrays_zip("reps", "of.places")).alias("m"))
    return lists.select("gram", "x", F.col("x").alias("y"), F.col("m.reps").alias("rep"), F.col("m.places").alias("place"), F.lit(-1).alias("side"))


def _across(hot: DataFrame, edges: DataFrame, parts: DataFrame, links, block: int, deals: int) -> DataFrame:
    """Components once lists of more than one chunk, rows ``rep, n, place, gram, m, most`` of ``hot``, are compared whole."""
    turn, before = 0, None
    while True:
        turn += 1
        named = hot.join(parts, F.col("rep") == F.col("id"), "left").select(*hot.columns, F.coalesce("component", "rep").alias("part"))
        each = named.groupBy("gram", "part").agg(F.count("*").alias("c"))
        lists = each.groupBy("gram").agg(F.max(F.struct("c", "part")).alias("main"), F.sum("c").alias("all"))
        lists = stored(lists.select("gram", F.col("main.part").alias("main"), (F.col("all") - F.col("main.c")).alias("outside")).filter("outside > 0"), "ngram-open")
        left = lists.agg(F.sum("outside")).first()[0] or 0
        if not left:
            return parts
        if turn > deals or (before is not None and 2 * left > before):
            return extended_components(parts, links(_blocks(named.join(lists, "gram"), block), parts))
        before = left
        open_ = named.join(lists.select("gram"), "gram", "left_semi")
        found = links(_dealt(open_, turn, block, "part", _most_linked(open_, edges, block // 4)), parts)
        parts, edges = extended_components(parts, found), edges.unionByName(found)


def _most_linked(named: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The ``most`` members of every list that occur most often in ``edges``."""
    ends = edges.select(F.col("a").alias("end")).union(edges.select("b")).groupBy("end").agg(F.count("*").alias("links"))
    order = W.partitionBy("gram").orderBy(F.desc("links"), "rep")
    return named.join(ends, F.col("rep") == F.col("end")).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).select(*named.columns)


def _blocks(named: DataFrame, block: int) -> DataFrame:
    """Rows ``gram, x, y, rep, place, side`` of all pairs of blocks, but for those within the largest component.

    The largest component of a list is its blocks 0, 1, ... and the rest the blocks after these.
    Members that are too large for all others, or all others for them, meet none.
    """
    named = stored(named.withColumn("inside", F.col("part") == F.col("main")), "ngram-open-members")
    inside = F.col("inside")
    low = lambda where, name: F.min(F.when(where, F.col("n"))).alias(f"{name}_low")
    high = lambda where, name: F.max(F.when(where, F.col("most"))).alias(f"{name}_high")
    bounds = named.groupBy("gram").agg(low(inside, "in"), high(inside, "in"), low(~inside, "out"), high(~inside, "out"))
    fits = lambda name: (F.col("most") >= F.col(f"{name}_low")) & (F.col("n") <= F.col(f"{name}_high"))
    rows = named.join(bounds, "gram").withColumn("_in", ~inside & fits("in")).withColumn("_out", fits("out")).filter("_in or _out")
    counts = rows.groupBy("gram").agg(F.count_if(inside).alias("_a"), F.count_if(~inside).alias("_b"))
    inner, outer = (F.ceil(F.col(c) / block).cast("int") for c in ("_a", "_b"))
    rows = rows.join(counts, "gram").withColumn("_inner", inner).withColumn("_outer", outer)
    own = F.pmod(F.xxhash64("rep"), F.when(inside, F.col("_inner")).otherwise(F.col("_outer"))).cast("int") + F.when(inside, 0).otherwise(F.col("_inner"))
    within = lambda a, n: F.when(n > 0, F.sequence(a, a + n - 1)).otherwise(F.array().cast("array<int>"))
    # a block of the largest component meets the others only
    none = F.array().cast("array<int>")
    others = F.concat(F.when(F.col("_in"), within(F.lit(0), F.col("_inner"))).otherwise(none), F.when(F.col("_out"), within(F.col("_inner"), F.col("_outer"))).otherwise(none))
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(others))
    x, y = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(F.col("_own") == F.col("_other"), -1).otherwise((F.col("_own") == y).cast("int"))
    return rows.select("gram", x.alias("x"), y.alias("y"), "rep", "place", side.alias("side"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, **options) -> DataFrame:
    """``docs`` with one row of each component, one of smallest id; columns unchanged.

    Rows without words and rows of null ids all stay. Where an id is repeated, its rows are told
    apart by their sets, and of rows equal in id and set the first by all columns stays.
    """
    signed, found = classes(docs, id_col, text_col, k=k, **options)
    id_ = F.col(f"`{id_col}`")
    keeps = found.filter("first").select(*SAME, F.col("first_id").alias("kept"))
    stays = (F.col("n") == 0) | F.col("kept").isNotNull()
    told = signed.filter("id is not null").join(keeps.withColumn("id", F.col("kept")), [*SAME, "id"], "left")
    ids = stored(told.groupBy("id").agg(F.count("*").alias("rows"), F.count_if(stays).alias("stay")).filter("rows > 1 or stay = 0"), "ngram-ids")
    gone = ids.select(F.col("id").alias(free_name(docs, "_gone")))
    plain = docs.join(gone, id_.cast("long") == gone[gone.columns[0]], "left_anti")
    again = ids.filter("stay > 0").select("id")
    if again.isEmpty():
        return plain
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(id_.cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), row.alias("row")).join(again, "id", "left_semi")
    rows = rows.mapInArrow(lean(_told_rows(k)), rows.select("id", "row").schema.add("n", "long").add("sum_a", "long").add("sum_b", "long"))
    empty = rows.filter("n = 0").select("row.*")
    # repeats are combined before the shuffle, so that a group of them is one row for each task
    one = rows.filter("n > 0").groupBy("id", *SAME).agg(F.min_by("row", F.to_json("row")).alias("row"))
    one = one.join(keeps.withColumnRenamed("kept", "id"), [*SAME, "id"], "left_semi").select("row.*")
    return plain.unionByName(empty).unionByName(one)


def _told_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), *_sums(s)) for s in shingle_sets(batch.column(1), k)]
            sums = [_signed(np.array([s[c] for s in sets], np.uint64)) for c in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([s[0] for s in sets], pa.int64()), *sums], ["id", "row", *SAME])

    return run
