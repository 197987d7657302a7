"""Near-duplicates by MinHash bands, sequential Bayesian verification and an exact check of what survives.

Every set of word shingles gets ``bands`` keys, each of ``rows`` minima of hashes, and ``checks`` further
minima of which a byte each is kept (with 32 bits of each key, the marks of a set). A pair of similarity s shares no band with a chance of
(1 - s**rows)**bands: 8e-7 at 0.85 with 24 bands of 5, less above. Equal sets fold into one class first.

Classes meet in the lists of their band keys. A pair counts in the list of its first common band only, if
its sizes allow the similarity. Its checks are compared in batches: with a uniform prior, m matches of n
leave a posterior of Beta(m + 1, n - m + 1) for the similarity, and the pair goes once the chance that
it reaches the threshold is below ``miss``. Bytes match more often than hashes do, which only keeps pairs.
Survivors are verified on their full sets, computed again from whole texts.

The ``first`` bands go before the others, whose lists then need no pairs of one component: most copies have
met by then. Lists are dealt in chunks, and lists of more than one chunk compared across them, as ``ngram_join``
does it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, small_enough, stored
from .components import connected_components, extended_components
from .ngram_join import SAME, _blocks, _by_list, _dealt, _forest, _link_rows, _most_linked, _set_rows, _signed, _sums
from .textkernels import mix, shingle_sets

#: Shingles hashed at once, which bounds temporaries.
PIECE = 4096
_STEP = np.uint64(0xD6E8FEB86659FD93)


def hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of ``count`` hashes a * x + b modulo 2**32."""
    seeds = mix(np.arange(1, 2 * count + 1).astype(np.uint64) * _STEP).astype(np.uint32)
    return seeds[:count] | np.uint32(1), seeds[count:]


def minima(grams: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest value of every hash of the family over the shingles of a set, which has one at least."""
    a, b = (x[:, None] for x in family)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    parts = [(a * short[i : i + PIECE] + b).min(1) for i in range(0, len(short), PIECE)]
    return parts[0] if len(parts) == 1 else np.min(parts, axis=0)


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for every ``rows`` minima; the band's number is part of it."""
    key = np.arange(bands).astype(np.uint64)
    for column in values.reshape(bands, rows).T:
        key = mix(key * _STEP + column)
    return key


def least_matches(count: int, num: int, den: int, miss: float) -> int:
    """The fewest matches of ``count`` hashes that leave a chance of ``miss`` or more for a similarity of num / den.

    1 - I_t(m + 1, n - m + 1) of the posterior is the chance of at most m successes in n + 1 trials of chance t.
    """
    t, chance = num / den, 0.0
    for m in range(count + 1):
        chance += math.comb(count + 1, m) * t**m * (1 - t) ** (count + 1 - m)
        if chance >= miss:
            return m
    return count + 1


def surviving(checks: np.ndarray, i: np.ndarray, j: np.ndarray, batch: int, needs: list[int]) -> np.ndarray:
    """Which pairs (i, j) of rows of ``checks`` stay after all batches; pairs that go are compared no further."""
    left, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for at, need in enumerate(needs):
        part = slice(at * batch, (at + 1) * batch)
        matches = matches + (checks[i[left], part] == checks[j[left], part]).sum(1)
        stay = matches >= need
        left, matches = left[stay], matches[stay]
    return left


def candidate_groups(bands: np.ndarray, checks: np.ndarray, sizes: np.ndarray, place: int, sides: np.ndarray, parts: np.ndarray, num: int, den: int, batch: int, needs: list[int]) -> list[list[int]]:
    """Groups of positions that are tied by surviving pairs of the list of band ``place``.

    A pair is of two components (``parts``) and not of one side (``sides``; -1 meets all), and has no
    common band before the list's.
    """
    ok = den * np.minimum.outer(sizes, sizes) >= num * np.maximum.outer(sizes, sizes)
    ok &= np.not_equal.outer(parts, parts) & (np.not_equal.outer(sides, sides) | (sides < 0))
    ok = np.triu(ok, 1)
    for band in range(place):
        if not ok.any():
            return []
        ok &= np.not_equal.outer(bands[:, band], bands[:, band])
    i, j = np.nonzero(ok)
    left = surviving(checks, i, j, batch, needs)
    groups: dict[int, list[int]] = {}
    for at, root in enumerate(_forest(len(sizes), zip(i[left], j[left], strict=True))[0]):
        groups.setdefault(root, []).append(at)
    return [g for g in groups.values() if len(g) > 1]


def _signature_rows(k: int, bands: int, rows: int, checks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = hash_family(bands * rows + checks)
        for batch in batches:
            out = []
            for s in shingle_sets(batch.column(1), k):
                if len(s):
                    values = minima(s, family)
                    keys, seen = band_keys(values[: bands * rows], bands, rows), (values[bands * rows :] >> np.uint32(24)).astype(np.uint8)
                    out.append((len(s), *_sums(s), keys.tobytes(), keys.astype(np.uint32).tobytes() + seen.tobytes()))
                else:
                    out.append((0, np.uint64(0), np.uint64(0), b"", b""))
            sizes, one, two, keys, marks = zip(*out, strict=True) if out else ((),) * 5
            flat = np.frombuffer(b"".join(keys), np.uint64)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 8 for x in keys])]).astype(np.int32)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), _signed(np.array(one, np.uint64)), _signed(np.array(two, np.uint64)), pa.ListArray.from_arrays(pa.array(offsets), _signed(flat)), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", *SAME, "bands", "marks"])

    return run


def _group_rows(num: int, den: int, bands: int, batch: int, needs: list[int]):
    """Groups of candidates from rows ``gram, x, y, rep, marks, n, place, side, part`` in runs by list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _by_list(batches, 3):
            ids, marks, sizes, places, sides, parts = zip(*(r[3:] for r in rows), strict=True)
            marks = np.frombuffer(b"".join(marks), np.uint8).reshape(len(ids), -1)
            tags = np.ascontiguousarray(marks[:, : 4 * bands]).view(np.uint32)
            out += [[ids[i] for i in g] for g in candidate_groups(tags, marks[:, 4 * bands :], np.array(sizes), places[0], np.array(sides), np.array(parts), num, den, batch, needs)]
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["members"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["members"])

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    num: int = 80,
    den: int = 100,
    bands: int = 24,
    rows: int = 5,
    checks: int = 192,
    batch: int = 16,
    miss: float = 1e-7,
    first: int = 6,
    block: int = 512,
    deals: int = 8,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents link when ``den * |A & B| >= num * |A | B|`` for their sets of ``k``-word shingles; the
    component is the smallest id reachable by links, ``kept`` whether the id is that. Every link reported
    is exact; one of similarity num / den is missed with the chance that bands and ``miss`` leave (see the
    module). Null, empty and wordless texts have no shingles and are their own component. Ids are
    integers; a null id has a null component, links nothing and is kept. Rows that repeat an id are
    documents of their own and may be of several components. Other columns are ignored and may have
    any name. No rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    needs = [least_matches(n, num, den, miss) for n in range(batch, checks + 1, batch)]
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signed = source.mapInArrow(lean(_signature_rows(k, bands, rows, checks)), "id long, n long, sum_a long, sum_b long, bands array<long>, marks binary")
    signed = stored(signed, "minhash-signatures")
    classed = F.col("id").isNotNull() & (F.col("n") > 0)
    # bands and marks follow from the set, so any row's will do
    kinds = signed.filter(classed).groupBy(*SAME).agg(F.min("id").alias("first_id"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    kinds = stored(kinds.withColumn("rep", F.monotonically_increasing_id()), "minhash-classes")

    index = kinds.select("rep", "n", F.posexplode("bands").alias("place", "gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("m"), F.min("n").alias("low"), F.max("n").alias("high")).filter("m > 1")
    # of lists of two, those of sizes too far apart go at once
    fits = (F.col("m") > 2) | (F.col("low") * den >= F.col("high") * num)
    listed = stored(index.join(often.filter(fits).select("gram", "m"), "gram").select("rep", "n", "place", "gram", "m", F.floor(F.col("n") * den / num).alias("most")), "minhash-lists")
    traits = stored(kinds.select("rep", "marks", "n").join(listed.select("rep").distinct(), "rep"), "minhash-traits")

    def links(lists: DataFrame, parts: DataFrame | None) -> DataFrame:
        """Links found among rows ``gram, x, y, rep, place, side`` of lists; classes of one of ``parts`` need none."""
        members = lists.join(traits, "rep")
        if parts is not None:
            members = members.join(parts, members["rep"] == parts["id"], "left")
        part = F.col("rep") if parts is None else F.coalesce("component", "rep")
        members = members.select("gram", "x", "y", "rep", "marks", "n", "place", "side", part.alias("part"))
        members = members.repartition("gram", "x", "y").sortWithinPartitions("gram", "x", "y", "rep")
        groups = stored(members.mapInArrow(lean(_group_rows(num, den, bands, batch, needs)), "members array<long>").distinct(), "minhash-groups")
        near = stored(groups.select(F.explode("members").alias("rep")).distinct().join(kinds.select("rep", "first_id", "sum_a", "sum_b"), "rep"), "minhash-candidates")
        wanted = F.broadcast(near) if small_enough(near, broadcast_rows) else near
        texts = source.join(wanted, F.col("id") == F.col("first_id")).select("rep", "sum_a", "sum_b", "text")
        sets = texts.mapInArrow(lean(_set_rows(k)), "rep long, grams binary").repartition("rep").dropDuplicates(["rep", "grams"])
        grouped = groups.select(F.xxhash64("members").alias("list"), F.explode("members").alias("rep")).join(sets, "rep")
        grouped = grouped.select("list", "rep", "grams").repartition("list").sortWithinPartitions("list", "rep")
        return stored(grouped.mapInArrow(lean(_link_rows(num, den)), "a long, b long"), "minhash-links")

    early, hot = F.col("place") < first, stored(listed.filter(F.col("m") > block), "minhash-hot")
    any_hot = not hot.isEmpty()
    edges = links(_dealt(listed.filter(early), 0, block), None)
    parts = connected_components(edges)
    if any_hot:
        parts = _across(hot.filter(early), edges, parts, links, block, deals)
    # of the other bands, what the first ones have not brought together; long lists go straight to pairs of blocks
    rest = listed.filter(~early & (F.col("m") <= block)).join(parts, F.col("rep") == F.col("id"), "left").select(*listed.columns, F.coalesce("component", "rep").alias("part"))
    parts = extended_components(parts, links(_dealt(rest, 0, block, "part"), parts))
    if any_hot:
        parts = _across(hot.filter(~early), None, parts, links, block, 0)

    at = kinds.select(*SAME, "rep", "first_id").join(parts, F.col("rep") == F.col("id"), "left").select(*SAME, "first_id", F.coalesce("component", "rep").alias("component"))
    at = stored(at, "minhash-components")
    least = at.groupBy("component").agg(F.min("first_id").alias("least_id"))
    found = at.join(least, "component").select(*SAME, "least_id")
    rows_ = signed.select("id", *SAME)
    # rows without a class go past the join: there may be many of them, all of one key
    named = rows_.filter(classed).join(found, SAME).select("id", "n", "least_id").unionByName(rows_.filter(~classed).select("id", "n", F.col("id").alias("least_id")))
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least_id").alias("component_id"), F.col("id").eqNullSafe(F.col("least_id")).alias("kept"))


def _across(hot: DataFrame, edges: DataFrame | None, parts: DataFrame, links, block: int, deals: int) -> DataFrame:
    """Components once lists of more than one chunk, rows ``rep, n, place, gram, m, most`` of ``hot``, are compared whole.

    As in ``ngram_join``, but lists that are done stay so and each deal's rows are stored.
    """
    turn, before = 0, None
    while True:
        turn += 1
        named = hot.join(parts, F.col("rep") == F.col("id"), "left").select(*hot.columns, F.coalesce("component", "rep").alias("part"))
        named = stored(named, "minhash-named")
        each = named.groupBy("gram", "part").agg(F.count("*").alias("c"))
        lists = each.groupBy("gram").agg(F.max(F.struct("c", "part")).alias("main"), F.sum("c").alias("all"))
        lists = stored(lists.select("gram", F.col("main.part").alias("main"), (F.col("all") - F.col("main.c")).alias("outside")).filter("outside > 0"), "minhash-open")
        left = lists.agg(F.sum("outside")).first()[0] or 0
        if not left:
            return parts
        if turn > deals or (before is not None and 2 * left > before):
            return extended_components(parts, links(_blocks(named.join(lists, "gram"), block), parts))
        before, open_ = left, named.join(lists.select("gram"), "gram", "left_semi")
        found = links(_dealt(open_, turn, block, "part", _most_linked(open_, edges, block // 4)), parts)
        parts, edges, hot = extended_components(parts, found), edges.unionByName(found), open_.drop("part")
