"""Exact dedup over an extendible-hash index kept in shared files. DataFrame operations only.

1. One pass over the texts writes an entry for each document: 64-bit hash, length and SHA-256 of
   the normalised text. Texts do not move.
2. Directory: starting from one bucket, an overfull bucket splits by one more leading bit of the
   hash; when its depth is the directory's depth, the directory doubles. The driver sees only
   counts for at most ``2**max_depth`` hash prefixes. ``capacity`` grows with the entries, so that the
   directory stays within that; a bucket that is still overfull, as that of a hot text, keeps its
   overflow, nothing is cut.
3. Entries go to buckets by way of the directory. Entries of one text are first combined under a
   salt, in part before they move, so a text with a third of all rows comes to its owner as a few.
4. Owner tasks take ranges of buckets. Within a bucket, entries of one hash lie next to each other
   as a chain, are told apart by length and SHA-256 and make the groups. The index goes to the
   shared folder.
5. Bytes are compared for every group of more than one document, under its bucket: smallest and
   largest text of the group (combined before the shuffle) must be the same bytes. A group that
   fails, which takes a collision of the digest, is grouped again by the text itself.
6. Every document is looked up in the index by bucket and key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import folded, free_name, small_enough, stored

KEY = ["_h", "_len", "_sha"]
#: Rows that one text may have left when it comes to its owner, and owner tasks at most.
SALTS, OWNERS = 32, 4096


def split_directory(counts: dict[int, int], capacity: int, max_depth: int) -> tuple[int, list[int]]:
    """Depth of the directory, and for each of its cells the number of the bucket it points to.

    ``counts`` has the entries for each ``max_depth``-bit prefix. Buckets are numbered in order of
    the hash, so that ranges of buckets are ranges of keys.
    """
    totals = [counts.get(i, 0) for i in range(1 << max_depth)]
    sums = [0]
    for c in totals:
        sums.append(sums[-1] + c)
    depth, todo, leaves = 0, [(0, 0)], []
    while todo:
        prefix, d = todo.pop()
        lo, hi = prefix << (max_depth - d), (prefix + 1) << (max_depth - d)
        if sums[hi] - sums[lo] <= capacity or d == max_depth:
            leaves.append((lo, hi))
            continue
        depth = max(depth, d + 1)  # the directory doubles when a bucket at its own depth splits
        todo += [(2 * prefix, d + 1), (2 * prefix + 1, d + 1)]
    width = 1 << (max_depth - depth)
    cells: list[int] = []
    for number, (lo, hi) in enumerate(sorted(leaves)):
        cells += [number] * ((hi - lo) // width)
    return depth, cells


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    max_depth: int = 16,
    broadcast_rows: int = 500_000,
    digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256),
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` became one space; a null
    text is empty, and empty texts are equal to each other. The smallest id of a group stays; a
    null id is larger than any other, and a group of null ids only has a null ``keep_id`` and keeps
    all its rows. Rows that repeat an id all carry the group's result, so each repeat of the
    smallest id is kept. Other columns are ignored and may have any name. No rows give no rows.
    ``digest`` is replaced in tests only, to bring about collisions.
    """
    text = folded(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_norm"))
    entries = stored(rows.select("_id", F.xxhash64("_norm").alias("_h"), F.octet_length("_norm").cast("long").alias("_len"), digest(F.col("_norm")).alias("_sha"), F.sha2("_norm", 256).alias("_out")), "dedup-entries")
    prefix = F.shiftrightunsigned(F.col("_h"), 64 - max_depth).cast("int")
    counts = {r[0]: r[1] for r in entries.groupBy(prefix).count().collect()}
    capacity = max(capacity, sum(counts.values()) >> (max_depth - 2))
    depth, cells = split_directory(counts, capacity, max_depth)
    listed = docs.sparkSession.range(1, numPartitions=1).select(F.from_json(F.lit(str(cells)), "array<int>").alias("cells"))
    directory = stored(listed.select(F.posexplode("cells").alias("_cell", "_bucket")), "dedup-directory")

    def dealt(df: DataFrame) -> DataFrame:
        cell = F.shiftrightunsigned(F.col("_h"), 64 - depth).cast("int") if depth else F.lit(0)
        return df.withColumn("_cell", cell).join(F.broadcast(directory), "_cell").drop("_cell")

    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS))
    parts = dealt(entries).groupBy("_bucket", *KEY, salt.alias("_salt")).agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
    # the owners' grouping needs no exchange of its own: buckets are whole in a range
    owned = parts.repartitionByRange(max(1, min(max(cells) + 1, OWNERS)), "_bucket")
    index = owned.groupBy("_bucket", *KEY).agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    index = stored(index.sortWithinPartitions("_bucket", *KEY), "dedup-index")
    bad = stored(_unequal(rows, index, broadcast_rows, digest, dealt), "dedup-collisions")
    result = dealt(entries).join(index, ["_bucket", *KEY]).drop("_bucket")
    if not bad.isEmpty():
        result = _split_by_text(rows, result, bad, digest)
    return result.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("_out").alias("text_sha256"),
    )


def _unequal(rows: DataFrame, index: DataFrame, broadcast_rows: int, digest, dealt) -> DataFrame:
    """Keys of classes whose texts are not all the same bytes."""
    hashes = index.filter("group_size > 1").select("_h").distinct()
    if small_enough(hashes, broadcast_rows):
        hashes = F.broadcast(hashes)
    texts = rows.withColumn("_h", F.xxhash64("_norm")).join(hashes, "_h", "left_semi")
    texts = texts.select("_h", F.octet_length("_norm").cast("long").alias("_len"), digest(F.col("_norm")).alias("_sha"), "_norm")
    return dealt(texts).groupBy("_bucket", *KEY).agg(F.min("_norm").alias("lo"), F.max("_norm").alias("hi")).filter("lo <> hi").select(*KEY)


def _split_by_text(rows: DataFrame, result: DataFrame, bad: DataFrame, digest) -> DataFrame:
    """Group the rows of the keys in ``bad`` by the text itself."""
    texts = rows.select("_id", "_norm", F.xxhash64("_norm").alias("_h"), F.octet_length("_norm").cast("long").alias("_len"), digest(F.col("_norm")).alias("_sha"), F.sha2("_norm", 256).alias("_out"))
    texts = texts.join(bad, KEY, "left_semi")
    again = texts.groupBy(F.col("_norm").alias("_text")).agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
    mended = texts.join(again, F.col("_norm") == F.col("_text")).select(*KEY, "_id", "_out", "keep_id", "group_size")
    return result.join(bad, KEY, "left_anti").select(*KEY, "_id", "_out", "keep_id", "group_size").unionByName(mended)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """``docs`` without the rows that repeat an earlier text; columns unchanged.

    One row is left for each text, the one of smallest id, null ids last. Of rows that are equal in
    id and text, the first by all columns stays. An id says which row stays only if it is not null
    and not repeated; rows of other ids, few as a rule, are told apart by text as well.
    """
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    name = free_name(docs, "_keep")
    keep = F.col(name)
    found = exact_dedup(docs, id_col, text_col, broadcast_rows=broadcast_rows).select(id_.alias(name), "kept", F.col("text_sha256").alias("_sha"))
    ids = found.groupBy(name).agg(F.count("*").alias("n"), F.count_if("kept").alias("k")).filter("k > 0")
    once = ids.filter((F.col("n") == 1) & keep.isNotNull()).select(name)
    plain = docs.join(once, id_ == keep, "left_semi")
    again = stored(ids.filter((F.col("n") > 1) | keep.isNull()).select(name), "dedup-repeated-ids")
    if again.isEmpty():
        return plain
    repeated = again.filter(keep.isNotNull())
    if small_enough(repeated, broadcast_rows):
        repeated = F.broadcast(repeated)
    rows = docs.filter(id_.isNull()).unionByName(docs.join(repeated, id_ == keep, "left_semi"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # repeats are combined before the shuffle, so that a group of them is one row for each task
    rows = rows.groupBy(id_.alias("_id"), F.sha2(folded(text), 256).alias("_sha")).agg(F.min_by(row, F.to_json(row)).alias("_row"))
    kept = found.filter("kept").select(name, F.col("_sha").alias("_text")).distinct()
    rows = rows.join(kept, (F.col("_sha") == F.col("_text")) & F.col("_id").eqNullSafe(keep), "left_semi")
    return plain.unionByName(rows.select("_row.*"))
