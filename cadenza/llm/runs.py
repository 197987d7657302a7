"""Periodic runs of words in whole texts, by Karp-Miller-Rosenberg naming.

Words get integer names, equal within a document where the words are equal. Level k names the blocks
of 2**k words: a pair of names of the level below gets the name that its rank among the distinct pairs
gives. A block that occurs once in its document needs no name, nor do longer blocks that begin there, so levels
shrink fast in prose and end when nothing is repeated. The longest common extension of two places
goes down the levels once.

A run of period q and length 4 q or more has blocks of q words, begun on the grid of multiples of q, that equal
the next ones; two names that overlap stand for such a block. Only grid places where both equal those q
words on are extended, to both sides, and of neighbouring ones only the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, lean

_WORDS = re.compile(WORD)
#: Characters of text named at once (a single longer text is one piece), which bounds temporaries.
PIECE = 1 << 19
RUNS = "array<struct<start:long,length:long,period:long>>"


def block_names(names: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
    """Names of blocks of 1, 2, 4, ... words at every place, while any is repeated.

    ``names`` has the words', equal only where words of one document are; ``room`` the words left in the
    document. Blocks that are not repeated, or leave the document, have negative names, all different.
    One more place stands behind the last.
    """
    n = len(names)
    places = np.arange(n)
    keys, levels = names.astype(np.int64), []
    while True:
        _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        if not again.any():
            return levels
        level = -1 - np.arange(n + 1)
        level[places[again]] = inverse[again]
        width = 1 << len(levels)
        levels.append(level)
        places = places[again]
        places = places[room[places] >= 2 * width]
        places = places[level[places + width] >= 0]
        keys = level[places] * np.int64(n + 1) + level[places + width]


def extended(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from ``i`` and from ``j`` on are equal, or before them with ``back``."""
    total = np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        level, width = levels[k], 1 << k
        if back:
            a, b = i - total - width, j - total - width
        else:
            a, b = i + total, j + total
        total += np.where((a >= 0) & (level[a] == level[b]), width, 0)
    return total


def _grid(starts: np.ndarray, sizes: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, period and whether it is the first of its (document, period), for periods from ``low`` to below twice that."""
    fits = sizes >= 4 * low
    starts, sizes = starts[fits], sizes[fits]
    periods = np.minimum(2 * low - 1, sizes // 4) - low + 1
    owner = np.repeat(np.arange(len(sizes)), periods)
    q = low + np.arange(len(owner)) - np.repeat(np.cumsum(periods) - periods, periods)
    points = sizes[owner] // q - 1
    pair = np.repeat(np.arange(len(owner)), points)
    step = np.arange(len(pair)) - np.repeat(np.cumsum(points) - points, points)
    q = q[pair]
    return starts[owner][pair] + step * q, q, step == 0


def find_runs(texts: list[list[str]], least: int = 6) -> list[np.ndarray]:
    """For each list of words the rows ``start, length, period`` of its runs, by start and period.

    A run is a longest stretch in which words ``period`` apart are equal, for the smallest such period;
    it has at least ``least`` words and four periods.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    if not n:
        return [np.zeros((0, 3), np.int64) for _ in texts]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    words = pa.array([w for t in texts for w in t], pa.large_string()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    levels = block_names(owner * np.int64(n) + words, ends[owner] - np.arange(n))
    found = [np.zeros((0, 4), np.int64)]
    for k, level in enumerate(levels):
        some = np.zeros(len(texts), bool)
        some[owner[level[:n] >= 0]] = True
        at, q, first = _grid(starts[some], sizes[some], 1 << k)
        tail = at + q - (1 << k)  # two names that overlap stand for a block of q words
        same = (level[at] == level[at + q]) & (level[tail] == level[tail + q])
        new = same.copy()
        new[1:] &= ~same[:-1] | first[1:]
        at, q = at[new], q[new]
        before = extended(levels, at, at + q, back=True)
        length = before + extended(levels, at, at + q) + q
        long = length >= np.maximum(least, 4 * q)
        found.append(np.stack([owner[at], at - before, length, q], 1)[long])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1]))]
    # a stretch with several periods shows once for each; all are multiples of the smallest
    kept = np.ones(len(rows), bool)
    kept[1:] = (rows[1:, 1] != rows[:-1, 1]) | (rows[1:, 2] != rows[:-1, 2])
    rows = rows[kept]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1]))]
    rows[:, 1] -= starts[rows[:, 0]]
    return [rows[a:b, 1:] for a, b in zip(*(np.searchsorted(rows[:, 0], np.arange(len(texts)) + x) for x in (0, 1)), strict=True)]


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """Words joined by one space, without those that a run has after its first period."""
    if not len(runs):
        return " ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0)])


def _parts(column) -> Iterator[list[list[str]]]:
    held, size = [], 0
    for text in column:
        text = text.as_py() or ""
        held.append(_WORDS.findall(text))
        size += len(text)
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _run_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        for batch in batches:
            at = 0
            for texts in _parts(batch.column(1)):
                found = find_runs(texts, least)
                flat = np.concatenate(found)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(kind))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
                text = pa.array([collapsed(t, f) for t, f in zip(texts, found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(offsets, rows), text], ["id", "runs", "collapsed"])
                at += len(texts)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6) -> DataFrame:
    """``id_col, runs, collapsed`` for every row of ``docs``.

    ``runs`` are ``start, length, period`` in words, by start and period, of the stretches as in
    ``find_runs``; ``collapsed`` is the text with each run cut to its first period, words joined by one
    space. Words are what separators part; null and empty texts have none, no runs and an empty result.
    Each row is judged alone: null and repeated ids are fine, other columns are ignored, and no rows give
    no rows. A text is held whole in its task, with a few arrays of its number of words.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = rows.mapInArrow(lean(_run_rows(least)), f"id {rows.schema['id'].dataType.simpleString()}, runs {RUNS}, collapsed string")
    return found.withColumnRenamed("id", id_col)
