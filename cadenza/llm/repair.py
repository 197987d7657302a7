"""Repair of conversation structure by cheapest edits, with Dijkstra on the lattice (turn index, grammar state).

Roles are judged by their first letters, which shall read ``(s?(ua)+)?``. Grammar states are 0 (nothing yet),
1 (after s), 2 (after u) and 3 (after a); 0 and 3 may end. At a turn, the edits are Keep, Rerole, Delete and, before it,
Insert, written K, R, D and I. Nodes leave the queue by (cost, audit), the edits' letters so far, and the first
accepting end node to leave it is the answer. That order serves for ties as well: two audits of one cost that reach one
node differ before either ends, as one would otherwise be the other and more inserts, which cost.

Turns are put in order by range partitioning, so that one conversation may span many tasks. It is cut where the running
number of turns is a multiple of ``block``. A conversation in one piece is solved as above. For the
pieces of others, Dijkstra runs from each of the four states to all of them, without inserts at a piece's end;
per conversation only costs and ranks of audits meet, four numbers by four a piece, to
choose the states at the cuts; edits then follow piece by piece.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, lean, stored

#: Costs of the edits, and of a truncated turn that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The one role that may be inserted, or put in place of another, in each state.
ROLES = {0: "user", 1: "user", 2: "assistant", 3: "user"}
#: Inserts that end a conversation in each state.
ENDS = {0: "", 1: "II", 2: "I", 3: ""}
LEGAL = {"su", "ua", "au"}

EDITS = "array<struct<at:long,sub:int,edit:string,times:long,role:string,row:string>>"
SOLVED = f"thread string, chunk long, cost long, audit string, blank long, duplicate long, truncated long, illegal long, head string, tail string, edits {EDITS}"


@functools.lru_cache(1 << 14)
def cheapest(turns: tuple[tuple[str, str, int], ...], start: int, whole: bool) -> dict[int, tuple[int, str]]:
    """``{state: (cost, audit)}`` of the end nodes that are reached from ``start``.

    ``turns`` are (first letter of the role, fault, copies); faults are b, d (both to be deleted), t and "".
    Copies beyond the first are duplicates, whose D the audit leaves out. ``whole``: the turns are all
    that follow, so the search stops at the first accepting end node. Otherwise it reaches all end nodes,
    without inserts behind the last turn.
    """
    queue, done, ends = [(0, "", 0, start)], set(), {}
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and (not whole or not ENDS[state]):
            ends[state] = (cost, audit)
            if whole:
                break
            continue
        role = ROLES[state]
        turned = STEPS[state, role[0]]
        heapq.heappush(queue, (cost + INSERT, audit + "I", i, turned))
        if i == len(turns):
            continue
        initial, fault, copies = turns[i]
        cost += DELETE * (copies - 1)
        heapq.heappush(queue, (cost + DELETE, audit + "D", i + 1, state))
        if fault in ("", "t"):
            cost += TRUNCATED * (fault == "t")
            heapq.heappush(queue, (cost + REROLE, audit + "R", i + 1, turned))
            if (state, initial) in STEPS:
                heapq.heappush(queue, (cost, audit + "K", i + 1, STEPS[state, initial]))
    return ends


def _turns(rows: list[dict]) -> tuple[tuple[str, str, int], ...]:
    return tuple((r["initial"], r["fault"], r["n"]) for r in rows)


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs and ranks of audits from every state to every state, -1 where there is no way."""
    for batch in batches:
        costs, ranks = [], []
        for rows in batch.column(2).to_pylist():
            costs.append([-1] * 16)
            ranks.append([-1] * 16)
            for start in range(4):
                ends = cheapest(_turns(rows), start, False)
                for rank, end in enumerate(sorted(ends, key=lambda e: ends[e][1])):
                    costs[-1][4 * start + end], ranks[-1][4 * start + end] = ends[end][0], rank
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int64()))], ["thread", "chunk", "costs", "ranks"])


def way_through(pieces: list[tuple[list[int], list[int]]]) -> list[int]:
    """States at the cuts, one more than pieces, of the cheapest way; ties go to the least audit."""
    best, back = {0: (0, 0)}, []  # cost and place of the audit among those of other states
    for costs, ranks in pieces:
        ways = [(best[p][0] + costs[4 * p + s], best[p][1], ranks[4 * p + s], p, s) for p in best for s in range(4) if costs[4 * p + s] >= 0]
        least = {}
        for way in sorted(ways):
            least.setdefault(way[-1], way)
        back.append({s: way[3] for s, way in least.items()})
        places = sorted(least, key=lambda s: least[s][1:3])
        best = {s: (least[s][0], places.index(s)) for s in least}
    states = [min(best, key=lambda s: (best[s][0] + INSERT * len(ENDS[s]), best[s][1]))]
    for came in reversed(back):
        states.append(came[states[-1]])
    return states[::-1]


def _way_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``thread, chunk, entry, exit, last`` from pieces in order of thread and chunk."""
    names = ["thread", "chunk", "entry", "exit", "last"]
    thread, chunks, pieces = None, [], []

    def emit():
        states = way_through(pieces)
        return pa.RecordBatch.from_arrays([pa.array([thread] * len(chunks)), pa.array(chunks, pa.int64()), pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32()), pa.array([c == chunks[-1] for c in chunks])], names)

    for batch in batches:
        for t, chunk, costs, ranks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if t != thread and chunks:
                yield emit()
                chunks, pieces = [], []
            thread = t
            chunks.append(chunk)
            pieces.append((costs, ranks))
    if chunks:
        yield emit()


def _solved_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("thread", pa.string()), ("chunk", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("head", pa.string()), ("tail", pa.string()), ("edits", pa.list_(pa.struct([("at", pa.int64()), ("sub", pa.int32()), ("edit", pa.string()), ("times", pa.int64()), ("role", pa.string()), ("row", pa.string())])))])
    for batch in batches:
        out = [{"thread": t, "chunk": c, **solved(rows, entry, exit_, last)} for t, c, entry, exit_, last, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_pylist(out, schema=kinds)


def solved(rows: list[dict], entry: int, exit_: int | None, last: bool) -> dict:
    """Cost, audit, counts of faults and edits of a piece that is entered and left in given states.

    ``rows`` have ``at, initial, fault, n, row`` in order. Without ``exit_`` they are a whole conversation.
    """
    if exit_ is None:
        ((cost, audit),) = cheapest(_turns(rows), entry, True).values()
    else:
        cost, audit = cheapest(_turns(rows), entry, False)[exit_]
        if last:
            cost, audit = cost + INSERT * len(ENDS[exit_]), audit + ENDS[exit_]
    edits, full, state, i, sub = [], [], entry, 0, 0
    for edit in audit:
        row = rows[min(i, len(rows) - 1)]
        role = ROLES[state] if edit in "IR" else None
        edits.append({"at": row["at"], "sub": sub, "edit": edit, "times": 1, "role": role, "row": None if edit == "I" else row["row"]})
        full.append(edit)
        sub += 1
        if edit != "D":
            state = STEPS[state, role[0] if role else row["initial"]]
        if edit != "I":
            if row["n"] > 1:
                edits.append({"at": row["at"], "sub": sub, "edit": "D", "times": row["n"] - 1, "role": None, "row": row["row"]})
                full.append("D" * (row["n"] - 1))
                sub += 1
            i += 1
            sub = sub if i == len(rows) else 0
    count = lambda faults, n=lambda r: r["n"]: sum(n(r) for r in rows if r["fault"] in faults)
    again = lambda r: r["n"] - 1
    letters = [r["initial"] for r in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(letters, letters[1:], strict=False)) + sum(map(again, rows))
    return {"cost": cost, "audit": "".join(full), "blank": count(["b"]), "duplicate": count(["d"]) + count(["", "t"], again), "truncated": count(["t"], lambda r: 1), "illegal": illegal, "head": letters[0], "tail": letters[-1], "edits": edits}


class Repairs(NamedTuple):
    """``conversations``: ``conv_id, thread, gaps, blank, duplicate, truncated, illegal, cost, audit``, one row each.

    ``repaired``: ``thread, at, sub, edit, role, text``, the turns that are kept, reroled or inserted, in order of
    ``at, sub`` within a thread (a text that stands for ``conv_id``, null included).
    """

    conversations: DataFrame
    repaired: DataFrame


def thread_of(conv_id: Column) -> Column:
    """A text for every id; null has one of its own."""
    return F.when(conv_id.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), conv_id.cast("string")))


def repairs(turns: DataFrame, block: int = 1024) -> Repairs:
    """Cheapest repairs of the conversations of ``turns(conv_id, turn, role, text)``; other columns are ignored.

    Turns are in order of ``turn``, nulls first; those of one turn are in order of role and then of a digest, equal
    ones next to each other. A null role or text counts as one space. The first fault of a turn counts: blank (no
    character but separators), duplicate (role and text of an earlier turn of the conversation) or truncated (the
    last such character is not one of ``.!?``). An empty role has no letter and cannot be kept. ``gaps`` are the turns
    that lack between the smallest and the largest, ``illegal`` the neighbours whose letters are not su, ua or au. Turns
    of a null ``conv_id`` are one conversation. Conversations of no rows, and empty tables, give no rows.

    Equal rows are counted before they are shuffled. One row holds a conversation's audit, a letter a turn.
    """
    bounded_batches(turns.sparkSession)
    one_space = lambda c: F.coalesce(c, F.lit(" "))
    rows = turns.select("conv_id", thread_of(F.col("conv_id")).alias("thread"), F.col("turn").cast("long").alias("turn"), one_space("role").alias("role"), one_space("text").alias("text"))
    said = F.sha2(F.concat(F.length("thread").cast("string"), F.lit(":"), "thread", F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    rows = rows.withColumn("said", said).withColumn("row", F.concat("said", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit("-"))))
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    facts = rows.select("conv_id", "thread", "turn", "role", "said", "row", (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"))
    kinds = facts.groupBy(*facts.columns).agg(F.count("*").alias("n"))
    order = ["thread", "turn", "role", "said"]
    ordered = stored(kinds.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "repair-order")
    again = ordered.groupBy("said").agg(F.min("at").alias("first"), F.count("*").alias("times")).filter("times > 1").select("said", "first")
    fault = F.when(F.col("blank"), "b").when(F.col("first") < F.col("at"), "d").when(~F.col("ended"), "t").otherwise("")
    row = F.struct("at", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"), "n", "row")
    chunks = ordered.join(again, "said", "left").groupBy("thread", F.floor(F.col("at") / block).alias("chunk")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    chunks = stored(chunks, "repair-chunks")

    many = stored(chunks.groupBy("thread").agg(F.count("*").alias("pieces")).filter("pieces > 1").select("thread"), "repair-many")
    pieces = chunks.join(many, "thread", "left_semi").select("thread", "chunk", "rows")
    tables = pieces.mapInArrow(lean(_piece_rows), "thread string, chunk long, costs array<long>, ranks array<long>")
    ways = tables.repartition("thread").sortWithinPartitions("thread", "chunk").mapInArrow(_way_rows, "thread string, chunk long, entry int, exit int, last boolean")
    at = ["thread", "chunk", "entry", "exit", "last", "rows"]
    single = chunks.join(many, "thread", "left_anti").select("thread", "chunk", F.lit(0).alias("entry"), F.lit(None).cast("int").alias("exit"), F.lit(True).alias("last"), "rows")
    done = single.select(*at).unionByName(pieces.join(ways, ["thread", "chunk"]).select(*at)).mapInArrow(lean(_solved_rows), SOLVED)
    done = stored(done, "repair-solved")

    # neighbours across cuts, of conversations that have any
    ends = done.join(many, "thread", "left_semi").select("thread", F.struct("chunk", "head", "tail").alias("e"))
    pairs = ends.groupBy("thread").agg(F.array_sort(F.collect_list("e")).alias("e"))
    cuts = F.zip_with(F.slice("e", 1, F.size("e") - 1), F.slice("e", 2, F.size("e") - 1), lambda a, b: F.concat(a["tail"], b["head"]))
    cuts = pairs.select("thread", F.size(F.filter(cuts, lambda c: ~c.isin(*sorted(LEGAL)))).alias("cut"))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "")
    totals = done.groupBy("thread").agg(*sums, audit.alias("audit")).join(cuts, "thread", "left").withColumn("illegal", F.col("illegal") + F.coalesce("cut", F.lit(0))).drop("cut")
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    conversations = ordered.groupBy("conv_id", "thread").agg(gaps.alias("gaps")).join(totals, "thread")

    edits = done.select("thread", F.explode("edits").alias("e")).select("thread", "e.*").filter("edit <> 'D'")
    texts = rows.select("row", F.col("role").alias("own"), "text").dropDuplicates(["row"])
    stays = edits.filter("edit <> 'I'").join(texts, "row").select("thread", "at", "sub", "edit", F.coalesce("role", "own").alias("role"), "text")
    repaired = stays.unionByName(edits.filter("edit = 'I'").select("thread", "at", "sub", "edit", "role", F.lit("").alias("text")))
    return Repairs(conversations.select("conv_id", "thread", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), repaired)


def digests(repaired: DataFrame) -> DataFrame:
    """``thread, sha256`` (lower-case hex) of the lines ``role:text`` of ``repaired``, joined by newlines.

    A digest is a chain over a conversation's text, so its lines pass through one task; they stream, and none is held.
    """
    lines = repaired.select("thread", "at", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition("thread").sortWithinPartitions("thread", "at", "sub").select("thread", "line")
    return lines.mapInArrow(_digest_rows, T.StructType().add("thread", "string").add("sha256", "string"))


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    thread, chain, out = None, None, []
    emit = lambda: pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.string()) for c in (0, 1)], ["thread", "sha256"])
    for batch in batches:
        for t, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if t != thread:
                if chain is not None:
                    out.append((thread, chain.hexdigest()))
                thread, chain = t, hashlib.sha256()
            else:
                chain.update(b"\n")
            chain.update(line.encode())
        if len(out) > 5000:
            yield emit()
            out.clear()
    if chain is not None:
        out.append((thread, chain.hexdigest()))
    yield emit()
