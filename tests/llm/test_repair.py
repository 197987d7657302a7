"""Repairs against brute force: all short edit sequences, cuts at every few turns, nulls, ties and repeats."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from cadenza.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, thread string, at int, audit string, n int"
GRAMMAR = re.compile(r"(s?(ua)+)?")
BLANK = hashlib.sha256(b"").hexdigest()


def brute(turns):
    """Least (cost, audit, lines) of rows (role, text, fault), over all edits with up to two inserts in a row."""
    inserts = [c for n in range(3) for c in itertools.product(["user", "assistant"], repeat=n)]
    best = None
    ways = [(0, "", ())]
    for role, text, fault in turns:
        edits = [("D", 4, ())]
        if fault in ("", "t"):
            extra = 3 * (fault == "t")
            edits += [("K", extra, ((role, text),))] if role else []
            edits += [("R", 3 + extra, ((r, text),)) for r in ("user", "assistant")]
        ways = [(c + 3 * len(i) + e[1], a + "I" * len(i) + e[0], z + tuple((r, "") for r in i) + e[2]) for c, a, z in ways for i in inserts for e in edits]
    for c, a, z in ways:
        for i in inserts:
            lines = z + tuple((r, "") for r in i)
            if GRAMMAR.fullmatch("".join(r[0] for r, _ in lines)):
                best = min(best or (10**9,), (c + 3 * len(i), a + "I" * len(i), lines))
    return best


def test_search_equals_all_edits():
    rng = random.Random(2)
    for _ in range(150):
        turns = [(rng.choice(["system", "user", "assistant", "tool", ""]), f"t{i}", rng.choice(["", "", "t", "b", "d"])) for i in range(rng.randint(0, 3))]
        ((state, found),) = repair.cheapest(tuple((r[:1], f, 1) for r, _, f in turns), 0, True).items()
        assert state in (0, 3) and found == brute(turns)[:2]


def faults(rows):
    """(role, text, fault) of (turn, role, text) in order; ties by role and digest."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append((role, text, "b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t"))
        seen.add((role, text))
    return out


def walked(turns):
    """Least (cost, audit, lines) by going forward over the four states."""
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    insert = lambda s: ("assistant" if s == 2 else "user")
    at = {0: (0, "", ())}

    def grown(at):
        for _ in range(3):
            for s, (c, a, z) in list(at.items()):
                to = steps[s, insert(s)[0]]
                at[to] = min(at.get(to, (10**9,)), (c + 3, a + "I", (*z, (insert(s), ""))))
        return at

    for role, text, fault in turns:
        new = {}
        for s, (c, a, z) in grown(at).items():
            options = [(s, (c + 4, a + "D", z))]
            if fault in ("", "t"):
                extra = 3 * (fault == "t")
                options.append((steps[s, insert(s)[0]], (c + 3 + extra, a + "R", (*z, (insert(s), text)))))
                if (s, role[:1]) in steps:
                    options.append((steps[s, role[0]], (c + extra, a + "K", (*z, (role, text)))))
            for to, way in options:
                new[to] = min(new.get(to, (10**9,)), way)
        at = new
    return min(way for s, way in grown(at).items() if s in (0, 3))


def summary(rows):
    turns = faults(rows)
    cost, audit, lines = walked(turns)
    known = [t for t, *_ in rows if t is not None]
    count = lambda f: sum(x == f for *_, x in turns)
    letters = [r[:1] for r, *_ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(letters))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()
    return gaps, count("b"), count("d"), count("t"), illegal, cost, audit, digest


def conversations(rng):
    texts = ["Yes.", "No!", "why", "", " \t", None, "Long. text \n", "end. ", "Fine?  \r\n"]
    out = {None: [(0, "user", "Hello."), (1, "assistant", "Hi.")], 100: [(None, None, None)], 101: [(0, "user", "Same.")] * 7, 102: [(5, "", "No role."), (9, "assistant", "A.")], 103: [(i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(60)]}
    for c in range(40):
        turns = sorted(rng.sample(range(30), rng.randint(1, 14)))
        out[c] = [(t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), rng.choice(texts)) for t in turns]
        if c % 5 == 0:
            out[c].insert(0, (None, "system", "Null turn."))
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_repairs_equal_brute_force(spark, block):
    every = conversations(random.Random(block))
    rows = [(c, *t, "x", 1, "y", 2) for c, turns in every.items() for t in turns]
    random.Random(1).shuffle(rows)
    found, repaired = repair.repairs(spark.createDataFrame(rows, SCHEMA), block=block)
    digests = {r.thread: r.sha256 for r in repair.digests(repaired).collect()}
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.thread, BLANK)) for r in found.collect()}
    assert got == {c: summary(turns) for c, turns in every.items()}


def test_empty_tables(spark):
    found, repaired = repair.repairs(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and repair.digests(repaired).count() == 0


def test_turns_of_one_number_are_in_order_of_role(spark):
    rows = [(1, 0, "user", "B."), (1, 0, "assistant", "A."), (1, 0, "user", "B.")]
    found, _ = repair.repairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [(r.audit, r.duplicate, r.illegal) for r in found.collect()] == [("IKKDI", 1, 1)]


def test_query_damages_and_repairs(spark, tmp_path):
    rng = random.Random(9)
    every = {c: [(t, rng.choice(["user", "assistant", None]), rng.choice(["One. Two", "Three!", "Four. Five?", None])) for t in range(rng.randint(1, 9))] for c in range(60)}
    every[None] = [(None, "user", "Null id."), (2, "assistant", "Second.")]
    drop = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    every[7] = [(drop, "user", "Dropped alone.")]
    rows = [(c, *t, "x", 1, "y", 2) for c, turns in every.items() for t in turns]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_repair(spark, str(tmp_path)).collect()}
    assert got[7] == (0, 0, 0, 0, 0, 0, "", BLANK)
    for c, turns in every.items():
        hurt = []
        for t, role, text in turns:
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if h:
                row = (t, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
                hurt += [row] * (2 if h == 3 else 1)
        if hurt:
            assert got[c] == summary(hurt), c
