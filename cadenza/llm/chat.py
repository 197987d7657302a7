"""Preference formatting of chosen and rejected conversations.

The longest common turn prefix of a pair is rendered once, as the prompt; what follows is rendered
as two completions with masks that leave loss on the assistant's words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``pair_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans`` per pair.

    Both inputs have ``pair_id, turn, role, text``. Turns are compared in the order of ``turn`` by
    role and text; the common prefix ends before the first turn that differs or that only one side
    has. Spans are half-open character ranges of a completion that bear loss: text and end mark of
    each assistant turn. A null role is "user", a null text is empty; rows with null ``pair_id`` or
    ``turn`` are void. Of several rows for one turn the smallest (role, text) counts. Sides that are
    equal give two empty completions; a side without turns gives an empty one. Extra columns are
    ignored. No rows give no rows.

    The turns of one conversation are gathered in a row, since the result is their text.
    """

    def turns(side: DataFrame, name: str) -> DataFrame:
        turn = F.struct(F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        one = side.filter("pair_id is not null and turn is not null").groupBy("pair_id", "turn").agg(F.min(turn).alias("t"))
        return one.select("pair_id", F.lit(name).alias("side"), "turn", F.col("t.role").alias("role"), F.col("t.text").alias("text"))

    every = turns(chosen, "c").unionByName(turns(rejected, "r"))
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("turn", "role", "text"))))
    both = every.groupBy("pair_id").agg(of("c").alias("c"), of("r").alias("r"))
    same = F.zip_with("c", "r", lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    broken = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), False)
    common = F.when(broken > 0, broken - 1).otherwise(F.least(F.size("c"), F.size("r"))).cast("int")
    both = both.withColumn("n_common", common)
    text = lambda turns: F.array_join(F.transform(turns, lambda t: _rendered(t["role"], t["text"])), "")
    rest = lambda s: F.slice(s, F.col("n_common") + 1, F.size(s))

    def spans(s: str) -> Column:
        """Walk the turns with the position so far."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(acc: Column, t: Column) -> Column:
            head = F.length(t["role"]) + 5
            end = acc["at"] + head + F.length(t["text"]) + 8
            span = F.struct((acc["at"] + head).alias("start"), (end - 1).alias("end"))
            more = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
            return F.struct(end.alias("at"), more.alias("spans"))

        return F.aggregate(rest(s), start, step, lambda acc: acc["spans"])

    return both.select("pair_id", "n_common", text(F.slice("c", 1, F.col("n_common"))).alias("prompt"), text(rest("c")).alias("chosen"), text(rest("r")).alias("rejected"), spans("c").alias("chosen_spans"), spans("r").alias("rejected_spans"))
