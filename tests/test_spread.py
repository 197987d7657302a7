"""What few rows become is dealt over tasks, and joins of it never broadcast what is large."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from cadenza.operators import bands, blocks
from cadenza.operators import items as it
from cadenza.sources import audio

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["span_mask", "masked_counts", "combine_masks", "span_by_item", "unmask_loop"])
def test_cells_of_a_small_table_are_made_by_many_tasks(spark, name):
    rows = registered.queries()[name](spark, SF_DIR)
    parts = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and sum(r["count"] for r in parts) == rows.count()


@pytest.mark.parametrize("name", ["span_by_item", "unmask_loop", "masks_broadcast"])
def test_cells_are_not_broadcast(spark, name):
    rows = registered.queries()[name](spark, SF_DIR)
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_masks_meet_cells_by_place(spark):
    cells = spark.createDataFrame([(1, k, f, True) for k in range(2) for f in range(5)] + [(2, 0, 0, True)], "item long, codebook int, frame int, keep boolean")
    by_frame = spark.createDataFrame([(1, 0, True), (1, 3, False), (1, 4, None), (2, 0, True)], "item long, frame int, keep boolean")
    by_codebook = spark.createDataFrame([(1, 1, True), (2, 0, False)], "item long, codebook int, keep boolean")
    rows = it.masks_broadcast(cells, by_frame, by_codebook)
    got = {(r.item, r.codebook, r.frame): r.keep for r in rows.collect()}
    assert got == {(1, 1, 0): True, (1, 1, 3): False, (1, 1, 4): None, (2, 0, 0): False}
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_ranges_are_longer_where_there_would_be_too_many(monkeypatch, tmp_path):
    for i in range(50):
        (tmp_path / f"{i}.wav").write_bytes(b"x" * (10 * i))
    monkeypatch.setattr(audio, "TASKS", 20)
    for mode in ("samples", "headers"):
        parts = audio.WavReader({"path": str(tmp_path), "splitBytes": "4", "mode": mode}).partitions()
        ranges = [r for p in parts for r in p.ranges]
        assert len(parts) <= 21 and len({p for p, _, _ in ranges}) == 50
        assert mode == "headers" or sum(high - low for _, low, high in ranges) == sum(10 * i for i in range(50))


def test_noise_of_few_rooms_is_made_by_many_tasks(spark):
    params = spark.range(4).coalesce(1).select(F.col("id").alias("k"), F.lit(0.001).alias("duration"), *[F.array_repeat(F.lit(0.5), 12).alias(c) for c in ("gains", "decays", "attacks")])
    plan = bands.octave_responses(params, ["k"], 44100.0, 1, 31)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [k" in plan[plan.index("Generate explode") :]


@pytest.mark.parametrize("out, batches", [(1, 39), (1 << 22, 1)])
def test_short_rows_go_out_together(spark, monkeypatch, out, batches):
    monkeypatch.setattr(blocks, "OUT", out)
    rows = spark.range(40).coalesce(1)
    made = blocks.each_chunk(rows, ["id"], lambda row: {"n": list(range(row["id"])), "v": [[0.5 * row["id"]] * 2] * row["id"]}, "n long, v array<double>")
    assert sorted((r.id, r.n, tuple(r.v)) for r in made.collect()) == [(i, n, (0.5 * i,) * 2) for i in range(40) for n in range(i)]
    count = made.mapInArrow(lambda it: iter([pa.RecordBatch.from_arrays([pa.array([sum(1 for _ in it)])], ["n"])]), "n long")
    assert count.collect()[0].n <= batches
