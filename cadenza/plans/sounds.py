"""Registered queries of files that are written from the tables and read back, beside their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import files
from ..sources import audio
from ..sources.shared import shared_path
from ..sources.tables import load, signals
from .catalogue import SIGNALS, query

RATE = 100


def _written(spark, sf_dir, bits: int):
    """The folder of a file for each user's events, and its ``path, frames``."""
    folder = shared_path(spark, "wav")
    rows = signals(spark, sf_dir).select(F.col("signal_id").alias("name"), "t", (F.col("x") / 1000).alias("x"))
    return folder, audio.write_wav(rows, folder, RATE, bits)


def _name(path):
    return F.regexp_extract(path, r"([^/]*)\.wav$", 1).cast("long").alias("signal_id")


def _value(bits: int) -> str:
    return f"least(greatest(round_even(x / 1000 * {2 ** (bits - 1)}, 0), -{2 ** (bits - 1)}), {2 ** (bits - 1) - 1}) / {2 ** (bits - 1)}.0::DOUBLE"


@query(f"WITH {SIGNALS} SELECT signal_id, count(*) / {RATE}.0::DOUBLE AS duration, {RATE} AS sample_rate, 1 AS channels, 24 AS bits, 'int' AS encoding, count(*) AS frames FROM sg GROUP BY 1")
def wav_headers(spark, sf_dir):
    _, made = _written(spark, sf_dir, 24)
    return audio.headers(made).select(_name("path"), "duration", "sample_rate", "channels", "bits", "encoding", "frames")


@query(f"WITH {SIGNALS} SELECT signal_id, t::BIGINT AS t, round({_value(16)}, 9) AS x FROM sg")
def wav_folder(spark, sf_dir):
    """A folder by the data source, in ranges of 64 bytes."""
    folder, _ = _written(spark, sf_dir, 16)
    return audio.read_wav(spark, folder, splitBytes="64").select(_name("path"), "t", F.round("x", 9).alias("x"))


@query(f"WITH {SIGNALS}, e AS (SELECT *, signal_id % 40 AS a, signal_id % 30 AS n FROM sg) SELECT signal_id, (t - a)::BIGINT AS t, round({_value(24)}, 9) AS x FROM e WHERE t >= a AND t < a + n")
def wav_excerpts(spark, sf_dir):
    """An excerpt of each file, by offset and duration of its own."""
    _, made = _written(spark, sf_dir, 24)
    i = F.regexp_extract("path", r"([^/]*)\.wav$", 1).cast("long")
    # half a frame more, so that the product with the rate is cut to the frame that is meant
    asked = made.select("path", ((i % 40 + 0.5) / RATE).alias("offset"), ((i % 30 + 0.5) / RATE).alias("duration"))
    return audio.samples(asked).select(_name("path"), "t", F.round("x", 9).alias("x"))


@query("SELECT s.split, doc_id::VARCHAR AS doc_id, n_chars::VARCHAR AS n_chars, source FROM (SELECT *, ['train', 'val', 'test'][1 + doc_id % 3] AS split FROM documents WHERE n_chars > 200) s")
def manifest_round_trip(spark, sf_dir):
    """Splits written as CSV manifests, the short texts left out, and read again with their metadata."""
    d = load(spark, sf_dir, "documents")
    split = F.element_at(F.array(*map(F.lit, files.SPLITS)), (F.col("doc_id") % 3 + 1).cast("int"))
    folder = shared_path(spark, "manifests")
    files.write_split(d.withColumn("split", split), folder, {"doc_id": F.col("doc_id"), "n_chars": F.col("n_chars"), "source": F.col("source")}, F.col("n_chars") > 200)
    back = files.read_manifests(spark, [f"{folder}/{s}.csv" for s in files.SPLITS], ["doc_id"])
    name = F.element_at(F.array(*map(F.lit, files.SPLITS)), F.col("source_idx") + 1)
    return back.select(name.alias("split"), "doc_id", F.col("meta")["n_chars"].alias("n_chars"), F.col("meta")["source"].alias("source"))
