"""Files and manifests: scans, paths, provenance, metadata, splits and their CSV sink."""

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import audio

SPLITS = ("train", "val", "test")


def scan_files(spark: SparkSession, root: str, ext: str) -> DataFrame:
    """``path`` of every file below ``root`` whose name ends with ``ext``, in order of the lower-cased path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ext}").load(root).select("path")
    return in_path_order(found)


def in_path_order(files: DataFrame) -> DataFrame:
    """Rows in order of the lower-cased ``path``, then of the path."""
    return files.orderBy(F.lower("path"), "path")


def with_suffix(files: DataFrame, ext: str) -> DataFrame:
    """Rows whose ``path`` ends with ``ext``; a longer name that ends so counts as well."""
    return files.filter(F.endswith("path", F.lit(ext)))


def wav_info(files: DataFrame) -> DataFrame:
    """``path, duration, sample_rate`` from the headers of ``files(path)``, of which no more is read; unreadable ones have nulls."""
    return audio.headers(files).select("path", "duration", "sample_rate")


def wav_samples(files: DataFrame) -> DataFrame:
    """``path, channel, t, x`` of WAV files ``(path)``, as in ``audio.samples``: whole, or by ``offset`` and ``duration``."""
    return audio.samples(files)


def read_manifests(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Rows of CSV manifests as ``source_idx, manifest``, the wanted ``columns`` and ``meta``, all strings.

    Manifests may have different columns: a wanted one that lacks is null, the rest goes to ``meta``.
    """
    parts = []
    for i, path in enumerate(paths):
        rows = spark.read.option("header", True).csv(path)
        extra = [c for c in rows.columns if c not in columns]
        wanted = [(F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in columns]
        parts.append(rows.select(F.lit(i).alias("source_idx"), F.lit(path).alias("manifest"), *wanted, meta_map(extra).alias("meta")))
    return united(parts)


def meta_map(columns: list[str]) -> Column:
    """Map of the remaining columns, as text; null where there are none."""
    if not columns:
        return F.lit(None).cast("map<string,string>")
    return F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])


def united(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, repeats included; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def home_expanded(path: Column) -> Column:
    """A leading ``~`` becomes the home folder."""
    return F.when((path == "~") | path.startswith("~/"), F.concat(F.lit(os.path.expanduser("~")), F.substring(path, 2, 1 << 30))).otherwise(path)


def sibling(path: Column, stem: Column) -> Column:
    """The path with another file name, in the same folder and with the same last suffix."""
    folder, suffix = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)
    return F.concat(folder, stem, suffix)


def with_all_siblings(rows: DataFrame, files: DataFrame, stems: list[str]) -> DataFrame:
    """``rows(path)`` with a column for each sibling; rows of which one is not in ``files(path)`` go."""
    for s in stems:
        there = files.select(F.col("path").alias(s)).distinct()
        rows = rows.withColumn(s, sibling(F.col("path"), F.lit(s))).join(there, s, "left_semi")
    return rows


def existing(rows: DataFrame, files: DataFrame, columns: dict[str, str], strict: bool) -> DataFrame:
    """Rows by files that exist, with ``min_duration``; ``columns`` maps path columns to none other than themselves or names.

    ``files(path, duration)``: null for a file that cannot be read. Strict: every path must exist and
    every duration be known. Lenient: one will do, and unknown durations do not count. Of a path that ``files``
    repeats the smallest known duration counts.
    """
    files = files.groupBy("path").agg(F.min("duration").alias("duration"))
    for c in columns:
        there = files.select(F.col("path").alias(c), F.lit(True).alias(f"_{c}_file"), F.col("duration").alias(f"_{c}_s"))
        rows = rows.join(there, c, "left")
    found = [F.coalesce(F.col(f"_{c}_file"), F.lit(False)) for c in columns]
    known = F.array_compact(F.array(*[F.col(f"_{c}_s") for c in columns]))
    ok = reduce(lambda a, b: a & b, found) & (F.size(known) == len(columns)) if strict else reduce(lambda a, b: a | b, found)
    rows = rows.filter(ok).withColumn("min_duration", F.array_min(known)).filter("min_duration > 0")
    return rows.drop(*[x for c in columns for x in (f"_{c}_file", f"_{c}_s")])


def named_split(value: Column, allowed: tuple[str, ...] = SPLITS) -> Column:
    """A split given by an expression; any other name raises."""
    return F.when(value.isin(*allowed), value).otherwise(F.raise_error(F.concat(F.lit("not a split: "), F.coalesce(value, F.lit("null")))).cast("string"))


def drum_class(name: Column) -> Column:
    """Class of a folder by its name; null for hidden ones."""
    low = F.lower(name)
    return F.when(name.startswith("."), None).when(low.contains("drum"), "drums").when(low.contains("percussion"), "percussion").otherwise("other")


def write_split(rows: DataFrame, path: str, attributes: dict[str, Column], valid: Column | None = None) -> None:
    """A folder of CSV with a header for each split; attributes are expressions over ``rows``.

    Rows whose ``valid`` is not true are left out, after the split was made. ``rows`` are worked out once, into a
    table beside the folders, and each split is read from it.
    """
    kept = (rows if valid is None else rows.filter(valid)).filter(F.col("split").isin(*SPLITS))
    made = kept.select("split", *[c.alias(f"_{i}") for i, c in enumerate(attributes.values())])
    made.write.mode("overwrite").partitionBy("split").parquet(f"{path}/.rows")
    back = rows.sparkSession.read.schema(made.schema).parquet(f"{path}/.rows")
    for s in SPLITS:
        back.filter(F.col("split") == s).select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(attributes)]).write.mode("overwrite").option("header", True).csv(f"{path}/{s}.csv")


def repeated(rows: DataFrame, times: int, name: str = "epoch") -> DataFrame:
    """Every row ``times`` times, numbered from 0; rows stay where they are."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
