"""WAV files as tables: headers of a few bytes, samples by ranges of frames, and a sink.

Files are opened through ``pyarrow.fs``, so paths may be local, ``file:`` or URIs of the stores that it knows; a
path has to mean the same file to all tasks. Nothing but headers and the wanted ranges is read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that a header probe reads first; chunks beyond cost eight bytes each.
HEAD = 2048
#: Partitions of a folder that the data source plans at most.
TASKS = 1024
#: Frames of a range that one row of work stands for.
RANGE = 1 << 20
HEADERS = "path string, duration double, sample_rate int, channels int, bits int, encoding string, frames long"
SAMPLES = "path string, channel int, t long, x double"


class Layout(NamedTuple):
    """What a header says: encoding "int" or "float", and where the samples lie."""

    encoding: str
    channels: int
    rate: int
    bits: int
    data_at: int
    frames: int

    @property
    def frame_bytes(self) -> int:
        return self.channels * self.bits // 8


def opened(path: str) -> tuple[fs.FileSystem, str]:
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else path
    return fs.FileSystem.from_uri(path)


def layout(read, size: int) -> Layout | None:
    """Layout of a WAV file of ``size`` bytes, by ``read(at, count)``; None for what is not one, or has no samples' chunk."""
    head = read(0, min(HEAD, size))
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= size:
        piece = head[at : at + 8] if at + 8 <= len(head) else read(at, 8)
        name, length = piece[:4], struct.unpack("<I", piece[4:])[0]
        if name == b"fmt ":
            form = head[at + 8 : at + 8 + length] if at + 8 + length <= len(head) else read(at + 8, length)
        elif name == b"data":
            if form is None or len(form) < 16:
                return None
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
            if code == 0xFFFE and len(form) >= 26:  # extensible: the code proper begins the sub-format
                code = struct.unpack("<H", form[24:26])[0]
            encoding = {1: "int", 3: "float"}.get(code, f"code {code}")
            if not channels or not rate or not bits or bits % 8:
                return None
            # a length of a writer that did not finish, or beyond the file's end, counts to the end
            length = min(length or size, size - at - 8)
            return Layout(encoding, channels, rate, bits, at + 8, length // (channels * bits // 8))
        at += 8 + length + length % 2
    return None


def decoded(raw: bytes, of: Layout) -> np.ndarray:
    """Samples in [-1, 1), a row a frame, of integers of 8 (unsigned), 16, 24 or 32 bits or floats of 32 or 64."""
    if of.encoding == "float" and of.bits in (32, 64):
        x = np.frombuffer(raw, f"<f{of.bits // 8}").astype(float)
    elif of.encoding == "int" and of.bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif of.encoding == "int" and of.bits == 24:
        three = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((three[:, 0] << 8) | (three[:, 1] << 16) | (three[:, 2] << 24)) / 2.0**31
    elif of.encoding == "int" and of.bits in (16, 32):
        x = np.frombuffer(raw, f"<i{of.bits // 8}") / 2.0 ** (of.bits - 1)
    else:
        raise ValueError(f"WAV of encoding {of.encoding} with {of.bits} bits cannot be read")
    return x.reshape(-1, of.channels)


def file_layout(path: str) -> Layout | None:
    """Layout of the file; None for one that is missing or no WAV file."""
    store, name = opened(path)
    info = store.get_file_info(name)
    if info.type != fs.FileType.File:
        return None
    with store.open_input_file(name) as f:
        return layout(lambda at, count: f.read_at(count, at), info.size)


def frames_of(path: str, of: Layout, first: int, count: int) -> np.ndarray:
    """Frames from ``first`` on, ``count`` of them or what there is; only their bytes are read."""
    first = min(max(first, 0), of.frames)
    count = max(0, min(count, of.frames - first))
    store, name = opened(path)
    with store.open_input_file(name) as f:
        return decoded(f.read_at(count * of.frame_bytes, of.data_at + first * of.frame_bytes), of)


def header_rows(paths: list[str]) -> pa.RecordBatch:
    found = [file_layout(p) for p in paths]
    cell = lambda f, kind: pa.array([None if x is None else f(x) for x in found], kind)
    columns = [pa.array(paths, pa.string()), cell(lambda x: x.frames / x.rate, pa.float64()), *(cell(f, pa.int32()) for f in (lambda x: x.rate, lambda x: x.channels, lambda x: x.bits)), cell(lambda x: x.encoding, pa.string()), cell(lambda x: x.frames, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["path", "duration", "sample_rate", "channels", "bits", "encoding", "frames"])


def sample_rows(path: str, of: Layout, first: int, count: int, zero: int = 0, piece: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """``path, channel, t, x`` of a range of frames, in batches; ``t`` counts from frame ``zero``."""
    for at in range(first, first + count, piece):
        x = frames_of(path, of, at, min(piece, first + count - at))
        t, channel = np.divmod(np.arange(x.size), of.channels)
        yield pa.RecordBatch.from_arrays([pa.array([path] * x.size, pa.string()), pa.array(channel.astype(np.int32)), pa.array(t + at - zero), pa.array(x.ravel())], ["path", "channel", "t", "x"])
        if len(x) < piece:
            return


def headers(files: DataFrame) -> DataFrame:
    """Columns ``HEADERS`` of ``files(path)``; nulls for files that are missing or no WAV files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield header_rows(batch.column(0).to_pylist())

    return files.select("path").mapInArrow(run, HEADERS)


def samples(files: DataFrame) -> DataFrame:
    """Columns ``SAMPLES`` of ``files(path)``, or of excerpts where they have ``offset`` and ``duration`` in seconds.

    ``t`` counts from the excerpt's start; null stands for the start, or all that follows. Ranges of ``RANGE`` frames are
    dealt to tasks, so a long file is read by many. Files that are no WAV files give no rows; an encoding that
    cannot be read is an error.
    """
    given = [c for c in ("offset", "duration") if c in files.columns]
    asked = files.select("path", *[(F.col(c) if c in given else F.lit(None)).cast("double").alias(f"_{c}") for c in ("offset", "duration")])
    asked = asked.groupBy("path").agg(F.collect_set(F.struct(F.coalesce("_offset", F.lit(0.0)).alias("offset"), F.coalesce("_duration", F.lit(-1.0)).alias("duration"))).alias("of"))
    known = asked.join(headers(files.select("path").distinct()), "path").filter("frames is not null").select("path", "sample_rate", "frames", F.explode("of").alias("of"))
    first = F.least(F.greatest((F.col("of.offset") * F.col("sample_rate")).cast("long"), F.lit(0)), F.col("frames"))
    count = F.when(F.col("of.duration") < 0, F.col("frames")).otherwise((F.col("of.duration") * F.col("sample_rate")).cast("long"))
    ranges = known.select("path", first.alias("zero"), F.least(first + count, "frames").alias("end")).filter("zero < end")
    ranges = ranges.select("path", "zero", "end", F.explode(F.sequence("zero", F.col("end") - 1, F.lit(RANGE).cast("long"))).alias("first"))
    dealt = ranges.select("path", "zero", "first", F.least(F.lit(RANGE), F.col("end") - F.col("first")).alias("count")).repartition("path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, zero, first, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from sample_rows(path, file_layout(path), first, count, zero)

    return dealt.mapInArrow(run, SAMPLES)


class Files(InputPartition):
    """Files, each with the range of bytes whose frames the partition reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.mode = options["path"], options.get("mode", "samples")
        self.offset, self.duration = float(options.get("offset", 0)), options.get("duration")
        self.split = int(options.get("splitBytes", 32 << 20))

    def partitions(self) -> list[InputPartition]:
        """Ranges of about ``splitBytes``, longer where there would be more than ``TASKS``, small files together; by one listing, no file is opened."""
        store, root = opened(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        found = sorted((f for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".wav")), key=lambda f: (f.path.lower(), f.path))
        # a partition but the last has as much as this, so there are no more than TASKS
        split = max(self.split, -(-sum(f.size if self.mode == "samples" else HEAD for f in found) // TASKS))
        out, held, size = [], [], 0
        for f in found:
            for at in range(0, max(1, f.size), split) if self.mode == "samples" else (0,):
                held.append((f.path, at, min(f.size, at + split)))
                size += held[-1][2] - at if self.mode == "samples" else HEAD
                if size >= split:
                    out.append(Files(held))
                    held, size = [], 0
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if self.mode == "headers":
            if partition.ranges:
                yield header_rows([p for p, _, _ in partition.ranges])
            return
        for path, low, high in partition.ranges:
            of = file_layout(path)
            if of is None:
                continue
            zero = min(int(self.offset * of.rate), of.frames)
            end = of.frames if self.duration is None else min(of.frames, zero + int(float(self.duration) * of.rate))
            # the frames that begin within the range of bytes
            a, b = (max(0, -(-(x - of.data_at) // of.frame_bytes)) for x in (low, high))
            first, last = max(zero, a), min(end, b)
            if first < last:
                yield from sample_rows(path, of, first, last - first, zero)


class WavSource(DataSource):
    """``spark.read.format("wav")`` of a folder or file: ``mode`` "samples" or "headers", ``offset`` and ``duration`` in seconds."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return HEADERS if self.options.get("mode") == "headers" else SAMPLES

    def reader(self, schema) -> DataSourceReader:
        return WavReader(self.options)


def read_wav(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(WavSource)
    return spark.read.format("wav").options(**options).load(path)


def write_wav(signals: DataFrame, folder: str, rate: int, bits: int = 16) -> DataFrame:
    """Write a file ``<name>.wav`` of one channel for each signal of ``signals(name, t, x)``; returns ``path, frames`` of them.

    Samples are held to [-1, 1) and rounded half to even, to integers of 16, 24 or 32 bits. A file's samples
    stream through one task in order of ``t``; it gets its name once it is whole, so a task may be repeated.
    """
    if bits not in (16, 24, 32):
        raise ValueError("16, 24 or 32 bits")

    def head(frames: int) -> bytes:
        width = bits // 8
        return b"RIFF" + struct.pack("<I", 36 + frames * width) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * width, width, bits) + b"data" + struct.pack("<I", frames * width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder.rstrip("/"))
        store.create_dir(root, recursive=True)
        out, name, frames, sink, part, total = [], None, 0, None, "", 0

        def close():
            sink.close()
            store.move(part, f"{root}/{name}.wav")
            out.append((f"{folder.rstrip('/')}/{name}.wav", frames))

        for batch in batches:
            names, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            x = batch.column(2).to_numpy(zero_copy_only=False)
            scaled = np.clip(np.rint(np.nan_to_num(x) * 2.0 ** (bits - 1)), -(2.0 ** (bits - 1)), 2.0 ** (bits - 1) - 1).astype("<i4")
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if names[a] != name:
                    if sink is not None:
                        close()
                    name, frames, total = names[a], 0, counts[a]
                    part = f"{root}/.{uuid.uuid4().hex}.part"
                    sink = store.open_output_stream(part)
                    sink.write(head(total))
                raw = scaled[a:b]
                sink.write(raw.astype("<i2").tobytes() if bits == 16 else raw.tobytes() if bits == 32 else raw.view(np.uint8).reshape(-1, 4)[:, :3].tobytes())
                frames += b - a
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], ["path", "frames"])

    rows = signals.select(F.col("name").cast("string").alias("name"), "t", "x")
    rows = rows.join(rows.groupBy("name").agg(F.count("*").alias("n")), "name")
    made = rows.repartition("name").sortWithinPartitions("name", "t").select("name", "n", "x").mapInArrow(run, "path string, frames long")
    made.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/.files")
    return signals.sparkSession.read.schema(made.schema).parquet(f"{folder.rstrip('/')}/.files")
