"""WAV files of all encodings, by headers, ranges and excerpts; what is read is counted."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import files
from cadenza.sources import audio

RNG = np.random.RandomState(1)


def wav(raw: bytes, code: int, channels: int, bits: int, rate: int = 8000, extra: bytes = b"", extensible: bool = False, length: int | None = None) -> bytes:
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if extensible:
        form += struct.pack("<HHIH", 22, bits, 0, code) + b"\0" * 14
    chunk = lambda name, data, n=None: name + struct.pack("<I", len(data) if n is None else n) + data + b"\0" * (len(data) % 2)
    body = b"WAVE" + extra + chunk(b"fmt ", form) + chunk(b"data", raw, length)
    return b"RIFF" + struct.pack("<I", len(body)) + body


X = np.array([[0.5, -0.25], [0.0, -1.0], [0.75, 0.125], [-0.5, 0.9]])
ENCODED = {
    "u8": wav(((X * 128) + 128).astype(np.uint8).tobytes(), 1, 2, 8),
    "i16": wav((X * 32768).astype("<i2").tobytes(), 1, 2, 16, extra=b"LIST" + struct.pack("<I", 5001) + b"x" * 5002),
    "i24": wav((X * 2**31).astype("<i4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes(), 1, 2, 24, extensible=True),
    "i32": wav((X * 2**31).astype("<i4").tobytes(), 1, 2, 32),
    "f32": wav(X.astype("<f4").tobytes(), 3, 2, 32, length=0),
    "f64": wav(X.astype("<f8").tobytes(), 3, 2, 64, length=2**32 - 1),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("wavs")
    for name, data in ENCODED.items():
        (at / f"{name}.wav").write_bytes(data)
    (at / "sub dir").mkdir()
    (at / "sub dir/broken.wav").write_bytes(b"RIFF no audio")
    (at / "empty.wav").write_bytes(b"")
    (at / "none.wav").write_bytes(wav(b"", 1, 1, 16))
    return at


def paths(spark, folder, *names):
    return spark.createDataFrame([(str(folder / n),) for n in names], "path string")


@pytest.mark.parametrize("name", ENCODED)
def test_every_encoding(spark, folder, name):
    rows = audio.samples(paths(spark, folder, f"{name}.wav")).orderBy("t", "channel").collect()
    got = np.array([r.x for r in rows]).reshape(-1, 2)
    assert got == pytest.approx(X, abs=1 / 100 if name == "u8" else 1 / 20000) and [r.t for r in rows[::2]] == [0, 1, 2, 3]


def test_headers_and_what_is_no_wav(spark, folder):
    names = [*(f"{n}.wav" for n in ENCODED), "empty.wav", "none.wav", "sub dir/broken.wav", "missing.wav"]
    got = {r.path.rsplit("/", 1)[1]: (r.duration, r.channels, r.bits, r.encoding, r.frames) for r in audio.headers(paths(spark, folder, *names)).collect()}
    assert got["i16.wav"] == (4 / 8000, 2, 16, "int", 4) and got["f64.wav"] == (4 / 8000, 2, 64, "float", 4) and got["f32.wav"][4] == 4
    assert got["none.wav"] == (0.0, 1, 16, "int", 0)
    assert all(got[n] == (None,) * 5 for n in ("empty.wav", "broken.wav", "missing.wav"))
    found = files.wav_info(files.scan_files(spark, str(folder), ".wav"))
    assert {r.path.rsplit("/", 1)[1]: r.sample_rate for r in found.collect() if r.sample_rate}.keys() == {*(f"{n}.wav" for n in ENCODED), "none.wav"}


def test_a_header_takes_few_bytes_and_an_excerpt_its_own(monkeypatch, folder):
    data = wav(RNG.bytes(2_000_000), 1, 2, 16, extra=b"LIST" + struct.pack("<I", 100_000) + b"y" * 100_000)
    asked = []
    of = audio.layout(lambda at, n: asked.append(n) or data[at : at + n], len(data))
    assert sum(asked) < 4096 and of.frames == 500_000
    (folder / "long.bin").write_bytes(data)
    assert audio.frames_of(str(folder / "long.bin"), of, 499_990, 100).shape == (10, 2)


def test_unknown_encodings_are_errors(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(b"\0" * 40, 7, 1, 8))
    with pytest.raises(Exception, match="cannot be read"):
        audio.samples(spark.createDataFrame([(str(tmp_path / "a.wav"),)], "path string")).collect()


@pytest.mark.parametrize("split", ["16", "1000000"])
def test_data_source_by_ranges_of_bytes(spark, folder, split):
    rows = audio.read_wav(spark, str(folder), splitBytes=split).collect()
    assert len(rows) == len(ENCODED) * 8 and len({(r.path, r.t, r.channel) for r in rows}) == len(rows)
    part = audio.read_wav(spark, str(folder), splitBytes=split, offset="0.000125", duration="0.00025").filter("path like '%i32.wav' and channel = 0").orderBy("t").collect()
    assert [(r.t, r.x) for r in part] == [(0, 0.0), (1, 0.75)]
    assert audio.read_wav(spark, str(folder), mode="headers").filter("frames = 4").count() == len(ENCODED)


def test_excerpts_by_item_and_by_ranges(spark, folder, monkeypatch):
    monkeypatch.setattr(audio, "RANGE", 3)
    asked = paths(spark, folder, "i32.wav", "i16.wav").select("path", F.lit(1.5 / 8000).alias("offset"), F.lit(5.0).alias("duration"))
    rows = audio.samples(asked.unionByName(asked.withColumn("offset", F.lit(9.0)))).filter("channel = 0").orderBy("path", "t").collect()
    assert [(r.t, round(r.x, 3)) for r in rows] == [(0, 0.0), (1, 0.75), (2, -0.5)] * 2


@pytest.mark.parametrize("bits", [16, 24, 32])
def test_written_files_are_read_back(spark, tmp_path, bits):
    signals = {"a": RNG.uniform(-1, 1, 25_000), "b": np.array([2.0, -2.0, np.nan]), "c": RNG.uniform(-1, 1, 1)}
    rows = spark.createDataFrame([(k, t, float(x)) for k, v in signals.items() for t, x in enumerate(v)], "name string, t int, x double")
    made = audio.write_wav(rows, f"{tmp_path}/out {bits}", 8000, bits)
    assert {r.frames for r in made.collect()} == {25_000, 3, 1}
    got = {}
    for r in audio.samples(made).orderBy("path", "t").collect():
        got.setdefault(r.path.rsplit("/", 1)[1][0], []).append(r.x)
    step = 2.0 ** (1 - bits)
    assert got["a"] == pytest.approx(signals["a"], abs=step) and got["b"] == [1 - step, -1, 0.0] and len(got["c"]) == 1


def test_existing_with_repeated_paths(spark):
    rows = spark.createDataFrame([("p",)], "drums string")
    there = spark.createDataFrame([("p", 2.0), ("p", 1.0), ("p", None)], "path string, duration double")
    assert [r.min_duration for r in files.existing(rows, there, {"drums": "drums"}, True).collect()] == [1.0]
