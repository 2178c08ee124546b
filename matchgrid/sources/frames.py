"""Raw frames and PCM sound as data sources: read by byte range, in Arrow batches.

A file of RGB frames is cut at frames into partitions of some MB, so a file of
any size is read by many tasks, and a range of time or a lower rate means that
only the bytes of the frames asked for are read. Filters on ``t`` and
``video_key`` are pushed into the reader where the session allows it
(``spark.sql.python.filterPushdown.enabled``). A sound is read as mono at one
rate; each block of its samples reads what the resampling filter needs of its
neighbours, so blocks do not depend on the partitioning.

Files are opened through ``pyarrow.fs``, by URI or absolute path. What a video
is called is its file's name without the ending.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor, gcd

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

MIB = 1 << 20
#: Bytes of one partition, and of one batch, about.
PARTITION_BYTES, BATCH_BYTES = 64 * MIB, 8 * MIB
#: Zero crossings of the resampling filter on either side, and its window's shape.
CROSSINGS, KAISER = 16, 8.0


def listed(path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """Path and size of a file, or of the files of a folder with one of the endings, by name."""
    store, p = fs.FileSystem.from_uri(path)
    info = store.get_file_info(p)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = store.get_file_info(fs.FileSelector(p)) if info.type == fs.FileType.Directory else [info]
    head = path[: len(path) - len(p)] if path.endswith(p) else ""
    return sorted((head + f.path, f.size) for f in files if f.type == fs.FileType.File and (f is info or f.path.lower().endswith(endings)))


def opened(path: str):
    """A file by URI or absolute path; Spark writes local ones with a single slash."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    store, p = fs.FileSystem.from_uri(path)
    return store.open_input_file(p)


def key_of(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


class Wanted:
    """Bounds of time and names, of options and of the filters on ``column`` that were pushed.

    Filters are only used to read less; Spark applies them again.
    """

    def __init__(self, options: dict[str, str], column: str = "t"):
        self.column = column
        self.low, self.high, self.closed = float(options.get("start", "0")), float(options.get("end", "inf")), False
        self.keys: set[str] | None = None

    def rows(self, rate: float, n: int) -> tuple[int, int]:
        """First and behind the last of the rows 0 .. n at ``i / rate`` that lie in the time asked for."""
        first = min(n, max(0, ceil(self.low * rate - 1e-6)))
        if self.high == float("inf"):
            return first, n
        behind = floor(self.high * rate + 1e-6) + 1 if self.closed else ceil(self.high * rate - 1e-6)
        return first, max(first, min(n, behind))

    def push(self, filters: list[Filter]) -> None:
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == (self.column,):
                self.low = max(self.low, float(f.value))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == (self.column,) and float(f.value) < self.high:
                self.closed = isinstance(f, LessThanOrEqual)
                self.high = float(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("video_key",):
                self.keys = {str(f.value)} if self.keys is None else self.keys & {str(f.value)}


@dataclass
class Range(InputPartition):
    """Rows ``first .. behind`` (frames, or blocks of samples) of one file."""

    path: str
    first: int
    behind: int


def even_parts(n: int, parts: int) -> list[tuple[int, int]]:
    parts = max(1, min(n, parts))
    return [(n * k // parts, n * (k + 1) // parts) for k in range(parts)] if n else []


class RawFrames(DataSource):
    """Frames of fixed size, three bytes a pixel, as ``video_key, frame, t, halo, pixels``.

    Options: ``path``, ``width``, ``height``, ``fps`` (of the file); ``rate`` to take
    frames at (the file's if not given), ``start`` and ``end`` in seconds, ``gray`` for one
    byte a pixel, ``halo`` to add the frame before the first of each partition,
    ``parts`` or ``partition_bytes``. Frame ``i`` is at ``i / rate``, and shows the file's frame
    nearest to that time, of two the later. A last frame that is cut off is left out.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return "video_key string, frame long, t double, halo boolean, pixels binary"

    def reader(self, schema: StructType) -> RawFramesReader:
        return (PushedFramesReader if pushes(self.options) else RawFramesReader)(dict(self.options))


class RawFramesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.fps = options["path"], float(options["fps"])
        self.rate = float(options.get("rate") or self.fps)
        self.width, self.height = int(options["width"]), int(options["height"])
        self.size = self.width * self.height * 3
        self.gray, self.halo = (options.get(k, "false").lower() == "true" for k in ("gray", "halo"))
        self.parts, self.bytes = int(options.get("parts", "0")), int(options.get("partition_bytes", PARTITION_BYTES))
        self.wanted = Wanted(options)

    def shown(self, i: int) -> int:
        """The file's frame that frame ``i`` shows."""
        return floor(i * self.fps / self.rate + 0.5)

    def frames(self, size: int) -> tuple[int, int]:
        """First frame asked for and the one behind the last, of a file of so many bytes."""
        held = size // self.size
        n = ceil(held * self.rate / self.fps) + 1
        while n and self.shown(n - 1) >= held:
            n -= 1
        return self.wanted.rows(self.rate, n)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, size in listed(self.path, (".rgb", ".raw")):
            if self.wanted.keys is not None and key_of(path) not in self.wanted.keys:
                continue
            first, behind = self.frames(size)
            parts = self.parts or ceil((behind - first) * self.size / self.bytes)
            out += [Range(path, first + a, first + e) for a, e in even_parts(behind - first, parts)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        key, rows = key_of(partition.path), []
        begin = partition.first - int(self.halo and partition.first > 0)
        with opened(partition.path) as f:
            for i in range(begin, partition.behind):
                pixels = f.read_at(self.size, self.shown(i) * self.size)
                rows.append((i, luma(pixels) if self.gray else pixels))
                if len(rows) * self.size >= BATCH_BYTES:
                    yield self.batch(key, rows, partition.first)
                    rows = []
        if rows:
            yield self.batch(key, rows, partition.first)

    def batch(self, key: str, rows: list[tuple[int, bytes]], first: int) -> pa.RecordBatch:
        frame = np.array([i for i, _ in rows], np.int64)
        columns = [pa.array([key] * len(rows)), pa.array(frame), pa.array(frame / self.rate), pa.array(frame < first), pa.array([p for _, p in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["video_key", "frame", "t", "halo", "pixels"])


class Pushed:
    """Takes filters; Spark refuses a reader that does where the session does not push any."""

    wanted: Wanted

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        self.wanted.push(filters)
        yield from filters


class PushedFramesReader(Pushed, RawFramesReader):
    pass


def pushes(options: dict[str, str]) -> bool:
    return options.get("pushdown", "false").lower() == "true"


def luma(pixels: bytes) -> bytes:
    """Brightness of RGB pixels, by the weights of standard television."""
    rgb = np.frombuffer(pixels, np.uint8).reshape(-1, 3).astype(np.uint32)
    return ((rgb @ np.array([19595, 38470, 7471], np.uint32) + 0x8000) >> 16).astype(np.uint8).tobytes()


@dataclass
class Wave:
    """Where a WAV file's samples lie, and what they are."""

    rate: int
    channels: int
    kind: str
    begin: int
    frames: int

    @property
    def width(self) -> int:
        return int(self.kind[-1]) * self.channels

    @property
    def duration(self) -> float:
        return self.frames / self.rate


KINDS = {(1, 8): "u1", (1, 16): "<i2", (1, 24): "<i3", (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}


def wave_of(path: str, size: int | None = None) -> Wave | None:
    """The header of a WAV file (RIFF, or RF64 beyond 4 GB), or None if it is none or of another coding.

    Only headers of chunks are read. A data chunk that says it is longer than the file, or
    does not say how long it is, ends with the file.
    """
    with opened(path) as f:
        size, at, long = f.size() if size is None else size, 12, None
        start = f.read_at(min(12, size), 0)
        if start[:4] not in (b"RIFF", b"RF64") or start[8:12] != b"WAVE":
            return None
        kind = rate = channels = 0
        while at + 8 <= size:
            head = f.read_at(8, at)
            name, n = head[:4], int.from_bytes(head[4:], "little")
            if name == b"ds64":
                long = int.from_bytes(f.read_at(16, at + 8)[8:16], "little")
            elif name == b"fmt ":
                x = f.read_at(min(n, 40), at + 8)
                code, channels, rate, bits = (int.from_bytes(x[a:e], "little") for a, e in ((0, 2), (2, 4), (4, 8), (14, 16)))
                if code == 0xFFFE and len(x) >= 26:  # the coding stands in the extension
                    code = int.from_bytes(x[24:26], "little")
                kind = KINDS.get((code, bits), "")
            elif name == b"data":
                if not (kind and rate and channels):
                    return None
                n = long if n == 0xFFFFFFFF and long is not None else n
                width = int(kind[-1]) * channels
                return Wave(rate, channels, kind, at + 8, min(n, size - at - 8) // width)
            at += 8 + n + n % 2
    return None


def samples_of(f, wave: Wave, first: int, behind: int) -> np.ndarray:
    """Samples ``first .. behind`` as the mean of the channels; silence beyond either end."""
    a, e = max(0, first), min(wave.frames, behind)
    out = np.zeros(behind - first)
    if e > a:
        raw = f.read_at((e - a) * wave.width, wave.begin + a * wave.width)
        if wave.kind == "<i3":
            x = np.zeros((len(raw) // 3, 4), np.uint8)
            x[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
            x = x.view("<i4").ravel() / 2.0**31
        else:
            x = np.frombuffer(raw, wave.kind).astype(np.float64)
            x = (x - 128) / 128 if wave.kind == "u1" else x / 2.0 ** (8 * int(wave.kind[-1]) - 1) if wave.kind[1] == "i" else x
        out[a - first : e - first] = x.reshape(-1, wave.channels).mean(axis=1)
    return out


class Resampler:
    """Rational resampling by the phases of one windowed sinc.

    Output sample n is at n * down / up input samples; its phase n * down mod up
    chooses the taps, which are scaled to sum to one, so that a constant stays.
    """

    def __init__(self, rate: int, target: int):
        g = gcd(rate, target)
        self.up, self.down = target // g, rate // g
        cut = min(1.0, self.up / self.down)
        self.reach = ceil(CROSSINGS / cut)
        place = np.arange(-self.reach, self.reach + 1)[None, :] - (np.arange(self.up) / self.up)[:, None]
        window = np.i0(KAISER * np.sqrt(np.maximum(0, 1 - (place / (self.reach + 1)) ** 2))) / np.i0(KAISER)
        taps = np.sinc(cut * place) * window
        self.taps = taps / taps.sum(axis=1, keepdims=True)

    def needed(self, first: int, behind: int) -> tuple[int, int]:
        """Input samples that output samples ``first .. behind`` depend on."""
        return first * self.down // self.up - self.reach, (behind - 1) * self.down // self.up + self.reach + 1

    def run(self, x: np.ndarray, first: int, behind: int) -> np.ndarray:
        """Output samples ``first .. behind`` from the samples that ``needed`` names."""
        if self.up == self.down:
            return x[self.reach : self.reach + behind - first]
        n, at = np.arange(first, behind, dtype=np.int64), self.needed(first, behind)[0]
        base, out = n * self.down // self.up - at, np.empty(behind - first)
        windows = np.lib.stride_tricks.sliding_window_view(x, 2 * self.reach + 1)
        for k in range(0, len(n), 4096):
            part = slice(k, k + 4096)
            out[part] = np.einsum("ij,ij->i", windows[base[part] - self.reach], self.taps[n[part] * self.down % self.up])
        return out


class PcmSound(DataSource):
    """Sound of WAV files as mono samples: ``video_key, block, t, rate, samples``.

    Options: ``path``, ``rate`` (16000), ``seconds`` of a block (10), ``start`` and ``end`` (whole blocks
    that reach into this time are given), ``parts`` or ``partition_bytes``. Files that are no PCM are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "pcm_sound"

    def schema(self) -> str:
        return "video_key string, block long, t double, rate int, samples array<float>"

    def reader(self, schema: StructType) -> PcmSoundReader:
        return (PushedSoundReader if pushes(self.options) else PcmSoundReader)(dict(self.options))


class PcmSoundReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.rate = options["path"], int(options.get("rate", "16000"))
        self.block = max(1, round(float(options.get("seconds", "10")) * self.rate))
        self.parts, self.bytes = int(options.get("parts", "0")), int(options.get("partition_bytes", PARTITION_BYTES))
        self.wanted = Wanted(options)

    def total(self, wave: Wave) -> int:
        return ceil(wave.frames * self.rate / wave.rate)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, size in listed(self.path, (".wav",)):
            wave = wave_of(path, size)
            if wave is None or (self.wanted.keys is not None and key_of(path) not in self.wanted.keys):
                continue
            n = ceil(self.total(wave) / self.block)
            first = min(n, max(0, floor(self.wanted.low * self.rate / self.block)))
            behind = n if self.wanted.high == float("inf") else max(first, min(n, ceil(self.wanted.high * self.rate / self.block)))
            parts = self.parts or ceil((behind - first) / n * size / self.bytes) if n else 0
            out += [Range(path, first + a, first + e) for a, e in even_parts(behind - first, parts)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        wave, key = wave_of(partition.path), key_of(partition.path)
        resampler, total = Resampler(wave.rate, self.rate), self.total(wave)
        with opened(partition.path) as f:
            for b in range(partition.first, partition.behind):
                first, behind = b * self.block, min(total, (b + 1) * self.block)
                x = samples_of(f, wave, *resampler.needed(first, behind))
                out = resampler.run(x, first, behind).astype(np.float32)
                columns = [pa.array([key]), pa.array([b]), pa.array([first / self.rate]), pa.array([self.rate], pa.int32()), pa.array([out], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, ["video_key", "block", "t", "rate", "samples"])


class PushedSoundReader(Pushed, PcmSoundReader):
    pass


def raw_frames(spark: SparkSession, path: str, width: int, height: int, fps: float, **options) -> DataFrame:
    """Frames of raw RGB files; ``options`` as of ``RawFrames``."""
    return _load(spark, RawFrames, path=path, width=width, height=height, fps=fps, **options)


def frames_at(times: DataFrame, folder: str, width: int, height: int, fps: float, ending: str = ".rgb") -> DataFrame:
    """``times`` with ``frame, pixels``: the first frame at or after each ``t`` of ``video_key``, read alone.

    Where the video has no such frame, or there is no such file, both are null.
    """
    size = width * height * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frames, pixels = [], []
            for key, t in zip(b.column("video_key").to_pylist(), b.column("t").to_pylist(), strict=True):
                i, raw = None if t is None or t < 0 else ceil(t * fps - 1e-6), b""
                if key is not None and i is not None:
                    try:
                        with opened(f"{folder.rstrip('/')}/{key}{ending}") as f:
                            raw = f.read_at(size, i * size) if (i + 1) * size <= f.size() else b""
                    except FileNotFoundError:
                        pass
                frames.append(i if raw else None)
                pixels.append(raw or None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(frames, pa.int64()), pa.array(pixels, pa.binary())], [*b.schema.names, "frame", "pixels"])

    t = times.withColumns({"video_key": F.col("video_key").cast("string"), "t": F.col("t").cast("double")})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema)
    return t.mapInArrow(run, f"{kinds}, frame long, pixels binary")


def pcm_sound(spark: SparkSession, path: str, **options) -> DataFrame:
    """Mono sound of WAV files in blocks; ``options`` as of ``PcmSound``."""
    return _load(spark, PcmSound, path=path, **options)


def _load(spark: SparkSession, source: type[DataSource], **options) -> DataFrame:
    spark.dataSource.register(source)
    options["pushdown"] = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items() if v is not None}).load()
