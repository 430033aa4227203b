"""Five-minute windows of subjects: NumPy archives, and made-up ones for tests."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.physio import RATES, WINDOW_SECONDS

#: Array columns of a window; an acceleration's three axes follow each other sample by sample.
WIDTHS = {c: WINDOW_SECONDS * r * (3 if c.endswith("acc") else 1) for c, r in RATES.items()}
SCHEMA = "subject_id string, ts double, glucose double, " + ", ".join(f"{c} array<float>" for c in WIDTHS)
_ARROW = pa.schema([("subject_id", pa.string()), ("ts", pa.float64()), ("glucose", pa.float64()), *[(c, pa.list_(pa.float32())) for c in WIDTHS]])


def _lists(values: np.ndarray | None, n: int) -> pa.Array:
    if values is None:
        return pa.nulls(n, pa.list_(pa.float32()))
    flat = np.ascontiguousarray(values, np.float32).reshape(n, -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def _batch(sid: np.ndarray, ts: np.ndarray, glucose: np.ndarray, channels: dict[str, np.ndarray | None]) -> pa.RecordBatch:
    n = len(ts)
    columns = [pa.array([str(s) for s in sid]), pa.array(np.asarray(ts, float)), pa.array(np.asarray(glucose, float)), *[_lists(channels.get(c), n) for c in WIDTHS]]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


# ------------------------------------------------------------------ archives


class Member:
    """An array in an archive, read forwards: rows(n) gives the next n of it. Of a compressed member only what is read is
    inflated, of a plain one the start is a seek, so neither is ever in memory whole."""

    def __init__(self, archive: zipfile.ZipFile, name: str):
        self.stream = archive.open(f"{name}.npy")
        version = np.lib.format.read_magic(self.stream)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, columns_first, self.dtype = read(self.stream)
        if self.dtype.hasobject or (columns_first and len(self.shape) > 1):
            raise ValueError(f"{name}: only plain arrays in row order can be read in parts")
        self.start, self.width = self.stream.tell(), int(np.prod(self.shape[1:], dtype=np.int64)) * self.dtype.itemsize

    def skip(self, rows: int) -> Member:
        # Seeking forwards inflates and drops, where a member is compressed.
        self.stream.seek(self.start + rows * self.width)
        return self

    def rows(self, n: int) -> np.ndarray:
        content = self.stream.read(n * self.width)
        if len(content) != n * self.width:
            raise ValueError(f"{self.stream.name}: ends early")
        return np.frombuffer(content, self.dtype).reshape(n, *self.shape[1:])


@dataclass
class Rows(InputPartition):
    path: str
    start: int
    stop: int


def located(path: str) -> tuple[pa_fs.FileSystem, str, str]:
    """The file system of a path or URI, of any that Arrow knows, the name there, and what to put before such names."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return pa_fs.LocalFileSystem(), path, ""
    system, name = pa_fs.FileSystem.from_uri(path)
    return system, name, path.split("://", 1)[0] + "://"


def _opened(path: str) -> tuple[pa.NativeFile, zipfile.ZipFile]:
    """A file and the archive in it; only what is asked is fetched."""
    system, name, _ = located(path)
    file = system.open_input_file(name)
    return file, zipfile.ZipFile(file)


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, rows: int, rows_per_task: int):
        self.folder, self.rows, self.rows_per_task = folder, rows, rows_per_task

    def partitions(self) -> list[Rows]:
        """Only the archives' directories and one array's header each are read here."""
        system, name, base = located(self.folder)
        found = system.get_file_info(pa_fs.FileSelector(name)) if system.get_file_info(name).type == pa_fs.FileType.Directory else [system.get_file_info(name)]
        out = []
        for path in sorted(base + f.path for f in found if f.is_file and f.path.endswith(".npz")):
            file, archive = _opened(path)
            with file, archive:
                have = {n.removesuffix(".npy") for n in archive.namelist()}
                first = next((k for k in ("glucose", "subject_id", "timestamp", "e4_hr", "e4_eda") if k in have), None)
                if first is None:
                    raise ValueError(f"{path}: no member gives the number of windows")
                n = Member(archive, first).shape[0]
            out += [Rows(path, k, min(k + self.rows_per_task, n)) for k in range(0, n, self.rows_per_task)]
        return out

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        file, archive = _opened(partition.path)
        with file, archive:
            have = {n.removesuffix(".npy") for n in archive.namelist()}
            members = {c: Member(archive, c).skip(partition.start) for c in ("subject_id", "timestamp", "glucose", *WIDTHS) if c in have}
            for start in range(partition.start, partition.stop, self.rows):
                n = min(self.rows, partition.stop - start)
                part = {c: m.rows(n) for c, m in members.items()}
                sid = part.pop("subject_id", np.array([partition.path] * n))
                ts, glucose = part.pop("timestamp", np.arange(start, start + n)), part.pop("glucose", np.full(n, np.nan))
                yield _batch(sid, ts, glucose, part)


class ArchiveSource(DataSource):
    """spark.read.format("window_archives").load(folder): windows of the .npz archives in a folder, or of one archive."""

    @classmethod
    def name(cls) -> str:
        return "window_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rows", 16)), int(self.options.get("rows_per_task", 512)))


def read_archives(spark: SparkSession, folder: str, rows: int = 16, rows_per_task: int = 512) -> DataFrame:
    """One row a window of the .npz archives in a folder; channels that an archive lacks are null, and where it names no
    subject its path does. Archives are split: a task reads rows_per_task windows of one, member by member, rows at a
    time, so an archive of any size is read by as many tasks as its windows fill. A member that is compressed is inflated up
    to the task's last window; write archives plain, or tables as Parquet, where that matters."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("window_archives").option("rows", rows).option("rows_per_task", rows_per_task).load(folder)


def _made_up(batches: Iterator[pa.RecordBatch], windows: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for subject in batch.column(0).to_pylist():
            r = np.random.default_rng([seed, subject])
            base = 90 + 12 * r.normal()
            for k in range(windows):
                glucose = base + 18 * np.sin(2 * np.pi * k / 24) + 3 * r.normal()
                rate = 62 + 0.15 * (glucose - 90) + 2 * r.normal()
                beats = np.cumsum(60 / rate + 0.02 * r.normal(size=int(WINDOW_SECONDS * rate / 60) + 5))
                yield _batch(np.array([f"s{subject:03}"]), np.array([300.0 * k]), np.array([glucose]), _channels(r, beats, rate))


def _train(beats: np.ndarray, hz: int, delay: float, width: float) -> np.ndarray:
    """Bumps at the beats."""
    t = np.arange(WINDOW_SECONDS * hz) / hz
    near = np.clip(np.searchsorted(beats + delay, t), 1, len(beats) - 1)
    d = np.minimum(np.abs(t - beats[near - 1] - delay), np.abs(t - beats[near] - delay))
    return np.exp(-0.5 * (d / width) ** 2)


def _channels(r: np.random.Generator, beats: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    n = lambda c: WINDOW_SECONDS * RATES[c]
    breath = np.sin(2 * np.pi * 0.25 * np.arange(n("zephyr_breathing")) / RATES["zephyr_breathing"])
    out = {
        "zephyr_ecg": _train(beats, RATES["zephyr_ecg"], 0.0, 0.02) + 0.02 * r.normal(size=n("zephyr_ecg")),
        "e4_bvp": _train(beats, RATES["e4_bvp"], 0.22, 0.12) + 0.02 * r.normal(size=n("e4_bvp")), "e4_hr": rate + r.normal(size=n("e4_hr")),
        "e4_eda": 2 + 0.1 * np.abs(r.normal(size=n("e4_eda"))), "e4_temp": 33 + 0.05 * r.normal(size=n("e4_temp")), "zephyr_breathing": breath,
        "e4_acc": r.normal(size=(n("e4_acc"), 3)), "zephyr_acc": r.normal(size=(n("zephyr_acc"), 3)),
    }
    for c in ("e4_bvp", "e4_eda", "e4_temp"):
        if r.random() < 0.1:  # a gap of a third of the window
            start = int(r.integers(0, 2 * n(c) // 3))
            out[c][start : start + n(c) // 3] = np.nan
    return {c: v[None] for c, v in out.items()}


def synthetic(spark: SparkSession, subjects: int = 6, windows: int = 40, seed: int = 7) -> DataFrame:
    """Made-up subjects whose heart rate follows their glucose; the same for a seed, however they are partitioned."""
    ids = spark.range(subjects).repartition(subjects)
    return ids.mapInArrow(lambda batches: _made_up(batches, windows, seed), SCHEMA)


def finite_targets(rows: DataFrame, least: int = 20) -> DataFrame:
    """The rows with a finite target; an error if they are fewer than least."""
    good = rows.where(F.col("glucose").isNotNull() & ~F.isnan("glucose") & (F.abs("glucose") < float("inf")))
    if good.count() < least:
        raise ValueError(f"fewer than {least} windows have a target")
    return good
