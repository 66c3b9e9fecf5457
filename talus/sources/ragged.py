"""Ragged arrays as a Spark data source: raw little-endian arrays read by byte ranges, written as parts.

A part is a folder of four files: offsets.i64 (where each unit's records start,
and the end), itemid.i32, t.f32 and value.f32. A folder may be one such part, or
hold many with a manifest parts.json that gives each part's first unit and its
place on the record axis. A task reads a range of records, that is one byte
range of each of its part's arrays, and finds their units in the offsets; a unit
of any size is read by many tasks. Everything moves in Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

ARRAYS = {"dense_id": ("itemid.i32", "<i4"), "t": ("t.f32", "<f4"), "value": ("value.f32", "<f4")}
OFFSETS = "offsets.i64"
MANIFEST = "parts.json"
RECORDS = "row_index bigint, dense_id int, t float, value float"
UNITS = "idx bigint, n bigint, start bigint, stop bigint"
TASK_ENTRIES = 1 << 22
BATCH = 1 << 16
KINDS = {"i32": "<i4", "i64": "<i8", "u32": "<u4", "u64": "<u8"}


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute path; ``file:/x`` is a local one too."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[len("file:") :]
    return pafs.FileSystem.from_uri(path)


def _size(fs: pafs.FileSystem, path: str) -> int:
    info = fs.get_file_info(path)
    if info.type != pafs.FileType.File:
        raise ValueError(f"{path}: no such file")
    return info.size


def read_json(path: str) -> dict | None:
    """A small JSON file anywhere, None where there is none."""
    fs, place = located(path)
    if fs.get_file_info(place).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(place) as source:
        return json.loads(source.read())


def _slice(fs: pafs.FileSystem, path: str, dtype: str, first: int, stop: int) -> np.ndarray:
    """Entries first .. stop-1 of a raw array."""
    width = np.dtype(dtype).itemsize
    with fs.open_input_file(path) as source:
        source.seek(first * width)
        return np.frombuffer(source.read((stop - first) * width), dtype)


@dataclass
class Part(InputPartition):
    """A part, or a range of it: records start .. stop-1 of its arrays."""

    folder: str
    first_unit: int
    n_units: int
    start: int
    stop: int

    def __post_init__(self):
        self.value = None  # the place of a partition is all of these


def parts_of(folder: str) -> list[Part]:
    """The parts of a folder, with their lengths checked against the sizes of the files."""
    manifest = read_json(f"{folder}/{MANIFEST}")
    known = [(folder, 0)] if manifest is None else [(f"{folder}/{p['folder']}", p["first_unit"]) for p in manifest["parts"]]
    found = []
    for place, first_unit in known:
        fs, path = located(place)
        n_units = _size(fs, f"{path}/{OFFSETS}") // 8 - 1
        if n_units < 0:
            raise ValueError(f"{place}: empty offsets")
        n = int(_slice(fs, f"{path}/{OFFSETS}", "<i8", n_units, n_units + 1)[0])
        if any(_size(fs, f"{path}/{name}") != n * np.dtype(dtype).itemsize for name, dtype in ARRAYS.values()):
            raise ValueError(f"{place}: array lengths and offsets disagree")
        found.append(Part(place, first_unit, n_units, 0, n))
    return found


class _RecordReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Part]:
        cut = lambda p: [Part(p.folder, p.first_unit, p.n_units, a, min(a + TASK_ENTRIES, p.stop)) for a in range(0, p.stop, TASK_ENTRIES)]
        return [piece for part in parts_of(self.folder) for piece in cut(part)] or [Part(self.folder, 0, 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:  # the one range of a folder without records
            return
        fs, path = located(partition.folder)
        with fs.open_input_file(f"{path}/{OFFSETS}") as source:

            def upto(record: int) -> int:
                """The unit that holds a record: the last whose start is not beyond it, by bisection of the file."""
                low, high = 0, partition.n_units
                while high - low > 1:
                    middle = (low + high) // 2
                    source.seek(8 * middle)
                    low, high = (middle, high) if np.frombuffer(source.read(8), "<i8")[0] <= record else (low, middle)
                return low

            first, last = upto(partition.start), upto(partition.stop - 1)
        starts = _slice(fs, f"{path}/{OFFSETS}", "<i8", first, last + 2)
        if (np.diff(starts) < 0).any():
            raise ValueError(f"{partition.folder}: offsets decrease")
        for a in range(partition.start, partition.stop, BATCH):
            b = min(a + BATCH, partition.stop)
            unit = np.searchsorted(starts, np.arange(a, b), "right") - 1 + first + partition.first_unit
            columns = {"row_index": unit.astype(np.int64)}
            columns |= {name: _slice(fs, f"{path}/{file}", dtype, a, b) for name, (file, dtype) in ARRAYS.items()}
            yield pa.RecordBatch.from_pydict({name: pa.array(values) for name, values in columns.items()})


class _UnitReader(DataSourceReader):
    """Units of one offsets file: a task reads a byte range and the entry after it."""

    def __init__(self, path: str, kind: str):
        self.path, self.dtype = path, KINDS[kind]

    def partitions(self) -> list[Part]:
        fs, path = located(self.path)
        n = _size(fs, path) // np.dtype(self.dtype).itemsize - 1
        return [Part(self.path, 0, n, a, min(a + TASK_ENTRIES, n)) for a in range(0, n, TASK_ENTRIES)] or [Part(self.path, 0, 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, path = located(partition.folder)
        for a in range(partition.start, partition.stop, BATCH):
            b = min(a + BATCH, partition.stop)
            x = _slice(fs, path, self.dtype, a, b + 1).astype(np.int64)
            columns = {"idx": np.arange(a, b), "n": np.diff(x), "start": x[:-1], "stop": x[1:]}
            yield pa.RecordBatch.from_pydict({name: pa.array(values) for name, values in columns.items()})


@dataclass
class Written(WriterCommitMessage):
    folder: str
    task: int
    first_unit: int
    n_units: int
    n_records: int
    sha256: dict[str, str]


class _Writer(DataSourceArrowWriter):
    """Each task writes its sorted records as a part of its own; the manifest names those that were committed."""

    def __init__(self, folder: str, n_units: int | None):
        self.folder, self.n_units = folder, n_units

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, path = located(f"{self.folder}/{name}")
        fs.create_dir(path, recursive=True)
        first = last = None
        records = 0
        names = {OFFSETS: OFFSETS} | {column: file for column, (file, _) in ARRAYS.items()}
        files = {name: fs.open_output_stream(f"{path}/{file}") for name, file in names.items()}
        digests = {name: hashlib.sha256() for name in names}

        def put(name: str, values: np.ndarray, dtype: str) -> None:
            raw = values.astype(dtype).tobytes()
            files[name].write(raw)
            digests[name].update(raw)

        for batch in iterator:
            if batch.num_rows == 0:
                continue
            unit = batch.column("row_index").to_numpy()
            if (np.diff(unit) < 0).any() or (last is not None and unit[0] < last):
                raise ValueError("records are not sorted by unit")
            if first is None:
                first, last = int(unit[0]), int(unit[0]) - 1
            # the starts of all units after the last one, empty ones included
            starts = np.searchsorted(unit, np.arange(last + 1, int(unit[-1]) + 1)) + records
            put(OFFSETS, starts, "<i8")
            last, records = int(unit[-1]), records + len(unit)
            for column, (_, dtype) in ARRAYS.items():
                put(column, batch.column(column).to_numpy(zero_copy_only=False), dtype)
        put(OFFSETS, np.array([records]), "<i8")
        for out in files.values():
            out.close()
        known = {names[column]: d.hexdigest() for column, d in digests.items()}
        return Written(name, task.partitionId(), first or 0, 0 if first is None else last - first + 1, records, known)

    def commit(self, messages: list[Written | None]) -> None:
        kept = sorted((m for m in messages if m is not None and m.n_records), key=lambda m: m.task)
        fs, path = located(self.folder)
        places = np.concatenate([[0], np.cumsum([m.n_records for m in kept])]).astype(int).tolist()
        parts = [{k: v for k, v in asdict(m).items() if k != "task"} | {"start": s} for m, s in zip(kept, places)]
        ends = [m.first_unit + m.n_units for m in kept]
        if any(m.first_unit < end - 1 for m, end in zip(kept[1:], ends)):
            raise ValueError("parts overlap: sort records into ranges of units first")
        n_units = self.n_units if self.n_units is not None else max(ends, default=0)
        with fs.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps({"n_stays": n_units, "n_records": places[-1], "parts": parts}, indent=2).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = located(self.folder)
        for m in messages:
            if m is not None:
                fs.delete_dir(f"{path}/{m.folder}")


class RaggedSource(DataSource):
    """Format ``ragged``: ``records`` of a folder (read and write) or the ``units`` of one offsets file (read)."""

    @classmethod
    def name(cls) -> str:
        return "ragged"

    def schema(self) -> str:
        return UNITS if self.options.get("content") == "units" else RECORDS

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"]
        return _UnitReader(path, self.options.get("kind", "i64")) if self.options.get("content") == "units" else _RecordReader(path)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        n_units = self.options.get("n_units")
        return _Writer(self.options["path"], None if n_units is None else int(n_units))
