"""Binary trajectories (DCD) as a Spark data source: one task per file and range of wanted frames.

A file that stores selected frames only has a frame map beside it (``trajectory_frames.json``); its records then carry the
original frame numbers. The folder is a path or a URI (``file``, ``hdfs``, ``s3`` and whatever else pyarrow's file systems
know); frames are read as byte ranges of it.

With the option ``pushdown`` and the setting ``spark.sql.python.filterPushdown.enabled``, both ``true``, conditions on
``system``, ``replicate`` and ``frame`` choose files and frames before anything but headers is read, and files that names
exclude are not opened. Register with ``spark.dataSource.register(TrajectoryDataSource)`` and read with
``spark.read.format("dcd").option("path", folder).load()``. Options: ``frames`` (``first:last:step``, one-based and
inclusive; only those frames are read), ``frames_per_task`` and ``angstrom`` (``false`` when already in nm).
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterable

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lattica.constants import FRAME_MAP_NAME


class FrameRange(InputPartition):
    """Stored records of one file with their original frame numbers."""

    def __init__(self, path: str, head: dict[str, int], records: list[tuple[int, int]]):
        self.path, self.head, self.records = path, head, records


def located(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a URI or a path."""
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def original_frames(files: fs.FileSystem, path: str, stored: int):
    """Frame number of each stored record: by the map beside the file, or counted from 1."""
    beside = f"{path.rpartition('/')[0]}/{FRAME_MAP_NAME}"
    if files.get_file_info(beside).type == fs.FileType.NotFound:
        return range(1, stored + 1)
    with files.open_input_stream(beside) as f:
        frames = json.loads(f.read())["source_frames_one_based"]
    if len(frames) != stored or sorted(set(frames)) != frames:
        raise ValueError(f"{beside}: frames must be sorted, unique and as many as the {stored} stored records")
    return frames


def header(files: fs.FileSystem, path: str) -> dict[str, int]:
    """Number of frames and atoms, and where the frames begin. Only the header is read."""
    with files.open_input_file(path) as f:
        length = f.size()
        size, magic = struct.unpack("<i4s", f.read(8))
        if size != 84 or magic != b"CORD":
            raise ValueError(f"{path}: not a little-endian DCD file")
        control = struct.unpack("<20i", f.read(80))
        f.read(4)
        (titles,) = struct.unpack("<i", f.read(4))
        f.seek(f.tell() + titles + 4)
        _, atoms, _ = struct.unpack("<3i", f.read(12))
        start = f.tell()
    cell = 56 if control[10] else 0
    size_of_frame = cell + 3 * (4 * atoms + 8)
    return {"frames": (length - start) // size_of_frame, "atoms": atoms, "start": start, "cell": cell, "bytes": size_of_frame}


def _test(f: Filter) -> Callable[[object], bool] | None:
    """What a condition asks of a value; nothing for kinds that are left to Spark."""
    match f:
        case EqualTo(value=v):
            return lambda x: x == v
        case In(value=vs):
            return lambda x: x in vs
        case GreaterThan(value=v):
            return lambda x: x > v
        case GreaterThanOrEqual(value=v):
            return lambda x: x >= v
        case LessThan(value=v):
            return lambda x: x < v
        case LessThanOrEqual(value=v):
            return lambda x: x <= v
    return None


class TrajectoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.tests: list[tuple[str, Callable[[object], bool]]] = []
        self.per_task = int(options.get("frames_per_task", 50))
        self.scale = 0.1 if options.get("angstrom", "true") == "true" else 1.0
        self.wanted = tuple(int(v) for v in options["frames"].split(":")) if "frames" in options else None

    def _passes(self, column: str, value: object) -> bool:
        return all(test(value) for name, test in self.tests if name == column)

    def _wanted(self, frame: int) -> bool:
        if not self._passes("frame", frame):
            return False
        if not self.wanted:
            return True
        first, last, step = self.wanted
        return first <= frame <= last and (frame - first) % step == 0

    def partitions(self):
        files, root = located(self.root)
        out = []
        for path in sorted(i.path for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(".dcd")):
            replicate, system = path.split("/")[-3:-1]
            if self._passes("system", system) and self._passes("replicate", replicate):
                head = header(files, path)
                records = [(i, f) for i, f in enumerate(original_frames(files, path, head["frames"])) if self._wanted(f)]
                out += [FrameRange(path, head, records[lo : lo + self.per_task]) for lo in range(0, len(records), self.per_task)]
        return out or [FrameRange("", {}, [])]

    def read(self, partition: FrameRange):
        import numpy as np
        import pyarrow as pa

        if not partition.records:
            return
        h = partition.head
        replicate, system = partition.path.split("/")[-3:-1]
        n = h["atoms"]
        with located(self.root)[0].open_input_file(partition.path) as f:
            for index, frame in partition.records:
                f.seek(h["start"] + index * h["bytes"] + h["cell"])
                raw = np.frombuffer(f.read(3 * (4 * n + 8)), dtype="<f4").reshape(3, n + 2)[:, 1:-1] * np.float32(self.scale)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(system, n),
                        pa.repeat(replicate, n),
                        pa.array(np.full(n, frame, dtype=np.int32)),
                        pa.array(np.arange(n, dtype=np.int32)),
                        *[pa.array(axis) for axis in raw],
                    ],
                    names=["system", "replicate", "frame", "bead", "x", "y", "z"],
                )


class FilteringReader(TrajectoryReader):
    """The reader that takes conditions; Spark refuses it where the setting is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = _test(f) if getattr(f, "attribute", None) in (("system",), ("replicate",), ("frame",)) and getattr(f, "value", None) is not None else None
            if test is None:
                yield f
            else:
                self.tests.append((f.attribute[0], test))


class TrajectoryDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dcd"

    def schema(self) -> str:
        return "system string, replicate string, frame int, bead int, x float, y float, z float"

    def reader(self, schema) -> TrajectoryReader:
        options = dict(self.options)
        return (FilteringReader if options.get("pushdown", "false") == "true" else TrajectoryReader)(options)
