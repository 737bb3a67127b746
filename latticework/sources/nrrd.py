"""NRRD volumes as a Spark data source: ``spark.read.format("nrrd").load(path)`` gives (x0, x1, x2, value); attached raw data, one detached raw file, or
a list of files with equal shares along the slowest axis (named one by one, or by a pattern with numbers).

Every task reads a slab along the slowest axis. ``write_nrrd`` writes a field. Paths are opened by pyarrow's file systems.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Element types of the format and numpy's names for them (fixed values).
TYPES = {
    "signed char": "i1", "int8": "i1", "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2",
    "unsigned short": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "float": "f4", "double": "f8",
}


def _open(path: str):
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def header(path: str) -> dict:
    """sizes, dtype, and the files of the raw data with the offset at which it begins in each."""
    system, where = _open(path)
    with system.open_input_file(where) as f:
        head = f.read(1 << 16)
        attached = b"\n\n" in head
        if not attached:  # a list of files may be long, and ends with the file
            head += f.read()
    text, _, _ = head.partition(b"\n\n")
    if not head.startswith(b"NRRD"):
        raise ValueError(f"{path} has no NRRD header")
    fields, listed = {}, None
    for line in text.decode().split("\n")[1:]:
        if listed is not None:
            listed += [line.strip()] if line.strip() else []
        elif ": " in line and not line.startswith("#"):
            key, value = line.split(": ", 1)
            fields[key.strip().lower()] = value.strip()
            if key.strip().lower() in ("data file", "datafile") and value.split()[0] == "LIST":
                listed = []
    if fields.get("encoding", "raw") != "raw":
        raise ValueError("only raw encoding is read")
    order = ">" if fields.get("endian") == "big" else "<"
    sizes = [int(x) for x in fields["sizes"].split()]
    detached = fields.get("data file") or fields.get("datafile")
    if listed is None and detached and "%" in detached:  # pattern, first and last number, step
        pattern, first, last, step = detached.split()[:4]
        listed = [pattern % k for k in range(int(first), int(last) + (1 if int(step) > 0 else -1), int(step))]
    if not detached and not attached:
        raise ValueError(f"{path} has no end of its header")
    files = [path] if not detached else [posixpath.join(posixpath.dirname(path), name) for name in (listed or [detached])]
    if sizes[-1] % len(files):
        raise ValueError("files must hold equal shares along the slowest axis")
    return {"sizes": sizes, "dtype": order + TYPES[fields["type"]], "files": files, "offset": 0 if detached else len(text) + 2}


class Slab(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(first)
        self.first, self.last = first, last


class NrrdReader(DataSourceReader):
    def __init__(self, path: str, slabs: int):
        self.path, self.slabs, self.head = path, slabs, header(path)

    def partitions(self):
        n = self.head["sizes"][-1]
        count = max(1, min(self.slabs, n))
        return [Slab(n * i // count, n * (i + 1) // count) for i in range(count)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        sizes, kind = self.head["sizes"], np.dtype(self.head["dtype"])
        plane = int(np.prod(sizes[:-1]))
        files = self.head["files"]
        share = sizes[-1] // len(files)
        for own in range(partition.first // share, -(-partition.last // share)):
            system, where = _open(files[own])
            with system.open_input_file(where) as f:
                for z in range(max(partition.first, own * share), min(partition.last, (own + 1) * share)):
                    raw = f.read_at(plane * kind.itemsize, self.head["offset"] + (z - own * share) * plane * kind.itemsize)
                    values = np.frombuffer(raw, kind).astype("f8")
                    rest, columns = np.arange(plane), []
                    for n in sizes[:-1]:
                        columns.append(pa.array((rest % n).astype("i4")))
                        rest = rest // n
                    columns.append(pa.array(np.full(plane, z, "i4")))
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(values)], names=[*(f"x{d}" for d in range(len(sizes))), "value"])


@dataclass
class Planes(WriterCommitMessage):
    """Files that a task has written, by the plane they hold."""

    files: dict[int, str] = field(default_factory=dict)


class NrrdWriter(DataSourceArrowWriter):
    """Every task writes the planes it holds, each to a file of its own; the header lists the files in order, so nothing is joined.

    The header is written when the job commits, and only then there is a volume; planes that no task had are one file of zeros. A job that fails deletes what its tasks
    have written, a task that fails what it has.
    """

    def __init__(self, path: str, dims: tuple[int, ...], kind: str, value: str):
        self.path, self.dims, self.kind, self.value = path, dims, kind, value
        self.parts = f"{path}.{uuid.uuid4().hex}"

    def _file(self, name: str) -> tuple[fs.FileSystem, str]:
        system, base = _open(self.parts)
        return system, posixpath.join(base, name)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Planes:
        system, base = _open(self.parts)
        system.create_dir(base, recursive=True)
        dtype, size, last = np.dtype("<" + TYPES[self.kind]), int(np.prod(self.dims[:-1])), f"x{len(self.dims) - 1}"
        done, plane, values = Planes(), -1, np.zeros(0, dtype)

        def put() -> None:
            done.files[plane] = f"{plane:09d}-{uuid.uuid4().hex}.raw"
            with system.open_output_stream(posixpath.join(base, done.files[plane])) as f:
                f.write(values.tobytes())

        try:
            for batch in iterator:
                at, step = np.zeros(batch.num_rows, np.int64), 1
                for d, n in enumerate(self.dims[:-1]):
                    at += batch.column(f"x{d}").to_numpy() * step
                    step *= n
                owner, new = batch.column(last).to_numpy(), batch.column(self.value).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(owner)]
                for i, j in zip(cuts, cuts[1:]):
                    if i < j and owner[i] != plane:  # rows are sorted by plane
                        if plane >= 0:
                            put()
                        plane, values = int(owner[i]), np.zeros(size, dtype)
                    values[at[i:j]] = new[i:j]
            if plane >= 0:
                put()
        except BaseException:
            self.abort([done])
            raise
        return done

    def commit(self, messages: list[Planes | None]) -> None:
        files = {k: v for m in messages if m for k, v in m.files.items()}
        if len(files) < self.dims[-1]:
            system, zeros = self._file("zeros.raw")
            system.create_dir(posixpath.dirname(zeros), recursive=True)
            with system.open_output_stream(zeros) as f:
                f.write(bytes(int(np.prod(self.dims[:-1])) * np.dtype(TYPES[self.kind]).itemsize))
        folder = posixpath.basename(self.parts)
        lines = ["NRRD0004", f"type: {self.kind}", f"dimension: {len(self.dims)}", "sizes: " + " ".join(map(str, self.dims)), "endian: little", "encoding: raw"]
        lines += [f"data file: LIST {len(self.dims) - 1}"] + [f"{folder}/{files.get(k, 'zeros.raw')}" for k in range(self.dims[-1])]
        system, where = _open(self.path)
        with system.open_output_stream(where) as f:
            f.write(("\n".join(lines) + "\n").encode())

    def abort(self, messages: list[Planes | None]) -> None:
        for message in messages:
            for name in (message.files if message else {}).values():
                system, where = self._file(name)
                if system.get_file_info(where).type != fs.FileType.NotFound:
                    system.delete_file(where)


class NrrdSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nrrd"

    def schema(self) -> str:
        return ", ".join(f"x{d} int" for d in range(len(header(self.options["path"])["sizes"]))) + ", value double"

    def reader(self, schema) -> NrrdReader:
        return NrrdReader(self.options["path"], int(self.options.get("slabs", "64")))

    def writer(self, schema, overwrite: bool) -> NrrdWriter:
        dims = tuple(int(n) for n in self.options["sizes"].split(","))
        return NrrdWriter(self.options["path"], dims, self.options.get("type", "double"), self.options.get("value", "value"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NrrdSource)


def write_nrrd(field: DataFrame, dims: tuple[int, ...], path: str, value: str = "v", kind: str = "double") -> None:
    """A field as one volume: a header file that lists one raw file for each plane along the last axis, written by tasks. Cells without a row are 0.

    Rows of one plane meet in one task, as large as a plane; only file names reach the driver.
    """
    register(field.sparkSession)
    last = f"x{len(dims) - 1}"
    rows = field.select(*(f"x{d}" for d in range(len(dims))), F.col(value)).repartitionByRange(last).sortWithinPartitions(last)
    out = rows.write.format("nrrd").mode("append").option("sizes", ",".join(map(str, dims))).option("type", kind).option("value", value)
    out.save(path)
