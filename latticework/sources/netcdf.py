"""NetCDF classic volumes (CDF-1 and CDF-2) as a Spark data source, read by hyperslab and written in many files.

``spark.read.format("netcdf").option("variable", "QVAPOR,U").load(path)`` gives a column for each dimension of the variables, by its name, and one for each variable. A
value that equals the variable's ``missing_value`` or ``_FillValue`` is null. ``option("slab", "t=0:1,z=12:13")`` reads coordinates 0 and 12 only: only the bytes of the
runs of cells that lie in the slab are read. With ``option("filters", "true")`` filters on dimensions do the same; Spark asks for
``spark.sql.python.filterPushdown.enabled`` then.

``path`` is a file, or a folder whose files hold consecutive records, as models write them: the global attribute ``first_record`` says where a file's records begin
(without it, files follow each other by name). Writing makes such a folder: every task its own files, which count only when the job commits.
Paths are opened by pyarrow's file systems.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

#: External types of the format: number, numpy's name, letter of its fill value's packing (fixed values).
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
#: Tags of the header's lists (fixed values).
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
#: Values of one Arrow batch, more or less.
AT_ONCE = 1 << 18


def _open(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    kind: int
    begin: int = 0
    size: int = 0

    def dtype(self) -> np.dtype:
        return np.dtype(TYPES[self.kind])

    def missing(self) -> list[float]:
        return [float(np.ravel(self.attributes[a])[0]) for a in ("missing_value", "_FillValue") if a in self.attributes and self.kind != 2]


@dataclass
class Header:
    """Dimensions (name, length; the record dimension has length 0 in the list), global attributes and variables of one file."""

    records: int
    dims: list[tuple[str, int]]
    attributes: dict
    variables: dict[str, Variable]
    version: int = 2
    path: str = ""
    first: int = 0

    def record_size(self) -> int:
        own = [v for v in self.variables.values() if v.dims and self.dims[v.dims[0]][1] == 0]
        return self.extent(own[0], exact=True) if len(own) == 1 else sum(v.size for v in own)

    def extent(self, v: Variable, exact: bool = False) -> int:
        """Bytes of a variable, of one record if it has records; rounded up to four unless exact."""
        n = v.dtype().itemsize
        for d in v.dims:
            n *= self.dims[d][1] or 1
        return n if exact else n + -n % 4

    def is_record(self, v: Variable) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]][1] == 0

    def shape(self, v: Variable) -> list[int]:
        return [self.dims[d][1] or self.records for d in v.dims]


class _Bytes:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise EOFError
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, form: str = ">i") -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def padded(self, n: int) -> bytes:
        out = self.take(n)
        self.take(-n % 4)
        return out

    def name(self) -> str:
        return self.padded(self.number()).decode()

    def listed(self, tag: int) -> range:
        found, n = self.number(), self.number()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("no NetCDF header")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.listed(ATTRIBUTE):
            name, kind, n = self.name(), self.number(), self.number()
            raw = self.padded(n * np.dtype(TYPES[kind]).itemsize)
            out[name] = raw.decode() if kind == 2 else np.frombuffer(raw, TYPES[kind])
        return out


def parsed(raw: bytes) -> Header:
    """A header from a file's first bytes; EOFError if these are too few."""
    b = _Bytes(raw)
    magic = b.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2):
        raise ValueError("only CDF-1 and CDF-2 are read")
    records = b.number(">I")
    dims = [(b.name(), b.number()) for _ in b.listed(DIMENSION)]
    out = Header(records, dims, b.attributes(), {}, magic[3])
    for _ in b.listed(VARIABLE):
        name = b.name()
        v = Variable(name, [b.number() for _ in range(b.number())], b.attributes(), b.number())
        v.size, v.begin = b.number(">I"), b.number(">q" if magic[3] == 2 else ">i")
        v.size = out.extent(v)  # what the file says is redundant, and wrong beyond 4 GB
        out.variables[name] = v
    return out


def headers(path: str) -> list[Header]:
    """Of a file, or of all files of a folder in the order of their records."""
    system, where = _open(path)
    info = system.get_file_info(where)
    names = [where] if info.type != fs.FileType.Directory else sorted(f.path for f in system.get_file_info(fs.FileSelector(where)) if f.path.endswith(".nc"))
    if not names:
        raise ValueError(f"{path} has no NetCDF files")
    out, records = [], 0
    for name in names:
        with system.open_input_file(name) as f:
            size, length = 1 << 16, f.size()
            while True:
                try:
                    head = parsed(f.read_at(min(size, length), 0))
                    break
                except EOFError:
                    if size >= length:
                        raise ValueError(f"{name} ends within its header") from None
                    size *= 4
            if head.records == 0xFFFFFFFF:  # written as a stream: as many records as the file holds
                begin = min((v.begin for v in head.variables.values() if head.is_record(v)), default=length)
                head.records = (length - begin) // max(1, head.record_size())
        head.path = name
        head.first = int(np.ravel(head.attributes["first_record"])[0]) if "first_record" in head.attributes else records
        records = head.first + head.records
        out.append(head)
    return sorted(out, key=lambda h: h.first)


class Piece(InputPartition):
    """Rows ``lo`` to ``hi`` along the slowest dimension of file number ``file``."""

    def __init__(self, file: int, lo: int, hi: int):
        super().__init__((file, lo, hi))
        self.file, self.lo, self.hi = file, lo, hi


class NetcdfReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], slab: dict[str, tuple[int, int]], pieces: int):
        self.path, self.names, self.pieces = path, names, pieces
        self.heads = headers(path)
        first = self.heads[0]
        self.dims = [first.dims[d][0] for d in first.variables[names[0]].dims]
        self.slab = {d: slab.get(d, (0, 1 << 62)) for d in self.dims}

    def bounds(self, head: Header) -> list[tuple[int, int]]:
        """What the slab leaves of a file, by dimension; the slowest counts from the file's first record."""
        out = []
        for k, (d, n) in enumerate(zip(self.dims, head.shape(head.variables[self.names[0]]), strict=True)):
            shift = head.first if k == 0 else 0
            lo, hi = self.slab[d]
            out.append((max(0, lo - shift), max(0, min(n, hi - shift))))
        return out

    def partitions(self) -> list[Piece]:
        """Pieces of about equal size; of files that the slab leaves nothing of, none."""
        out = []
        ranges = [self.bounds(h) for h in self.heads]
        total = sum(b[0][1] - b[0][0] for b in ranges if all(hi > lo for lo, hi in b))
        for i, b in enumerate(ranges):
            if not all(hi > lo for lo, hi in b):
                continue
            (lo, hi), step = b[0], max(1, total // self.pieces)
            out += [Piece(i, k, min(hi, k + step)) for k in range(lo, hi, step)]
        return out or [Piece(0, 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        head = self.heads[partition.file]
        variables = [head.variables[n] for n in self.names]
        bounds = self.bounds(head)
        system, _ = _open(self.path)
        with system.open_input_file(head.path) as f:
            for k in range(partition.lo, partition.hi):
                for columns in self._rows(f, head, variables, bounds[1:], k):
                    yield pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], names=[*self.dims, *self.names])

    def _rows(self, f, head: Header, variables: list[Variable], rest: list[tuple[int, int]], k: int) -> Iterator[list]:
        """Columns of the slab's part at k along the slowest dimension, in batches. Runs of bytes that lie together are read together."""
        shape = head.shape(variables[0])[1:]
        inner = len(rest)  # dimensions from here on are read whole, so they are one run
        while inner and rest[inner - 1] == (0, shape[inner - 1]):
            inner -= 1
        tail = int(np.prod(shape[inner:], dtype=np.int64))
        if inner:  # the dimension before them is read from its lower to its upper bound
            lo, hi = rest[inner - 1]
            tail, lead = tail * (hi - lo), rest[: inner - 1]
        else:
            lo, lead = 0, []
        outer = [hi - lo for lo, hi in lead]
        count = int(np.prod(outer, dtype=np.int64))
        strides = [int(np.prod(shape[d + 1 :], dtype=np.int64)) for d in range(len(shape))]
        for first in range(0, count, max(1, AT_ONCE // max(1, tail))):
            last = min(count, first + max(1, AT_ONCE // max(1, tail)))
            starts = []
            for i in range(first, last):
                at, left = (lo * strides[inner - 1] if inner else 0), i
                for d in reversed(range(len(outer))):
                    at += (lead[d][0] + left % outer[d]) * strides[d]
                    left //= outer[d]
                starts.append(at)
            place = (np.array(starts, np.int64)[:, None] + np.arange(tail)).ravel()
            out = [np.full(len(place), k + head.first, np.int32)]
            for d, n in enumerate(shape):
                out.append((place // strides[d] % n).astype(np.int32))
            for v in variables:
                kind = v.dtype()
                base = v.begin + k * (head.record_size() if head.is_record(v) else int(np.prod(shape, dtype=np.int64)) * kind.itemsize)
                raw = b"".join(f.read_at(tail * kind.itemsize, base + at * kind.itemsize) for at in starts)
                values = np.frombuffer(raw, kind)
                if v.kind == 2:
                    out.append(pa.array([x.decode("latin-1") for x in values.tolist()], pa.string()))
                    continue
                gone = np.zeros(len(values), bool)
                for m in v.missing():
                    gone |= np.isnan(values.astype(float)) if np.isnan(m) else values == kind.type(m)
                out.append(pa.array(values.astype(kind.newbyteorder("=")), mask=gone))
            yield out


class FilteringReader(NetcdfReader):
    """A reader to which Spark hands down filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes ranges of dimensions; Spark checks what is left."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            lo, hi = self.slab.get(name, (0, 0))
            if name not in self.slab or (isinstance(f, In) and not f.value) or getattr(f, "value", None) is None:
                yield f
                continue
            if isinstance(f, EqualTo):
                self.slab[name] = (max(lo, f.value), min(hi, f.value + 1))
            elif isinstance(f, GreaterThan):
                self.slab[name] = (max(lo, f.value + 1), hi)
            elif isinstance(f, GreaterThanOrEqual):
                self.slab[name] = (max(lo, f.value), hi)
            elif isinstance(f, LessThan):
                self.slab[name] = (lo, min(hi, f.value))
            elif isinstance(f, LessThanOrEqual):
                self.slab[name] = (lo, min(hi, f.value + 1))
            else:
                if isinstance(f, In):
                    self.slab[name] = (max(lo, min(f.value)), min(hi, max(f.value) + 1))
                yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int]] = field(default_factory=list)


def packed_header(dims: list[tuple[str, int]], names: list[str], kind: int, missing: float | None, first: int, records: int) -> bytes:
    """The header of a CDF-2 file whose variables all have all dimensions, the first being that of records."""

    def name(text: str) -> bytes:
        raw = text.encode()
        return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def listed(tag: int, parts: list[bytes]) -> bytes:
        return struct.pack(">ii", tag if parts else 0, len(parts)) + b"".join(parts)

    def attribute(label: str, number: int, value: float) -> bytes:
        raw = np.array([value], TYPES[number]).tobytes()
        return name(label) + struct.pack(">ii", number, 1) + raw + b"\0" * (-len(raw) % 4)

    dtype = np.dtype(TYPES[kind])
    plane = int(np.prod([n for _, n in dims[1:]], dtype=np.int64)) * dtype.itemsize
    size = plane if len(names) == 1 else plane + -plane % 4
    own = [attribute("missing_value", kind, missing)] if missing is not None else []

    def whole(begin: int) -> bytes:
        variables = []
        for i, n in enumerate(names):
            variables.append(
                name(n) + struct.pack(f">i{len(dims)}i", len(dims), *range(len(dims))) + listed(ATTRIBUTE, own) + struct.pack(">iIq", kind, min(size + -size % 4, 0xFFFFFFFF), begin + i * size)
            )
        shape = [name(d) + struct.pack(">i", 0 if i == 0 else n) for i, (d, n) in enumerate(dims)]
        return b"CDF\2" + struct.pack(">I", records) + listed(DIMENSION, shape) + listed(ATTRIBUTE, [attribute("first_record", 4, first)]) + listed(VARIABLE, variables)

    return whole(len(whole(0)))


class NetcdfWriter(DataSourceArrowWriter):
    """Every task writes a file for each run of records it holds, under a name of its own; a commit lists them, an abort deletes them."""

    def __init__(self, path: str, dims: list[tuple[str, int]], names: list[str], kind: int, missing: float | None):
        self.path, self.dims, self.names, self.kind, self.missing = path.rstrip("/"), dims, names, kind, missing

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _open(self.path)
        system.create_dir(base, recursive=True)
        dtype = np.dtype(TYPES[self.kind])
        shape = [n for _, n in self.dims[1:]]
        plane = int(np.prod(shape, dtype=np.int64))
        pad = b"\0" * (-plane * dtype.itemsize % 4) if len(self.names) > 1 else b""
        done = Written()

        def put(record: int, values: list[np.ndarray]) -> None:
            target = posixpath.join(base, f"r{record:09d}-{uuid.uuid4().hex}.part")
            done.files.append((target, record, 1))
            with system.open_output_stream(target) as f:
                f.write(packed_header(self.dims, self.names, self.kind, self.missing, record, 1))
                for v in values:
                    f.write(v.tobytes() + pad)

        empty = 0 if self.missing is None else self.missing
        record, held = -1, []
        try:
            for batch in iterator:
                at = np.zeros(batch.num_rows, np.int64)
                for d, n in enumerate(shape, 1):
                    at = at * n + batch.column(self.dims[d][0]).to_numpy()
                owner = batch.column(self.dims[0][0]).to_numpy()
                cuts = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(owner)]
                for i, j in zip(cuts, cuts[1:]):
                    if i == j:
                        continue
                    if owner[i] != record:  # rows are sorted by record
                        if record >= 0:
                            put(record, held)
                        record, held = int(owner[i]), [np.full(plane, empty, dtype) for _ in self.names]
                    for v, name in zip(held, self.names, strict=True):
                        column = batch.column(name).slice(i, j - i)
                        v[at[i:j]] = column.fill_null(empty).to_numpy() if column.null_count else column.to_numpy()
            if record >= 0:
                put(record, held)
        except BaseException:
            for file, _, _ in done.files:
                system.delete_file(file)
            raise
        return done

    def commit(self, messages: list[Written | None]) -> None:
        """Gives the files their names: they count from now on. Records that no task had are none."""
        system, base = _open(self.path)
        for message in messages:
            for file, record, _ in message.files if message else []:
                system.move(file, posixpath.join(base, f"record-{record:09d}.nc"))

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _open(self.path)
        for message in messages:
            for file, _, _ in message.files if message else []:
                if system.get_file_info(file).type != fs.FileType.NotFound:
                    system.delete_file(file)


class NetcdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _names(self) -> list[str]:
        return [n.strip() for n in self.options["variable"].split(",")]

    def schema(self) -> str:
        head, names = headers(self.options["path"])[0], self._names()
        own = [head.variables[n] for n in names]
        if any(v.dims != own[0].dims for v in own) or not own[0].dims:
            raise ValueError("variables must have the same dimensions")
        kinds = {"i1": "tinyint", "S1": "string", ">i2": "smallint", ">i4": "int", ">f4": "float", ">f8": "double"}
        return ", ".join([f"`{head.dims[d][0]}` int" for d in own[0].dims] + [f"`{v.name}` {kinds[TYPES[v.kind]]}" for v in own])

    def reader(self, schema) -> NetcdfReader:
        slab = {}
        for part in filter(None, self.options.get("slab", "").split(",")):
            name, _, bounds = part.partition("=")
            lo, _, hi = bounds.partition(":")
            slab[name.strip()] = (int(lo), int(hi) if hi else int(lo) + 1)
        kind = FilteringReader if self.options.get("filters") == "true" else NetcdfReader
        return kind(self.options["path"], self._names(), slab, int(self.options.get("pieces", "64")))

    def writer(self, schema, overwrite: bool) -> NetcdfWriter:
        missing = self.options.get("missing")
        dims = [(d, int(n)) for d, n in json.loads(self.options["dims"])]
        kind = {"short": 3, "int": 4, "float": 5, "double": 6}[self.options.get("type", "double")]
        return NetcdfWriter(self.options["path"], dims, self._names(), kind, None if missing is None else float(missing))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NetcdfSource)


def write(volume: DataFrame, path: str, dims: dict[str, int], variables: list[str], kind: str = "double", missing: float | None = None) -> None:
    """A volume with a column for each dimension and variable, as a folder of files of one record each; cells without a row and null values hold ``missing`` (0 if None).

    The first of ``dims`` is the record dimension, and rows of one record meet in one task, as large as a record. Nothing but file names reaches the driver.
    """
    register(volume.sparkSession)
    first = next(iter(dims))
    rows = volume.select(*dims, *variables).repartitionByRange(first).sortWithinPartitions(first)
    out = rows.write.format("netcdf").mode("append").option("dims", json.dumps(list(dims.items()))).option("variable", ",".join(variables)).option("type", kind)
    (out if missing is None else out.option("missing", str(missing))).save(path)
