"""Point cloud files (PCD 0.7): ascii, binary and binary_compressed read; binary written.

``spark.read.format("pcd").load(path)`` takes a file, a folder or a pattern; all files have the first one's fields.
Binary files are cut into row ranges, one task each.  A field with COUNT over 1 is an array; clouds of HEIGHT over 1
get ``row`` and ``col``.  Option ``columns`` limits what is decoded.  ``df.write.format("pcd")`` writes one file a task.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import scalar as S
from .headers import delete, exists, files_of, move, open_read, write_whole
from .lzf import decompress

#: Rows of a binary file that one task reads.
ROWS_A_TASK = 4_000_000
BATCH = 65_536

#: File kind and size to array type and column type. Unsigned ones take the next wider column type.
KINDS = {
    ("F", 4): ("<f4", T.FloatType()),
    ("F", 8): ("<f8", T.DoubleType()),
    ("I", 1): ("<i1", T.ByteType()),
    ("I", 2): ("<i2", T.ShortType()),
    ("I", 4): ("<i4", T.IntegerType()),
    ("I", 8): ("<i8", T.LongType()),
    ("U", 1): ("<u1", T.ShortType()),
    ("U", 2): ("<u2", T.IntegerType()),
    ("U", 4): ("<u4", T.LongType()),
    ("U", 8): ("<u8", T.DecimalType(20, 0)),
}


@dataclass
class Header:
    fields: list[str] = field(default_factory=list)
    kinds: list[tuple[str, int]] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    width: int = 0
    height: int = 1
    points: int = 0
    data: str = "ascii"
    offset: int = 0

    def dtype(self) -> np.dtype:
        return np.dtype([(f, KINDS[k][0]) if c == 1 else (f, KINDS[k][0], (c,)) for f, k, c in zip(self.fields, self.kinds, self.counts)])

    def schema(self) -> T.StructType:
        out = [T.StructField(f, KINDS[k][1] if c == 1 else T.ArrayType(KINDS[k][1])) for f, k, c in zip(self.fields, self.kinds, self.counts)]
        return T.StructType([T.StructField(n, T.IntegerType()) for n in (("row", "col") if self.height > 1 else ())] + out)


def read_header(path: str) -> Header:
    found: dict[str, list[str]] = {}
    with open_read(path) as f:
        text = io.BufferedReader(f) if not hasattr(f, "readline") else f
        while True:
            line = text.readline()
            if not line:
                raise ValueError(f"{path}: the header has no DATA line")
            words = line.decode("ascii", "replace").split()
            if not words or words[0].startswith("#"):
                continue
            found[words[0].upper()] = words[1:]
            if words[0].upper() == "DATA":
                break
        offset = text.tell()
    numbers = lambda k, default: [int(v) for v in found.get(k, default)]
    fields = found["FIELDS"]
    kinds = list(zip((t.upper() for t in found["TYPE"]), numbers("SIZE", [])))
    width, height = numbers("WIDTH", ["0"])[0], numbers("HEIGHT", ["1"])[0]
    points = int(found.get("POINTS", [width * height])[0])
    if width * height != points:
        raise ValueError(f"{path}: WIDTH x HEIGHT is not POINTS")
    if not len(fields) == len(kinds) or any(k not in KINDS for k in kinds):
        raise ValueError(f"{path}: fields and types don't fit")
    return Header(fields, kinds, numbers("COUNT", ["1"] * len(fields)), width, height, points, found["DATA"][0].lower(), offset)


def records(path: str, header: Header, start: int, stop: int) -> np.ndarray:
    """Records start .. stop of the file."""
    dtype = header.dtype()
    with open_read(path) as f:
        f.seek(header.offset + (start * dtype.itemsize if header.data == "binary" else 0))
        if header.data == "binary":
            raw = f.read((stop - start) * dtype.itemsize)
            if len(raw) < (stop - start) * dtype.itemsize:
                raise ValueError(f"{path}: the body is too short")
            return np.frombuffer(raw, dtype)
        if header.data == "binary_compressed":
            packed, size = np.frombuffer(f.read(8), "<u4").tolist()
            raw, at = decompress(f.read(packed), size), 0
            out = np.zeros(header.points, dtype)
            for name in dtype.names:
                kind, shape = dtype[name].base, dtype[name].shape
                n = header.points * int(np.prod(shape, dtype=int)) * kind.itemsize
                out[name] = np.frombuffer(raw[at : at + n], kind).reshape(-1, *shape)
                at += n
            return out[start:stop]
        if header.data != "ascii":
            raise ValueError(f"{path}: unknown DATA {header.data}")
        text = f.read().split()
    table = np.array(text[: header.points * sum(header.counts)]).reshape(header.points, -1)
    out, at = np.zeros(header.points, dtype), 0
    for name, count in zip(dtype.names, header.counts):
        part = table[:, at : at + count].astype(dtype[name].base)
        out[name] = part[:, 0] if count == 1 else part
        at += count
    return out[start:stop]


def arrow(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    values = np.ascontiguousarray(values).astype(values.dtype.base.newbyteorder("="))
    if values.ndim == 2:
        flat = arrow(values.ravel(), kind.value_type)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), flat)
    if pa.types.is_decimal(kind):
        from decimal import Decimal

        return pa.array([Decimal(int(v)) for v in values], kind)
    return pa.array(values).cast(kind)


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    stop: int


class PcdReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.files, self.schema = files_of(path, ".pcd"), schema

    def partitions(self):
        out = []
        for f in self.files:
            header = read_header(f)
            step = ROWS_A_TASK if header.data == "binary" else max(1, header.points)
            out += [Piece(f, a, min(header.points, a + step)) for a in range(0, header.points, step)]
        return out or [Piece(self.files[0], 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        header, schema = read_header(partition.path), to_arrow_schema(self.schema)
        rows = records(partition.path, header, partition.start, partition.stop)
        for a in range(0, len(rows), BATCH):
            part = rows[a : a + BATCH]
            place = np.arange(partition.start + a, partition.start + a + len(part))
            grid = {"row": place // max(header.width, 1), "col": place % max(header.width, 1)} if header.height > 1 else {}
            arrays = [pa.array(grid[s.name].astype(np.int32)) if s.name in grid and s.name not in header.fields else arrow(part[s.name], s.type) for s in schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


@dataclass
class Written(WriterCommitMessage):
    path: str
    staged: str
    rows: int


#: Column type to kind letter, size and array type of written files.
OUT = {"float": ("F", 4, "<f4"), "double": ("F", 8, "<f8"), "tinyint": ("I", 1, "<i1"), "smallint": ("I", 2, "<i2"), "int": ("I", 4, "<i4"), "bigint": ("I", 8, "<i8")}


def header_of(names: list[str], kinds: list[str], counts: list[int], rows: int) -> str:
    """The head of a binary file; array columns have as many components as ``counts`` says."""
    lines = ["# .PCD v.7 - Point Cloud Data file format", "VERSION .7", "FIELDS " + " ".join(names)]
    lines += ["SIZE " + " ".join(str(OUT[k][1]) for k in kinds), "TYPE " + " ".join(OUT[k][0] for k in kinds), "COUNT " + " ".join(map(str, counts))]
    lines += [f"WIDTH {rows}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {rows}", "DATA binary"]
    return "\n".join(lines) + "\n"


class PcdWriter(DataSourceArrowWriter):
    """Each task writes a file under a name of its own that readers don't see; ``commit`` gives the files of all tasks
    their names, after the old ones have gone where they are to be overwritten; ``abort`` deletes them."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.names, self.overwrite, self.job = path.rstrip("/"), schema.names, overwrite, uuid.uuid4().hex
        kinds = [f.dataType.simpleString() for f in schema]
        self.arrays, self.kinds = [k.startswith("array<") for k in kinds], [k[6:-1] if k.startswith("array<") else k for k in kinds]
        for n, k, whole in zip(self.names, self.kinds, kinds):
            if k not in OUT:
                raise ValueError(f"column {n}: {whole} has no place in a PCD file")

    def body(self, batch: pa.RecordBatch, counts: list[int]) -> bytes:
        fields = [(n, OUT[k][2]) if c == 1 else (n, OUT[k][2], (c,)) for n, k, c in zip(self.names, self.kinds, counts)]
        out = np.zeros(len(batch), np.dtype(fields))
        for n, k, c, is_array in zip(self.names, self.kinds, counts, self.arrays):
            column = batch[n]
            if is_array:
                if any(v != c for v in pc.list_value_length(column).to_pylist()):
                    raise ValueError(f"column {n}: arrays differ in length")
                column = pc.list_flatten(column)
            if column.null_count and OUT[k][0] != "F":
                raise ValueError(f"column {n}: a null has no place in a PCD file")
            values = column.to_numpy(zero_copy_only=False)  # nulls of floats are NaN
            out[n] = values.reshape(len(batch), c) if is_array and c > 1 else values
        return out.tobytes()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        parts, counts, rows = [], [1] * len(self.names), 0
        for batch in iterator:
            if not len(batch):
                continue
            if not parts:
                counts = [len(batch[n][0]) if is_array else 1 for n, is_array in zip(self.names, self.arrays)]
            parts.append(self.body(batch, counts))
            rows += len(batch)
        name = f"{self.path}/part-{TaskContext.get().partitionId():05d}-{self.job}.pcd"
        staged = f"{name}.{uuid.uuid4().hex}.staged"
        if rows:
            write_whole(staged, header_of(self.names, self.kinds, counts, rows).encode() + b"".join(parts))
        return Written(name, staged, rows)

    def commit(self, messages: list[Written | None]) -> None:
        new = [m for m in messages if m is not None and m.rows]
        old = files_of(self.path, ".pcd") if self.overwrite and exists(self.path) else []
        for m in new:
            move(m.staged, m.path)
        for f in old:
            delete(f)
        if not new and (self.overwrite or not exists(self.path) or not files_of(self.path, ".pcd")):
            write_whole(f"{self.path}/part-00000-{self.job}.pcd", header_of(self.names, self.kinds, [1] * len(self.names), 0).encode())  # an empty table

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.rows:
                delete(m.staged)


class PcdSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcd"

    def schema(self) -> T.StructType:
        header = read_header(files_of(self.options["path"], ".pcd")[0])
        schema, wanted = header.schema(), self.options.get("columns")
        return schema if not wanted else T.StructType([schema[c.strip()] for c in wanted.split(",")])

    def reader(self, schema: T.StructType) -> PcdReader:
        return PcdReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> PcdWriter:
        return PcdWriter(self.options["path"], schema, overwrite)


def cloud_compare(points: DataFrame, intensity: str | None = None, *, low: float | None = None, high: float | None = None, color_map=None, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """x, y, z and rgb as floats; rgb holds the bytes of the packed colour of the intensity, 0 without one."""
    base = [F.col(c).cast("float").alias(n) for c, n in zip(xyz, "xyz")]
    if intensity is None:
        return points.select(*base, F.lit(0.0).cast("float").alias("rgb"))
    if low is None or high is None:
        ends = points.agg(F.min(intensity).alias("a"), F.max(intensity).alias("b")).first()
        low, high = ends["a"] if low is None else low, ends["b"] if high is None else high
    packed = S.packed_rgb(*S.color_of(F.col(intensity), low, high, color_map))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at in batches:
            whole = at["rgb"].to_numpy(zero_copy_only=False).astype("<u4")  # bytes of a NaN, if red is 128 or more: they stay as they are
            yield pa.RecordBatch.from_arrays([*at.columns[:3], pa.Array.from_buffers(pa.float32(), len(at), [None, pa.py_buffer(whole.tobytes())])], ["x", "y", "z", "rgb"])

    return points.select(*base, packed.alias("rgb")).mapInArrow(bits, "x float, y float, z float, rgb float")
