"""Polygon files (PLY 1.0): ascii and binary of either byte order read; binary little-endian written.

``spark.read.format("ply").option("element", "vertex").load(path)`` gives one element's rows with its properties.  An
element that is a list (faces) gives ``tri``: each polygon as triangles that share its first corner.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .headers import delete, delete_folder, files_of, join_files, open_read, write_whole
from .pcd import BATCH, arrow

#: Property type to array type.
TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8"}
#: Array type to column type.
COLUMNS = {"i1": T.ByteType(), "u1": T.ShortType(), "i2": T.ShortType(), "u2": T.IntegerType(), "i4": T.IntegerType(), "u4": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}
#: Column type to property type of written files.
COLUMN_TYPES = {"tinyint": "char", "smallint": "short", "int": "int", "bigint": "uint", "float": "float", "double": "double"}


@dataclass
class Element:
    name: str
    count: int
    properties: list[tuple[str, str]] = field(default_factory=list)
    list_type: tuple[str, str] | None = None

    def schema(self) -> T.StructType:
        if self.list_type:
            return T.StructType([T.StructField("tri", T.ArrayType(T.IntegerType()))])
        return T.StructType([T.StructField(n, COLUMNS[t]) for n, t in self.properties])


@dataclass
class Header:
    format: str = ""
    comment: str = ""
    elements: list[Element] = field(default_factory=list)
    offset: int = 0


def read_header(path: str) -> Header:
    header, comments = Header(), []
    with open_read(path) as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path}: not a PLY file")
        while True:
            line = f.readline()
            if not line:
                raise ValueError(f"{path}: the header has no end")
            words = line.decode("ascii", "replace").split()
            if not words:
                continue
            key, rest = words[0], words[1:]
            if key == "end_header":
                break
            if key == "format":
                header.format = rest[0]
            elif key == "comment":
                comments.append(" ".join(rest))
            elif key == "element":
                header.elements.append(Element(rest[0], int(rest[1])))
            elif key == "property" and rest[0] == "list":
                element = header.elements[-1]
                if element.properties or element.list_type:
                    raise ValueError(f"{path}: element {element.name} mixes a list with other properties")
                element.list_type = (TYPES[rest[1]], TYPES[rest[2]])
            elif key == "property":
                header.elements[-1].properties.append((rest[1], TYPES[rest[0]]))
            else:
                raise ValueError(f"{path}: unknown header line {key}")
        header.offset = f.tell()
    header.comment = "\n".join(comments)
    return header


def fan(corners: list[int]) -> list[list[int]]:
    if len(corners) < 3:
        raise ValueError("a polygon needs three corners")
    return [[corners[0], corners[i], corners[i + 1]] for i in range(1, len(corners) - 1)]


def read_element(path: str, wanted: str):
    """Records of a plain element, or triangles of a list element."""
    header = read_header(path)
    if wanted not in [e.name for e in header.elements]:
        raise ValueError(f"{path} has no element {wanted}")
    with open_read(path) as f:
        f.seek(header.offset)
        body = f.read()
    if header.format == "ascii":
        at = iter(body.decode("ascii").split("\n"))
        for e in header.elements:
            lines = [next(at) for _ in range(e.count)]
            if e.name == wanted:
                if e.list_type:
                    return [t for line in lines for t in fan([int(v) for v in line.split()[1:]])]
                return np.array([tuple(line.split()) for line in lines], [(n, t) for n, t in e.properties])
    order, at = {"binary_little_endian": "<", "binary_big_endian": ">"}[header.format], 0
    for e in header.elements:
        if e.list_type:
            size, item = (np.dtype(order + t) for t in e.list_type)
            out = []
            for _ in range(e.count):
                n = int(np.frombuffer(body, size, 1, at)[0])
                at += size.itemsize
                if e.name == wanted:
                    out += fan(np.frombuffer(body, item, n, at).tolist())
                at += n * item.itemsize
            if e.name == wanted:
                return out
        else:
            dtype = np.dtype([(n, order + t) for n, t in e.properties])
            if e.name == wanted:
                return np.frombuffer(body, dtype, e.count, at)
            at += dtype.itemsize * e.count
    raise AssertionError


@dataclass
class WholeFile(InputPartition):
    path: str


class PlyReader(DataSourceReader):
    def __init__(self, path: str, element: str, schema: T.StructType):
        self.files, self.element, self.schema = files_of(path, ".ply"), element, schema

    def partitions(self):
        return [WholeFile(f) for f in self.files]

    def read(self, partition: WholeFile) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows, schema = read_element(partition.path, self.element), to_arrow_schema(self.schema)
        for a in range(0, len(rows), BATCH):
            part = rows[a : a + BATCH]
            arrays = [pa.array(part, schema[0].type)] if isinstance(part, list) else [arrow(part[s.name], s.type) for s in schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> T.StructType:
        element = self.options.get("element", "vertex")
        header = read_header(files_of(self.options["path"], ".ply")[0])
        return next(e for e in header.elements if e.name == element).schema()

    def reader(self, schema: T.StructType) -> PlyReader:
        return PlyReader(self.options["path"], self.options.get("element", "vertex"), schema)


#: Range of the unsigned property types.
UNSIGNED = {"uchar": 255, "ushort": 65_535, "uint": 4_294_967_295}


def _staged(rows: DataFrame, encode, folder: str) -> list[tuple[int, int]]:
    """(part, rows) of files that the tasks have written into ``folder``, one a partition, in order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, body = TaskContext.get().partitionId(), 0, []
        for at in batches:
            if len(at):
                body.append(encode(at))
                n += len(at)
        if n:
            write_whole(f"{folder}/{part:06d}.staged", b"".join(body))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n": pa.array([n], pa.int64())})

    return sorted((r["part"], r["n"]) for r in rows.mapInArrow(write, "part long, n long").collect())  # one row a partition


def _plain(name: str, df: DataFrame, order: str | None, types: dict[str, str], folder: str) -> tuple[list[str], list[str]]:
    """Header lines of an element, and the files of its body."""
    rows = df.orderBy(order).drop(order) if order else df
    properties = []
    for c, k in rows.dtypes:
        if k not in COLUMN_TYPES:
            raise ValueError(f"column {c}: {k} has no place in a PLY file")
        properties.append((c, types.get(c, COLUMN_TYPES[k])))
    kinds = [(c, "<" + TYPES[p]) for c, p in properties]

    def encode(at: pa.RecordBatch) -> bytes:
        out = np.zeros(len(at), kinds)
        for c, p in properties:
            values = at[c].to_numpy(zero_copy_only=False)
            if p in UNSIGNED and len(values) and not (values.min() >= 0 and values.max() <= UNSIGNED[p]):
                raise ValueError(f"column {c}: a value is no {p}")
            out[c] = values
        return out.tobytes()

    parts = _staged(rows, encode, f"{folder}/{name}")
    return [f"element {name} {sum(n for _, n in parts)}", *[f"property {p} {c}" for c, p in properties]], [f"{folder}/{name}/{k:06d}.staged" for k, _ in parts]


def _face_bytes(at: pa.RecordBatch) -> bytes:
    lengths = pc.list_value_length(at.column(0)).to_numpy(zero_copy_only=False)
    corners = pc.list_flatten(at.column(0)).to_numpy().astype("<i4")
    if len(set(lengths.tolist())) == 1:
        n = int(lengths[0])
        out = np.zeros(len(at), [("n", "u1"), ("c", "<i4", (n,))])
        out["n"], out["c"] = n, corners.reshape(-1, n)
        return out.tobytes()
    ends = np.cumsum(lengths)
    return b"".join(struct.pack("<B", n) + corners[e - n : e].tobytes() for n, e in zip(lengths.tolist(), ends.tolist()))


def write_ply(path: str, vertex: DataFrame, face: DataFrame | None = None, edge: DataFrame | None = None, *, comment: str = "", order: str | None = None, types: dict[str, str] | None = None) -> None:
    """One binary little-endian file. ``face`` has one array column of up to 255 corners; ``order`` names a column of
    each table that orders its rows and is left out; ``types`` gives columns a property type, such as uchar for colours.

    Tasks encode the rows into files beside the target; one task joins them, and the target appears whole.
    """
    spark, folder, types = vertex.sparkSession, f"{path}.{uuid.uuid4().hex}.parts", types or {}
    head, files = _plain("vertex", vertex, order, types, folder)
    lines = ["ply", "format binary_little_endian 1.0", *[f"comment {c}" for c in comment.split("\n") if comment], *head]
    if face is not None:
        rows = face.orderBy(order).drop(order) if order else face
        parts = _staged(rows, _face_bytes, f"{folder}/face")
        lines += [f"element face {sum(n for _, n in parts)}", "property list uchar int vertex_index"]
        files += [f"{folder}/face/{k:06d}.staged" for k, _ in parts]
    if edge is not None:
        head, more = _plain("edge", edge, order, types, folder)
        lines, files = lines + head, files + more
    start = ("\n".join([*lines, "end_header"]) + "\n").encode()

    def join(batches):
        yield from batches
        join_files(path, start, files)

    spark.range(1).coalesce(1).mapInArrow(join, "id long").collect()
    for f in files:
        delete(f)
    delete_folder(folder)
