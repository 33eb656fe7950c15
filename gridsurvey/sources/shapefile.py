"""Shapefiles in and out, as a data source in Spark's Python interface.

Reading splits every file into ranges of records by its index file, so a large
file is read by many tasks, each holding a few records. Writing gives one set of
files (``.shp``, ``.shx``, ``.dbf``) per task and ``FILE_BYTES``, under names of
its own, and lists them in a manifest when the job commits: tasks that are
repeated or lost leave no rows behind. Any path that pyarrow's file systems
open will do; all executors must see it.

What the format holds follows the public description of shapefiles and dBase
tables: shapes are polygons (with or without Z and M, which are not read) or
missing; attributes are text, numbers, booleans and dates.
"""

from __future__ import annotations

import datetime
import json
import math
import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as files
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Workers get this module with the job; they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of shapes that one task reads, and that one written file may hold.
PARTITION_BYTES, FILE_BYTES = 32 << 20, 64 << 20
#: Records fetched at once.
FETCH = 256
#: Fixed values of the formats: file code, version, shape types, lengths in bytes.
FILE_CODE, VERSION, NULL_SHAPE, POLYGON, POLYGONS = 9994, 1000, 0, 5, (5, 15, 25)
HEADER, INDEX_RECORD, FIELD = 100, 8, 32
MANIFEST = "_written.json"
RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))


@dataclass
class Field:
    name: str
    kind: str
    length: int
    decimals: int


@dataclass
class Records(InputPartition):
    """Records ``first`` to ``last`` (not included) of one file."""

    stem: str
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    stems: list[str]


def _at(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path)


def _stems(path: str) -> list[str]:
    """The files below a folder that count, or the one file, without their endings."""
    system, base = _at(path)
    if base.lower().endswith(".shp"):
        return [base[:-4]]
    base = base.rstrip("/")
    if system.get_file_info(f"{base}/{MANIFEST}").type == files.FileType.File:
        with system.open_input_stream(f"{base}/{MANIFEST}") as f:
            return [f"{base}/{name}" for name in json.loads(f.read())]
    return sorted(i.path[:-4] for i in system.get_file_info(files.FileSelector(base)) if i.path.lower().endswith(".shp"))


def _fields(system: files.FileSystem, stem: str) -> tuple[list[Field], int, int]:
    """Fields of a dBase table, bytes of its header and of a record."""
    with system.open_input_file(f"{stem}.dbf") as f:
        header, record = struct.unpack("<HH", f.read(32)[8:12])
        raw = f.read(header - 32)
    fields = []
    for at in range(0, len(raw) - FIELD + 1, FIELD):
        if raw[at] == 0x0D:
            break
        name = raw[at:at + 11].split(b"\0")[0].decode("ascii")
        fields.append(Field(name, chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
    return fields, header, record


def _type(field: Field) -> T.DataType:
    if field.kind == "N" and field.decimals == 0:
        return T.LongType()
    known = {"N": T.DoubleType(), "F": T.DoubleType(), "L": T.BooleanType(), "D": T.DateType()}
    return known.get(field.kind, T.StringType())


def _value(field: Field, raw: bytes, encoding: str):
    """One attribute; blanks and fills are null, as the format has no other sign for it."""
    text = raw.decode(encoding).strip("\0 ")
    if not text or (field.kind in "NF" and text.strip("*") == ""):
        return None
    if field.kind in "NF":
        return int(text) if field.kind == "N" and field.decimals == 0 else float(text)
    if field.kind == "L":
        return True if text in "YyTt" else False if text in "NnFf" else None
    if field.kind == "D":
        return None if text == "00000000" else datetime.datetime.strptime(text, "%Y%m%d").date()
    return text


def _rings(content: bytes) -> list[list[tuple[float, float]]] | None:
    (kind,) = struct.unpack_from("<i", content)
    if kind == NULL_SHAPE:
        return None
    if kind not in POLYGONS:
        raise ValueError(f"shape type {kind} is not a polygon")
    n_rings, n_points = struct.unpack_from("<ii", content, 36)
    starts = [*struct.unpack_from(f"<{n_rings}i", content, 44), n_points]
    flat = struct.unpack_from(f"<{2 * n_points}d", content, 44 + 4 * n_rings)
    points = list(zip(flat[::2], flat[1::2], strict=True))
    return [points[a:b] for a, b in zip(starts, starts[1:])]


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int, encoding: str):
        self.path, self.partition_bytes, self.encoding = path, partition_bytes, encoding

    def partitions(self) -> list[Records]:
        system, _ = _at(self.path)
        out = []
        for stem in _stems(self.path):
            index, shapes = system.get_file_info([f"{stem}.shx", f"{stem}.shp"])
            n = (index.size - HEADER) // INDEX_RECORD
            parts = min(n, math.ceil(shapes.size / self.partition_bytes))
            out += [Records(stem, n * i // parts, n * (i + 1) // parts) for i in range(parts)]
        return out

    def read(self, partition: Records) -> Iterator[tuple]:
        system, _ = _at(self.path)
        stem = partition.stem
        fields, header, width = _fields(system, stem)
        with (system.open_input_file(f"{stem}.shx") as index, system.open_input_file(f"{stem}.shp") as shapes,
              system.open_input_file(f"{stem}.dbf") as table):
            for first in range(partition.first, partition.last, FETCH):
                n = min(FETCH, partition.last - first)
                index.seek(HEADER + INDEX_RECORD * first)
                places = list(struct.iter_unpack(">ii", index.read(INDEX_RECORD * n)))
                table.seek(header + width * first)
                rows = table.read(width * n)
                for i, (place, words) in enumerate(places):
                    row = rows[width * i:width * (i + 1)]
                    if row[:1] == b"*":
                        continue
                    shapes.seek(2 * place + 8)
                    values, at = [], 1
                    for field in fields:
                        values.append(_value(field, row[at:at + field.length], self.encoding))
                        at += field.length
                    yield (*values, _rings(shapes.read(2 * words)))


def _field_of(column: T.StructField) -> Field:
    if len(column.name.encode("ascii")) > 10:
        raise ValueError(f"names have at most 10 letters: {column.name}")
    kinds = [(T.StringType, "C", 254), (T.IntegralType, "N", 20), (T.FractionalType, "F", 24), (T.BooleanType, "L", 1), (T.DateType, "D", 8)]
    for kind, letter, length in kinds:
        if isinstance(column.dataType, kind):
            return Field(column.name, letter, length, 0)
    raise ValueError(f"no attribute can hold {column.dataType.simpleString()}: {column.name}")


def _text(field: Field, value) -> bytes:
    if value is None:
        text = ""
    elif field.kind == "L":
        text = "T" if value else "F"
    elif field.kind == "D":
        text = value.strftime("%Y%m%d")
    else:
        text = repr(float(value)) if field.kind == "F" else str(value)
    raw = text.encode()
    if len(raw) > field.length:
        raise ValueError(f"{field.name} has {len(raw)} bytes, more than {field.length}")
    return raw.rjust(field.length) if field.kind in "NF" else raw.ljust(field.length)


def _shape(rings) -> bytes:
    """A polygon's record content; no rings are a missing shape."""
    if not rings:
        return struct.pack("<i", NULL_SHAPE)
    points = [(p["x"], p["y"]) for ring in rings for p in ring]
    starts, at = [], 0
    for ring in rings:
        starts.append(at)
        at += len(ring)
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    box = (min(xs), min(ys), max(xs), max(ys))
    return struct.pack(f"<i4dii{len(starts)}i{2 * len(points)}d", POLYGON, *box, len(starts), len(points), *starts, *[v for p in points for v in p])


class ShapefileWriter(DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        if "rings" not in schema.names:
            raise ValueError("a column 'rings' must hold the shapes")
        self.path, self.overwrite = path, overwrite
        self.fields = [_field_of(c) for c in schema.fields if c.name != "rings"]

    def write(self, iterator: Iterator[T.Row]) -> Written:
        system, base = _at(self.path)
        system.create_dir(base, recursive=True)
        done, shapes, rows, size = [], [], [], 0
        for row in iterator:
            shapes.append(_shape(row["rings"]))
            rows.append(b" " + b"".join(_text(f, row[f.name]) for f in self.fields))
            size += len(shapes[-1]) + len(rows[-1])
            if size >= FILE_BYTES:
                done.append(self._store(system, base, shapes, rows))
                shapes, rows, size = [], [], 0
        if shapes:
            done.append(self._store(system, base, shapes, rows))
        return Written(done)

    def _store(self, system: files.FileSystem, base: str, shapes: list[bytes], rows: list[bytes]) -> str:
        name = f"part-{uuid.uuid4().hex}"
        boxes = [struct.unpack_from("<4d", s, 4) for s in shapes if len(s) > 4]
        box = [f(b[i] for b in boxes) for i, f in enumerate((min, min, max, max))] if boxes else [0.0] * 4

        def head(size: int) -> bytes:
            return struct.pack(">7i", FILE_CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<ii8d", VERSION, POLYGON, *box, 0, 0, 0, 0)

        at, index = HEADER, []
        with system.open_output_stream(f"{base}/{name}.shp") as f:
            f.write(head(HEADER + sum(8 + len(s) for s in shapes)))
            for i, s in enumerate(shapes, 1):
                f.write(struct.pack(">ii", i, len(s) // 2) + s)
                index.append(struct.pack(">ii", at // 2, len(s) // 2))
                at += 8 + len(s)
        with system.open_output_stream(f"{base}/{name}.shx") as f:
            f.write(head(HEADER + INDEX_RECORD * len(index)) + b"".join(index))
        today, start = datetime.date.today(), 32 + FIELD * len(self.fields) + 1
        width = 1 + sum(f.length for f in self.fields)
        with system.open_output_stream(f"{base}/{name}.dbf") as f:
            f.write(struct.pack("<4BIHH20x", 3, today.year - 1900, today.month, today.day, len(rows), start, width))
            for field in self.fields:
                f.write(struct.pack("<11sc4xBB14x", field.name.encode("ascii"), field.kind.encode("ascii"), field.length, field.decimals))
            f.write(b"\r" + b"".join(rows) + b"\x1a")
        return name

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest makes the files count; what it replaces is deleted after it."""
        system, base = _at(self.path)
        system.create_dir(base, recursive=True)
        before = [s.rsplit("/", 1)[-1] for s in _stems(self.path)] if self._is_written(system, base) else []
        new = [s for m in messages if m for s in m.stems]
        with system.open_output_stream(f"{base}/{MANIFEST}") as f:
            f.write(json.dumps(new if self.overwrite else before + new).encode())
        for stem in before if self.overwrite else []:
            for ending in ("shp", "shx", "dbf"):
                system.delete_file(f"{base}/{stem}.{ending}")

    @staticmethod
    def _is_written(system: files.FileSystem, base: str) -> bool:
        return system.get_file_info(f"{base}/{MANIFEST}").type == files.FileType.File

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _at(self.path)
        for stem in [s for m in messages if m for s in m.stems]:
            for ending in ("shp", "shx", "dbf"):
                system.delete_file(f"{base}/{stem}.{ending}")


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        """Attributes of the first file, then the shapes."""
        system, _ = _at(self.options["path"])
        stems = _stems(self.options["path"])
        if not stems:
            raise ValueError(f"no shapefile in {self.options['path']}")
        fields, _, _ = _fields(system, stems[0])
        return T.StructType([*[T.StructField(f.name, _type(f)) for f in fields], T.StructField("rings", RINGS)])

    def reader(self, schema: T.StructType) -> ShapefileReader:
        size = int(self.options.get("partitionBytes", PARTITION_BYTES))
        return ShapefileReader(self.options["path"], size, self.options.get("encoding", "utf-8"))

    def writer(self, schema: T.StructType, overwrite: bool) -> ShapefileWriter:
        return ShapefileWriter(self.options["path"], schema, overwrite)
