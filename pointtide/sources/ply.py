"""PLY files as a Spark data source and sink, numbered sequences, and the activation of stored records.

``spark.dataSource.register(PlyDataSource)`` makes ``spark.read.format("ply").load(path)`` and ``df.write.format("ply").save(path)``
work for ASCII and binary files of either byte order. A large binary file is read in row ranges, one task each.
"""

from __future__ import annotations

import glob
import os
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from ..functions.colour import C0, sigmoid

__all__ = ["Header", "read_header", "PlyDataSource", "activate", "write_sequence", "sequence_of", "chunk_labels", "births", "VISIBLE", "SMALLEST"]

#: Numpy and Spark types of the scalar types of a header.
_TYPES = {
    "char": ("i1", ByteType()), "uchar": ("u1", ShortType()), "short": ("i2", ShortType()), "ushort": ("u2", IntegerType()),
    "int": ("i4", IntegerType()), "uint": ("u4", LongType()), "float": ("f4", FloatType()), "double": ("f8", DoubleType()),
    "int8": ("i1", ByteType()), "uint8": ("u1", ShortType()), "int16": ("i2", ShortType()), "uint16": ("u2", IntegerType()),
    "int32": ("i4", IntegerType()), "uint32": ("u4", LongType()), "float32": ("f4", FloatType()), "float64": ("f8", DoubleType()),
}
#: A record counts as visible above this opacity, and as present above this largest scale.
VISIBLE, SMALLEST = 1 / 255, 1e-4
#: Rows of a text file that are turned into numbers at a time.
ASCII_ROWS = 50_000
ROWS_PER_TASK = 1_000_000


@dataclass
class Header:
    form: str
    rows: int
    fields: list[tuple[str, str]]
    size: int

    def dtype(self) -> np.dtype:
        order = ">" if self.form == "binary_big_endian" else "<"
        return np.dtype([(n, order + _TYPES[t][0]) for n, t in self.fields])


def read_header(path: str) -> Header:
    """Header of a PLY file, whose first element must be its vertices, with scalar properties only."""
    form, rows, fields, inside, size = "", -1, [], False, 0
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path}: not a PLY file")
        while True:
            line = f.readline()
            if not line:
                raise ValueError(f"{path}: the header has no end")
            word = line.decode("ascii", "replace").split()
            if not word or word[0] in ("comment", "obj_info"):
                continue
            if word[0] == "end_header":
                size = f.tell()
                break
            if word[0] == "format":
                form = word[1]
            elif word[0] == "element":
                inside = word[1] == "vertex"
                if inside:
                    rows = int(word[2])
                elif rows < 0:
                    raise ValueError(f"{path}: vertices must come first")
            elif word[0] == "property" and inside:
                if word[1] == "list" or word[1] not in _TYPES:
                    raise ValueError(f"{path}: unknown property type {word[1]}")
                if word[2] in dict(fields):
                    raise ValueError(f"{path}: property {word[2]} twice")
                fields.append((word[2], word[1]))
    if form not in ("ascii", "binary_little_endian", "binary_big_endian") or rows < 0:
        raise ValueError(f"{path}: no readable vertices")
    return Header(form, rows, fields, size)


def _files(path: str) -> list[str]:
    path = re.sub(r"^file:(//)?", "", path)
    found = glob.glob(os.path.join(path, "**", "*.ply"), recursive=True) if os.path.isdir(path) else glob.glob(path)
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


class _Part(InputPartition):
    def __init__(self, path: str, first: int, rows: int):
        super().__init__((path, first, rows))
        self.path, self.first, self.rows = path, first, rows


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self):
        parts = []
        for p in _files(self.options["path"]):
            h = read_header(p)
            step = h.rows if h.form == "ascii" else ROWS_PER_TASK
            parts += [_Part(p, i, min(step, h.rows - i)) for i in range(0, h.rows, max(step, 1))] or [_Part(p, 0, 0)]
        return parts

    def read(self, part: _Part):
        h = read_header(part.path)
        data = np.zeros(part.rows, h.dtype().newbyteorder("="))
        with open(part.path, "rb") as f:
            if h.form == "ascii":
                f.seek(h.size)
                wide, words = len(h.fields), []
                lines = f.read().split(b"\n")[: part.rows]
                for i in range(0, part.rows, ASCII_ROWS):
                    word = [line.split()[:wide] for line in lines[i : i + ASCII_ROWS]]
                    short = next((j for j, w in enumerate(word) if len(w) < wide), None)
                    if short is not None or len(word) < min(ASCII_ROWS, part.rows - i):
                        raise ValueError(f"{part.path}: row {i + (len(word) if short is None else short)} is short")
                    words.append(np.array(word, dtype=np.bytes_).astype(np.float64))
                cell = np.concatenate(words) if words else np.zeros((0, wide))
                for k, name in enumerate(data.dtype.names):
                    data[name] = cell[:, k]
            else:
                f.seek(h.size + part.first * h.dtype().itemsize)
                raw = f.read(part.rows * h.dtype().itemsize)
                if len(raw) < part.rows * h.dtype().itemsize:
                    raise ValueError(f"{part.path}: the file ends early")
                data = np.frombuffer(raw, h.dtype()).astype(data.dtype)
        cols = []
        for s in self.schema.fields:
            if s.name == "path":
                cols.append(pa.array([part.path] * part.rows, pa.string()))
            elif s.name == "row":
                cols.append(pa.array(np.arange(part.first, part.first + part.rows), pa.int64()))
            elif s.name in data.dtype.names:
                cols.append(pa.array(np.ascontiguousarray(data[s.name])).cast(_arrow(s.dataType)))
            else:
                cols.append(pa.nulls(part.rows, _arrow(s.dataType)))
        for i in range(0, max(part.rows, 1), 100_000):
            yield pa.RecordBatch.from_arrays([c.slice(i, 100_000) for c in cols], names=[s.name for s in self.schema.fields])


_WHOLE = [ByteType(), ShortType(), IntegerType(), LongType()]


def _wider(a, b):
    """The smallest type that holds the values of both; whole numbers of over 24 bits beside a float make a double."""
    if a == b:
        return a
    if a in _WHOLE and b in _WHOLE:
        return max(a, b, key=_WHOLE.index)
    small = (ByteType(), ShortType(), FloatType())
    return FloatType() if a in small and b in small else DoubleType()


def _arrow(t):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


@dataclass
class _Written(WriterCommitMessage):
    temporary: str = ""
    final: str = ""


class _Writer(DataSourceWriter):
    """One file per partition, written beside its place and moved there only when all partitions are done."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.schema, self.form = schema, options.get("form", "binary_little_endian")
        self.path, self.overwrite = re.sub(r"^file:(//)?", "", options["path"]), overwrite

    def write(self, rows):
        os.makedirs(self.path, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}.ply"
        tmp = os.path.join(self.path, "." + name)
        write_file(tmp, [f.name for f in self.schema.fields], [tuple(r) for r in rows], self.form)
        return _Written(tmp, os.path.join(self.path, name))

    def commit(self, messages):
        old = glob.glob(os.path.join(self.path, "*.ply")) if self.overwrite else []
        for m in messages:
            if m is not None:
                os.replace(m.temporary, m.final)
        for p in old:  # only when all that is new is in its place
            os.remove(p)

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)


def write_file(path: str, names: list[str], rows: list[tuple], form: str = "binary_little_endian") -> None:
    """Rows of numbers as float properties."""
    if form not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"unknown form {form!r}")
    head = ["ply", f"format {form} 1.0", f"element vertex {len(rows)}", *[f"property float {n}" for n in names], "end_header"]
    data = np.array(rows, dtype=np.float64).reshape(len(rows), len(names)).astype("<f4" if form != "binary_big_endian" else ">f4")
    with open(path, "wb") as f:
        f.write(("\n".join(head) + "\n").encode())
        if form == "ascii":
            f.write("".join(" ".join(f"{v:.9g}" for v in r) + "\n" for r in data).encode())
        else:
            f.write(data.tobytes())


class PlyDataSource(DataSource):
    """Options: path (a file, a pattern or a folder); for writing also form (ascii, binary_little_endian, binary_big_endian)."""

    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        """Properties of all files, in the order in which they first appear, each of a type that holds its values in every file."""
        seen: dict[str, object] = {}
        for p in _files(self.options["path"]):
            for n, t in read_header(p).fields:
                seen[n] = _wider(seen[n], _TYPES[t][1]) if n in seen else _TYPES[t][1]
        return StructType([StructField("path", StringType()), StructField("row", LongType()), *[StructField(n, t) for n, t in seen.items() if n not in ("path", "row")]])

    def reader(self, schema):
        return _Reader(schema, self.options)

    def writer(self, schema, overwrite):
        return _Writer(schema, self.options, overwrite)


def activate(df: DataFrame) -> DataFrame:
    """Stored records to display form: sigmoid opacity, exponential scales, colours from harmonics, bytes or grey, unit quaternions
    x, y, z, w from w, x, y, z, and ``active``: visible and of some size. Attributes that a file lacks have their defaults."""
    has = set(df.columns)
    o = sigmoid(F.col("opacity").cast("double")) if "opacity" in has else F.lit(1.0)
    scale = [F.exp(F.col(f"scale_{i}").cast("double")) if f"scale_{i}" in has else F.lit(0.002) for i in range(3)]
    colour = []
    for i, name in enumerate(("red", "green", "blue")):
        if f"f_dc_{i}" in has:
            colour.append(F.col(f"f_dc_{i}").cast("double") * C0 + 0.5)
        elif name in has:
            colour.append(F.col(name).cast("double") / 255.0)
        else:
            colour.append(F.lit(0.5))
    q = [F.col(f"rot_{i}").cast("double") if f"rot_{i}" in has else F.lit(1.0 if i == 0 else 0.0) for i in range(4)]
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    q = [F.when(n > 0, c / n).otherwise(F.lit(1.0 if i == 0 else 0.0)) for i, c in enumerate(q)]
    keep = [c for c in ("path", "row", "frame", "x", "y", "z") if c in has]
    alive = (o > VISIBLE) & (F.greatest(*scale) > SMALLEST)
    return df.select(*keep, *[s.alias(a) for s, a in zip(scale, ("sx", "sy", "sz"))], o.alias("o"), *[c.alias(a) for c, a in zip(colour, "rgb")], *[q[i].alias(a) for i, a in ((1, "qx"), (2, "qy"), (3, "qz"), (0, "qw"))], alive.alias("active"))


def write_sequence(df: DataFrame, path: str, frame: str = "frame", digits: int = 5, form: str = "binary_little_endian", source: str | None = None) -> DataFrame:
    """Writes one file per frame, numbered by it, and returns (frame, file, rows). Each frame is written by one task, beside its place
    and then moved; writing onto the folder that was read is refused."""
    if source is not None and os.path.realpath(source) == os.path.realpath(path):
        raise ValueError("the destination is the source")
    names = [c for c in df.columns if c != frame]

    def write(pdf):
        import pandas as pd

        os.makedirs(path, exist_ok=True)
        n = int(pdf[frame].iloc[0])
        final = os.path.join(path, f"frame_{n:0{digits}d}.ply")
        tmp = f"{final}.{uuid.uuid4().hex}"
        write_file(tmp, names, pdf[names].to_numpy(), form)
        os.replace(tmp, final)
        return pd.DataFrame({"frame": [n], "file": [final], "rows": [len(pdf)]})

    return df.groupBy(frame).applyInPandas(write, "frame bigint, file string, rows bigint")


def sequence_of(paths: DataFrame, column: str = "path") -> DataFrame:
    """(prefix, digits, extension, frame, path) of numbered files, of each series up to its first gap."""
    from ..operators.islands import first_island

    part = lambda i: F.regexp_extract(column, r"^(.*?)([0-9]+)(\.[^./]*)$", i)
    p = paths.where(part(2) != "").select(F.col(column).alias("path"), part(1).alias("prefix"), F.length(part(2)).alias("digits"), part(3).alias("extension"), part(2).cast("bigint").alias("frame"))
    keys = ["prefix", "digits", "extension"]
    ok = first_island(p, keys, "frame").select(*keys, "first", "last")
    return p.join(ok, keys).where((F.col("frame") >= F.col("first")) & (F.col("frame") <= F.col("last"))).select(*keys, "frame", "path")


def chunk_labels(manifest: DataFrame, column: str = "json", groups: list[str] | None = None) -> DataFrame:
    """(groups, frame, chunk, fresh) of sequences' manifests {"frames": [{"frame": n, "chunk": label}]}, one per row of the groups (or one in
    all): fresh where the label changes."""
    from pyspark.sql import Window

    keys = groups or []
    f = manifest.select(*keys, F.explode(F.from_json(column, "frames array<struct<frame:bigint,chunk:string>>")["frames"]).alias("f")).select(*keys, "f.frame", "f.chunk")
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("frame")
    return f.withColumn("fresh", ~F.col("chunk").eqNullSafe(F.lag("chunk").over(w)) | F.lag("frame").over(w).isNull())


def births(spark, path: str) -> DataFrame:
    """(frame, row, generation) of a tab-separated log; a line of anything else fails."""
    return spark.read.csv(path, sep="\t", schema="frame bigint, row bigint, generation bigint", mode="FAILFAST", comment="#")
