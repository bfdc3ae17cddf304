"""COPY in the binary form: files of tuples with field lengths, in network byte order.

A file begins with a signature, flags and an extension's length; each tuple has its number of fields, and each field its length
(-1 for null) and bytes; -1 instead of a number of fields ends the file. Each partition writes a file of its own.
"""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the signature of the format.
SIGNATURE = b"PGCOPY\n\xff\r\n\0"
_HEAD = SIGNATURE + struct.pack(">ii", 0, 0)
#: Days and microseconds from the engine's epoch to the format's, the start of 2000.
_DAYS, _MICROS = 10957, 10957 * 86400 * 10**6
_NUMBERS = {"tinyint": ">h", "smallint": ">h", "int": ">i", "bigint": ">q", "float": ">f", "double": ">d", "boolean": ">?"}


def _plain(kind: str, name: str):
    """The column as the type that travels: dates and times as numbers, all else as it is."""
    c = F.col(f"`{name}`")
    if kind == "date":
        return (F.unix_date(c) - _DAYS).cast("int")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(c.cast("timestamp")) - _MICROS
    return c.cast("smallint") if kind == "tinyint" else c.cast("string") if kind.startswith("decimal") else c


def _form(kind: str) -> str | None:
    return {"date": ">i", "timestamp": ">q", "timestamp_ntz": ">q"}.get(kind, _NUMBERS.get(kind))


def copy_binary_to(df: DataFrame, path: str) -> int:
    """``COPY (query) TO … (FORMAT binary)``: a folder of files; returns the number of rows. Other types travel as text."""
    from pyarrow import fs as pafs

    kinds = [f.dataType.simpleString() for f in df.schema]
    forms = [_form(k) for k in kinds]
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"

    def field(form, value) -> bytes:
        if value is None:
            return struct.pack(">i", -1)
        data = struct.pack(form, value) if form else value if isinstance(value, bytes) else str(value).encode()
        return struct.pack(">i", len(data)) + data

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(uri)
        out, n, name = None, 0, f"{root}/{uuid.uuid4().hex}.bin"
        for batch in batches:
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(name + ".part")
                out.write(_HEAD)
            head = struct.pack(">h", len(forms))
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out.write(head + b"".join(map(field, forms, row)))
                n += 1
        if out is not None:
            out.write(struct.pack(">h", -1))
            out.close()
            # a task that dies leaves no file that is read
            fs.move(name + ".part", name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = df.select(*(_plain(k, c).alias(c) for k, c in zip(kinds, df.columns))).mapInArrow(run, "n long")
    return rows.agg(F.sum("n")).first()[0] or 0


def copy_binary_from(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """``COPY … FROM … (FORMAT binary)``: every file of the folder, a task each; a damaged file is an error."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = [f.dataType.simpleString() for f in schema]
    forms = [_form(k) for k in kinds]
    plain = ["int" if k == "date" else "bigint" if k.startswith("timestamp") else "smallint" if k == "tinyint" else k if k in _NUMBERS or k == "binary" else "string" for k in kinds]
    travel = T.StructType.fromDDL(", ".join(f"c{i} {k}" for i, k in enumerate(plain)))
    arrow = [pa.int32() if k == "int" else pa.int64() if k == "bigint" else pa.int16() if k == "smallint" else pa.float32() if k == "float" else pa.float64() if k == "double" else pa.bool_() if k == "boolean" else pa.binary() if k == "binary" else pa.string() for k in plain]

    def tuples(data: bytes):
        if data[:11] != SIGNATURE:
            raise ValueError("COPY file signature not recognized")
        at = 19 + struct.unpack_from(">i", data, 15)[0]
        while True:
            n = struct.unpack_from(">h", data, at)[0]
            at += 2
            if n == -1:
                return
            if n != len(forms):
                raise ValueError(f"row field count is {n}, expected {len(forms)}")
            row = []
            for form, kind in zip(forms, plain):
                size = struct.unpack_from(">i", data, at)[0]
                at += 4
                if size < 0:
                    row.append(None)
                    continue
                raw = data[at : at + size]
                at += size
                row.append(struct.unpack(form, raw)[0] if form else raw if kind == "binary" else raw.decode())
            yield row

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                held = []
                for row in tuples(data.as_py()):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), arrow)], names=travel.names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), arrow)], names=travel.names)

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("content").mapInArrow(run, travel)
    out = []
    for i, (f, kind) in enumerate(zip(schema, kinds)):
        c = F.col(f"c{i}")
        if kind == "date":
            c = F.date_from_unix_date(c + _DAYS)
        elif kind.startswith("timestamp"):
            c = F.timestamp_micros(c + _MICROS)
        out.append(c.cast(f.dataType).alias(f.name))
    return raw.select(out)
