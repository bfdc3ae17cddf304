"""Media columns: payloads as 8-bit grey images in archives, read by a custom Spark data source.

Format ``larkspur_archive`` stores one member a row in zip archives (members uncompressed, as they are compressed
themselves) of about ``ROLL`` bytes. Reading plans byte ranges of the archives from their sizes alone, so that the driver
never lists members. An archive's comment marks places of its directory, so each task reads just the part of the directory
that tells of its range, and takes the members whose offset falls into the range, by offset, each tried anew on its own
when a read fails. Payloads stream as Arrow batches of bounded size. Writing commits by name: an attempt writes files of its
own, every commit adds one listing of its winning attempts' files, and readers see what any listing names.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import bpe
from . import common as C

WIDTH, PAD = 576, 255
RANGE_BYTES, BATCH_BYTES, BATCH_ROWS, TRIES = 16 << 20, 4 << 20, 512, 4
ROLL, MARKS, MARKED = 256 << 20, 1000, b"LKMARKS1"
NAME = "larkspur_archive"
_PNG = b"\x89PNG\r\n\x1a\n"


# ---------------------------------------------------------------- images


def padded(text: bytes) -> bytes:
    """The payload: the text and bytes 255 up to a positive multiple of ``WIDTH``."""
    return text + bytes([PAD]) * (max(1, -(-len(text) // WIDTH)) * WIDTH - len(text))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(payload: bytes, level: int = 1) -> bytes:
    """A grey image, 8 bits a sample, ``WIDTH`` wide, whose samples are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def samples(image: bytes) -> np.ndarray:
    """The samples of a grey 8-bit image without interlacing, lines by columns; checks every chunk's sum."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, width, height, body = 8, 0, 0, []
    while at < len(image):
        n = struct.unpack_from(">I", image, at)[0]
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", data)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("only grey images of 8 bits without interlacing are read")
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    kinds, out = lines[:, 0], lines[:, 1:]
    if kinds.any():
        out = _unfiltered(kinds, out.copy())
    return out


def _unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    up = np.zeros(rows.shape[1], np.uint8)
    for kind, row in zip(kinds, rows):
        if kind == 1:
            np.cumsum(row, dtype=np.uint8, out=row)
        elif kind == 2:
            row += up
        elif kind in (3, 4):
            left = corner = 0
            for i, x in enumerate(row.tolist()):
                above = int(up[i])
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]
                left, corner = (x + guess) & 255, above
                row[i] = left
        up = row
    return rows


def feature(pixels: np.ndarray) -> str:
    """A 64-bit gradient hash of an 8 by 9 grid of sums, the mean (x 100), the spread (x 100) and the edge strength (x 100).

    Integers throughout, so that equal samples give equal strings everywhere.
    """
    flat = pixels.reshape(-1)
    n = len(flat)
    edges = np.arange(72) * n // 72
    cells = np.add.reduceat(flat, edges, dtype=np.int64)
    grid = (cells * 1024 // np.diff(np.append(edges, n))).reshape(8, 9)
    bits = "".join("1" if x else "0" for x in (grid[:, 1:] > grid[:, :-1]).reshape(-1))
    counts, steps = np.zeros(256, np.int64), 0
    for lo in range(0, n, 1 << 20):  # wide numbers for a piece at a time
        part = flat[max(lo - 1, 0) : lo + (1 << 20)]
        counts += np.bincount(part[lo > 0 :], minlength=256)
        steps += int(np.abs(np.diff(part.astype(np.int16))).sum(dtype=np.int64))
    total, squares = (int((counts * np.arange(256) ** k).sum()) for k in (1, 2))
    mean, spread, edge = total * 100 // n, (n * squares - total**2) * 100 // (n * n), steps * 100 // n
    return f"{int(bits, 2):016x}:{mean}:{spread}:{edge}"


# ---------------------------------------------------------------- data source


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    members: int = 0


_COLUMNS = "member string, meta string, media binary"


class ArchiveSource(DataSource):
    """``member string, meta string, media binary``; option ``path``: a folder. ``rangeBytes``: bytes a partition; ``rollBytes``: an archive.

    Mode ``append`` adds to what the folder holds, ``overwrite`` takes its place once the new archives are listed.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return _COLUMNS

    def reader(self, schema):
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options, overwrite)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.bytes = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self):
        fs, root = C.filesystem(self.folder)
        infos, names, listings = listed(fs, root)
        out = []
        for name in sorted(infos):
            if name.endswith(".zip") and (not listings or name in names):
                out += [ByteRange(name, at, min(at + self.bytes, infos[name])) for at in range(0, infos[name], self.bytes)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        fs, root = C.filesystem(self.folder)
        path = f"{root}/{partition.path}"
        rows, held = [], 0
        opened: list = []
        for offset, size, crc, name, meta in tried(lambda: directory(fs, path, partition.start, partition.end)):
            rows.append((name, meta, read_member(fs, path, opened, offset, size, crc)))
            held += size
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield _batch(rows)
                rows, held = [], 0
        for f in opened:
            f.close()
        if rows:
            yield _batch(rows)


def listed(fs, root: str) -> tuple[dict[str, int], set[str], list[str]]:
    """Sizes of the folder's files, the archives that its listings name, and the listings' names."""
    from pyarrow import fs as pafs

    infos = {x.base_name: x.size for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.is_file}
    listings = sorted(x for x in infos if x.startswith("_files") and x.endswith(".json"))
    names: set[str] = set()
    for x in listings:
        with fs.open_input_file(f"{root}/{x}") as f:
            names.update(json.loads(f.read()))
    return infos, names, listings


def directory(fs, path: str, start: int, end: int) -> list[tuple]:
    """``(offset, size, crc, name, comment)`` of the members that begin in ``start:end``, in order.

    Reads the archive's tail and, where its comment has marks, only the directory's entries between the nearest ones.
    """
    with fs.open_input_file(path) as f:
        size = f.size()
        tail = f.read_at(min(size, 65557), size - min(size, 65557))
        at, note = len(tail), -1
        while at + 22 + note != len(tail):  # a comment may hold the record's mark by chance
            at = tail.rfind(b"PK\x05\x06", 0, at)
            if at < 0:
                raise OSError(f"{path}: no directory")
            note = struct.unpack_from("<H", tail, at + 20)[0] if at + 22 <= len(tail) else -1
        length, first = struct.unpack_from("<II", tail, at + 12)
        comment = tail[at + 22 : at + 22 + note]
        if 0xFFFFFFFF in (length, first) or not comment.startswith(MARKED):  # not of ours, or too large for plain fields
            with zipfile.ZipFile(f) as z:
                found = [(m.header_offset, m.compress_size, m.CRC, m.filename, m.comment.decode()) for m in z.infolist()]
            return sorted(m for m in found if start <= m[0] < end)
        marks = np.frombuffer(comment, "<u8", offset=len(MARKED)).reshape(-1, 2)
        low = int(np.searchsorted(marks[:, 0], start, "right")) - 1
        high = int(np.searchsorted(marks[:, 0], end, "left"))
        lo = int(marks[low, 1]) if low >= 0 else 0
        hi = int(marks[high, 1]) if high < len(marks) else length
        part = f.read_at(hi - lo, first + lo)
    out, at = [], 0
    while at < len(part):
        crc, packed = struct.unpack_from("<II", part, at + 16)
        n, extra, note = struct.unpack_from("<HHH", part, at + 28)
        offset = struct.unpack_from("<I", part, at + 42)[0]
        at += 46
        if start <= offset < end:
            out.append((offset, packed, crc, part[at : at + n].decode(), part[at + n + extra : at + n + extra + note].decode()))
        at += n + extra + note
    return out


def marks(members: list[zipfile.ZipInfo]) -> bytes:
    """The comment of an archive: offsets of evenly spread members and of their entries in the directory."""
    sizes = [46 + len(m.filename.encode()) + len(m.extra) + len(m.comment) for m in members]
    entry = np.concatenate(([0], np.cumsum(sizes)))
    pick = range(0, len(members), -(-len(members) // MARKS))
    return MARKED + np.array([(members[i].header_offset, entry[i]) for i in pick], "<u8").tobytes()


def _batch(rows):
    a, b, c = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.binary())], names=["member", "meta", "media"])


def tried(read, wait: float = 0.2, again=lambda: None):
    """``read()``, tried anew after a pause when it fails."""
    for attempt in range(TRIES):
        try:
            return read()
        except OSError:
            again()
            if attempt + 1 == TRIES:
                raise
            time.sleep(wait * 2**attempt)


def read_member(fs, path: str, opened: list, offset: int, size: int, crc: int, wait: float = 0.2) -> bytes:
    """One stored member by its offset. A failed or damaged read is tried anew with the archive opened again."""

    def read():
        if not opened:
            opened.append(fs.open_input_file(path))
        f = opened[0]
        f.seek(offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise OSError(f"{path}: no member at {offset}")
        f.seek(offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
        data = f.read(size)
        if len(data) != size or zlib.crc32(data) != crc:
            raise OSError(f"{path}: the member at {offset} is damaged")
        return data

    def close():
        while opened:
            opened.pop().close()

    return tried(read, wait, close)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool = False):
        self.folder, self.roll, self.overwrite = options["path"], int(options.get("rollBytes", ROLL)), overwrite

    def write(self, iterator):
        fs, root = C.filesystem(self.folder)
        names: list[str] = []
        n, z, out = 0, None, None

        def close():
            z.comment = marks(z.filelist) if out.at < 1 << 31 else b""
            z.close()
            out.out.close()

        for batch in iterator:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if z is None:
                    fs.create_dir(root, recursive=True)
                    names.append(f"{uuid.uuid4().hex}.zip")
                    out = _Stream(fs.open_output_stream(f"{root}/{names[-1]}"))
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                info = zipfile.ZipInfo(f"{n:09d}-{row[0]}.png")
                info.comment = row[1].encode()
                z.writestr(info, row[2])
                n += 1
                if out.at >= self.roll:
                    close()
                    z = None
        if z is not None:
            close()
        return Written(names, n)

    def commit(self, messages):
        fs, root = C.filesystem(self.folder)
        fs.create_dir(root, recursive=True)
        old = listed(fs, root) if self.overwrite else ({}, set(), [])
        with fs.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([name for m in messages if m is not None for name in m.names]).encode())
        for name in [*old[2], *(x for x in old[1] if x in old[0])]:
            fs.delete_file(f"{root}/{name}")

    def abort(self, messages):
        fs, root = C.filesystem(self.folder)
        for m in messages:
            for name in m.names if m is not None else ():
                fs.delete_file(f"{root}/{name}")


class _Stream(io.RawIOBase):
    """An output that can only go forward, as object stores offer it; knows its position."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self):
        return True

    def seekable(self):
        return False

    def tell(self):
        return self.at

    def write(self, data):
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def flush(self):
        pass


def register(spark: SparkSession) -> None:
    C.importable(spark).dataSource.register(ArchiveSource)


# ---------------------------------------------------------------- operators


def store(docs: DataFrame, folder: str) -> None:
    """Store every text of ``docs(doc_id, text)`` as an image in archives under ``folder``.

    Null texts count as empty and are stored too; a null ``doc_id`` is kept in the member's note; repeated rows give
    members of their own. What the folder holds already stays. An empty table adds no archive. Other columns are ignored.
    """
    register(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in bpe.sliced(batch, 256):
                ids, texts = part.column(0).to_pylist(), C.encoded(part.column(1))
                yield _batch([("null" if i is None else str(i), json.dumps({"doc_id": i, "n_bytes": len(t)}), png(padded(t))) for i, t in zip(ids, texts)])

    docs = C.spread(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    docs.mapInArrow(C.tidy(run), _COLUMNS).write.format(NAME).mode("append").save(folder)


def load(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The stored members: ``member, meta, media``."""
    register(spark)
    return spark.read.format(NAME).option("rangeBytes", range_bytes).load(folder)


def features(members: DataFrame) -> DataFrame:
    """Digests and features of stored images, from the bytes read back; ``n_bytes`` is the payload without its padding."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for meta, media in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    pixels = samples(media)
                    payload = pixels.tobytes()
                    # UTF-8 has no byte 255, so what is left of the padding is the text
                    n = len(payload.rstrip(bytes([PAD])))
                    rows.append((json.loads(meta)["doc_id"], n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels)))
                cols = list(zip(*rows)) if rows else [[]] * 8
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_OUT)

    return members.select("meta", "media").mapInArrow(C.tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


_OUT = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op1(spark, sf_dir: str) -> DataFrame:
    folder = C.scratch(spark, "media")
    store(C.read_documents(spark, sf_dir), folder)
    return features(load(spark, folder))
