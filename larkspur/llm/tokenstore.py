"""Token-id files with keyed access through a minimal perfect hash.

A store is a folder of shards in ascending ``doc_id`` order. Shard ``k`` has ``<k>.ids`` (the raw ids of its
documents one after another, 16 or 32 bits each, little-endian) and ``<k>.idx``, its index:

    header   magic, id width, documents, ids, bits of each level
    blocks   bit sets of a minimal perfect hash: at each level a key that is alone at its place sets a bit,
             the others go on to the next level; a key's slot is the rank of its bit. A block is the number of set
             bits before it (64 bits) and 512 bits
    slots    by slot: fingerprint (32 bits), first id in the shard (64 bits), ids (64 bits)
    keys     ``doc_id`` by position in the shard, and which of its repeats a row is; the latter's highest bit but one
             marks a row without an id

A lookup of one key reads the header, a block for each level up to the key's (fewer than two are expected), one slot and
the ids, whatever the shard's size, and tells absent keys by the stored fingerprint. Many keys of a shard are looked up
together, and where they are more than its blocks the index is read in one piece. Shards and index files are written
under names of their own attempt; only those named in the manifest count, and ``write`` removes what other attempts left.
The manifest (Parquet) has one row a shard.
"""

from __future__ import annotations

import string
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from . import common as C

_U = np.uint64
MAGIC, LEVELS, GAMMA = b"LKTS0002", 40, 2
#: Set in a row's repeat number if the row has no ``doc_id``.
NO_ID = np.int64(1 << 62)
#: Groups of shards whose bounds come to the driver in a lookup, 16 bytes each.
BOUNDS = 1 << 20
#: Pieces of texts that a worker remembers, once or twice over, and characters of one that outlives its batch.
PIECES, LONG = 400_000, 32
_MARKS = string.punctuation
_HEAD = struct.Struct("<8sIQQI")
_BLOCK = np.dtype([("before", "<u8"), ("bits", "u1", 64)])
_SLOT = np.dtype([("print", "<u4"), ("first", "<u8"), ("n", "<u8")])


def _hashes(keys: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    return C.mix(keys.astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15) + C.mix(repeat.astype(np.int64).view(_U) + _U(17)))


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit hashes. ``blocks(at)`` gives the blocks at the ascending places ``at``."""

    def __init__(self, sizes: list[int], blocks):
        self.sizes, self.blocks = sizes, blocks  # bits of each level

    @staticmethod
    def place(hashed: np.ndarray, level: int, size: int) -> np.ndarray:
        return (C.mix(hashed + _U((level * 0xD1B54A32D192ED03 + 1) % 2**64)) % _U(size)).astype(np.int64)

    @staticmethod
    def build(hashed: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The levels' sizes, and all blocks."""
        sizes, levels, rest = [], [np.zeros(0, np.uint8)], hashed
        for level in range(LEVELS):
            if not len(rest):
                break
            size = -(-max(GAMMA * len(rest), 64) // 512) * 512
            at = PerfectHash.place(rest, level, size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            sizes.append(size)
            levels.append(np.packbits(bits, bitorder="little"))
            rest = rest[~alone]
        if len(rest):
            raise ValueError("keys aren't distinct")
        flat = np.concatenate(levels).reshape(-1, 64)
        blocks = np.zeros(len(flat), _BLOCK)
        blocks["bits"] = flat
        blocks["before"][1:] = np.cumsum(np.bitwise_count(flat).sum(axis=1, dtype=np.uint64))[:-1]
        return sizes, blocks

    def slots(self, hashed: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for most keys that aren't in the set (the fingerprint tells the rest)."""
        out = np.full(len(hashed), -1, np.int64)
        live = np.arange(len(hashed))
        base = 0
        for level, size in enumerate(self.sizes):
            if not len(live):
                break
            at = base + self.place(hashed[live], level, size)
            which, back = np.unique(at >> 9, return_inverse=True)
            block, inside = self.blocks(which)[back], at & 511
            byte = block["bits"][np.arange(len(at)), inside >> 3]
            hit = ((byte >> (inside & 7).astype(np.uint8)) & 1).astype(bool)
            block, inside, byte = block[hit], inside[hit], byte[hit]
            whole = np.arange(64)[None, :] < (inside >> 3)[:, None]
            ones = (np.bitwise_count(block["bits"]) * whole).sum(axis=1)
            out[live[hit]] = block["before"].astype(np.int64) + ones + np.bitwise_count(byte & ((1 << (inside & 7)) - 1).astype(np.uint8))
            live = live[~hit]
            base += size
        return out


def index_bytes(keys: np.ndarray, repeat: np.ndarray, first: np.ndarray, n: np.ndarray, width: int) -> bytes:
    hashed = _hashes(keys, repeat)
    sizes, blocks = PerfectHash.build(hashed)
    slots = np.zeros(len(keys), _SLOT)
    at = PerfectHash(sizes, lambda which: blocks[which]).slots(hashed)
    slots["print"][at], slots["first"][at], slots["n"][at] = (C.mix(hashed) >> _U(32)).astype(np.uint32), first, n
    head = _HEAD.pack(MAGIC, width, len(keys), int(n.sum()), len(sizes)) + struct.pack(f"<{len(sizes)}Q", *sizes)
    return b"".join([head, blocks.tobytes(), slots.tobytes(), keys.astype("<i8").tobytes(), repeat.astype("<i8").tobytes()])


class Shard:
    """One shard opened for reading; ``read`` counts the bytes that came from its files."""

    def __init__(self, fs, ids_path: str, idx_path: str):
        self.read = 0
        self.index, self.file = fs.open_input_file(idx_path), fs.open_input_file(ids_path)
        magic, self.width, self.docs, self.total, levels = _HEAD.unpack(self._get(self.index, _HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{idx_path} is not an index")
        sizes = list(struct.unpack(f"<{levels}Q", self._get(self.index, 8 * levels, _HEAD.size)))
        self.n_blocks = sum(sizes) // 512
        self.at_blocks = _HEAD.size + 8 * levels
        self.at_slots = self.at_blocks + _BLOCK.itemsize * self.n_blocks
        self.at_keys = self.at_slots + _SLOT.itemsize * self.docs
        self.mph = PerfectHash(sizes, lambda which: self._rows(_BLOCK, self.at_blocks, self.n_blocks, which))

    def close(self) -> None:
        self.index.close()
        self.file.close()

    def _get(self, f, n: int, at: int) -> bytes:
        self.read += n
        return f.read_at(n, at)

    def _rows(self, kind: np.dtype, start: int, n: int, which: np.ndarray) -> np.ndarray:
        """Records of the index by number: one read each, or all of them if that is most of them anyhow."""
        if 4 * len(which) > n:
            return np.frombuffer(self._get(self.index, kind.itemsize * n, start), kind)[which]
        return np.frombuffer(b"".join(self._get(self.index, kind.itemsize, start + kind.itemsize * int(i)) for i in which), kind)

    def keys(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """``doc_id`` and repeat numbers of the documents ``lo:hi``."""
        return tuple(np.frombuffer(self._get(self.index, 8 * (hi - lo), self.at_keys + 8 * (k * self.docs + lo)), "<i8") for k in (0, 1))

    def find(self, keys: np.ndarray, repeat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First ids' places and numbers of ids of keys, the latter -1 where a key isn't in this shard."""
        hashed = _hashes(keys, repeat)
        at = self.mph.slots(hashed)
        first, n = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        some = at >= 0
        if some.any():
            which, back = np.unique(at[some], return_inverse=True)
            slots = self._rows(_SLOT, self.at_slots, self.docs, which)[back]
            good = slots["print"] == (C.mix(hashed[some]) >> _U(32)).astype(np.uint32)
            first[some], n[some] = slots["first"], np.where(good, slots["n"].astype(np.int64), -1)
        return first, n

    def ids(self, first: int, n: int) -> np.ndarray:
        return np.frombuffer(self._get(self.file, n * self.width, first * self.width), f"<u{self.width}")


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = 2, shards: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into a new store at ``folder`` and return its manifest.

    Ids come from the tokenizers library (special tokens' strings in a text become their ids, none are added), each
    distinct word once a batch and worker; ``end_id`` closes every document. Null texts are empty. Rows that repeat
    a ``doc_id`` are kept side by side and told apart by a count; rows without a ``doc_id`` come first. An empty table gives
    a store without shards. Columns but these two are ignored. ``folder`` belongs to the store: what else is in it goes.
    """
    spark = docs.sparkSession
    C.importable(spark)
    docs = C.spread(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    # the second key lets a doc_id with very many rows span several shards
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.repartitionByRange(shards, *order) if shards else docs.repartitionByRange(*order)
    dealt = dealt.withColumn("pid", F.spark_partition_id()).sortWithinPartitions(*order)

    def run(batches):
        fs, root = C.filesystem(folder)
        own = _library(vocabulary)
        name = ids_file = None
        total, pid = 0, -1
        keys, missing, lengths = [], [], []
        for batch in batches:
            for part in bpe.sliced(batch):
                if ids_file is None:
                    name = uuid.uuid4().hex
                    fs.create_dir(root, recursive=True)
                    ids_file = fs.open_output_stream(f"{root}/{name}.ids")
                    pid = part.column(2)[0].as_py()
                flat, sizes = own.ids(part.column(1), end_id)
                ids_file.write(flat.astype(own.dtype).tobytes())
                total += len(flat)
                keys.append(part.column(0).fill_null(0).to_numpy())
                missing.append(part.column(0).is_null().to_numpy(zero_copy_only=False))
                lengths.append(sizes)
        if ids_file is None:
            return
        ids_file.close()
        k, none, n = np.concatenate(keys), np.concatenate(missing), np.concatenate(lengths)
        run_start = np.concatenate(([True], (k[1:] != k[:-1]) | (none[1:] != none[:-1])))
        repeat = (np.arange(len(k)) - np.maximum.accumulate(np.where(run_start, np.arange(len(k)), 0))) | np.where(none, NO_ID, 0)
        with fs.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(index_bytes(k, repeat, np.cumsum(n) - n, n, own.dtype.itemsize))
        ends = [None if none[i] else int(k[i]) for i in (0, -1)]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((pid, pa.int32()), (name, pa.string()), (len(k), pa.int64()), (total, pa.int64()), (ends[0], pa.int64()), (ends[1], pa.int64()))], names=["pid", "name", "docs", "ids", "first_key", "last_key"])

    # one small row a shard comes to the driver, never a document
    found = sorted(dealt.mapInArrow(C.tidy(run), "pid int, name string, docs long, ids long, first_key long, last_key long").collect(), key=lambda r: r.pid)
    rows, start = [], 0
    for k, r in enumerate(found):
        rows.append((k, f"{folder}/{r.name}", r.docs, r.ids, start, r.first_key, r.last_key))
        start += r.ids
    manifest = spark.createDataFrame(rows, "shard int, path string, docs long, ids long, start long, first_key long, last_key long")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    _sweep(folder, {r.name for r in found})
    return read_manifest(spark, folder)


def _sweep(folder: str, names: set[str]) -> None:
    """Remove files of attempts that did not win."""
    from pyarrow import fs as pafs

    fs, root = C.filesystem(folder)
    for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if x.is_file and x.extension in ("ids", "idx") and x.base_name[:-4] not in names:
            fs.delete_file(x.path)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def scan(manifest: DataFrame, each, schema: str) -> DataFrame:
    """For every document of the store, found again by its key: ``each(doc_id, start, ids)`` gives a row."""
    n = max(1, manifest.count())
    names = [x.strip().rsplit(" ", 1)[0] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = C.filesystem(row["path"])
                shard = Shard(fs, f"{path}.ids", f"{path}.idx")
                for lo in range(0, shard.docs, 50000):
                    keys, repeat = shard.keys(lo, min(lo + 50000, shard.docs))
                    first, size = shard.find(keys, repeat)
                    if (size < 0).any():
                        raise ValueError(f"{path}: a key isn't found by its own index")
                    for at in range(0, len(keys), 2000):
                        out = []
                        for key, rep, a, m in zip(*(x[at : at + 2000].tolist() for x in (keys, repeat, first, size))):
                            out.append(each(None if rep & int(NO_ID) else key, row["start"] + a, shard.ids(a, m)))
                        yield pa.RecordBatch.from_pandas(_frame(out, names), preserve_index=False)
                shard.close()

    return manifest.repartitionByRange(n, "shard").mapInArrow(C.tidy(run), schema)


def _frame(rows: list[tuple], names: list[str]):
    import pandas as pd

    return pd.DataFrame(rows, columns=names).astype({n: "Int64" for n in names if n in ("doc_id", "start", "n_tokens", "ids_crc32")})


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed access: ``doc_id, start, ids`` of every row of the store whose ``doc_id`` is in ``keys(doc_id)``.

    A null key finds the rows without an id. Keys that aren't in the store give no row; repeated keys ask once. Bounds of
    groups of neighbouring shards, ``BOUNDS`` at most, tell which groups may hold a key; the key meets those by an
    equi-join on the group's number and is looked up together with the others of its shard.
    """
    spark = manifest.sparkSession
    many = -(-max(manifest.count(), 1) // BOUNDS)
    group = F.floor(F.col("shard") / many).cast("long")
    # None sorts before every number
    low, high = F.struct(F.col("first_key").isNotNull().alias("some"), F.coalesce("first_key", F.lit(0)).alias("key")), F.struct(F.col("last_key").isNotNull().alias("some"), F.coalesce("last_key", F.lit(0)).alias("key"))
    bounds = manifest.groupBy(group.alias("part")).agg(F.min(low).alias("low"), F.max(high).alias("high")).orderBy("part").collect()
    if not bounds:
        return spark.createDataFrame([], "doc_id long, start long, ids array<long>")
    pair = np.dtype([("some", "?"), ("key", "<i8")])
    lows, highs = (np.array([(r[c].some, r[c].key) for r in bounds], pair) for c in ("low", "high"))
    held = spark.sparkContext.broadcast((lows, highs))

    def deal(batches):
        lows, highs = held.value
        for batch in batches:
            own = np.zeros(batch.num_rows, pair)
            own["some"], own["key"] = ~batch.column(0).is_null().to_numpy(zero_copy_only=False), batch.column(0).fill_null(0).to_numpy()
            a, b = np.searchsorted(highs, own, "left"), np.searchsorted(lows, own, "right")
            times = np.maximum(b - a, 0)
            at = np.repeat(np.arange(len(own)), times)
            part = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + a[at]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(part)], names=["doc_id", "part"])

    want = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(deal, "doc_id long, part long")
    shards = manifest.select(group.alias("part"), "shard", "path", "start", low.alias("low"), high.alias("high"))
    mine = F.struct(F.col("doc_id").isNotNull().alias("some"), F.coalesce("doc_id", F.lit(0)).alias("key"))
    asked = want.join(shards, "part").where((F.col("low") <= mine) & (mine <= F.col("high"))).select("shard", "path", "start", "doc_id")

    def found(shard, start, docs):
        """Rows of one shard: every key's first row, then the second of those that had one, and so on."""
        none = np.array([k is None for k in docs])
        key, repeat = np.array([0 if k is None else k for k in docs], np.int64), 0
        while len(key):
            first, n = shard.find(key, np.where(none, NO_ID, 0) | repeat)
            key, none, first, n = (x[n >= 0] for x in (key, none, first, n))
            for k, no, a, m in zip(key.tolist(), none.tolist(), first.tolist(), n.tolist()):
                yield {"doc_id": None if no else k, "start": start + a, "ids": shard.ids(a, m)}
            repeat += 1

    def run(batches):
        for batch in batches:
            rows, lo = batch.to_pylist(), 0
            while lo < len(rows):
                hi = lo
                while hi < len(rows) and rows[hi]["path"] == rows[lo]["path"]:
                    hi += 1
                fs, path = C.filesystem(rows[lo]["path"])
                shard = Shard(fs, f"{path}.ids", f"{path}.idx")
                out, held = [], 0
                for r in found(shard, rows[lo]["start"], [r["doc_id"] for r in rows[lo:hi]]):
                    out.append(r)
                    held += len(r["ids"])
                    if held > 1 << 19:
                        yield pa.RecordBatch.from_pylist(out, _FOUND)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, _FOUND)
                shard.close()
                lo = hi

    return asked.sortWithinPartitions("shard").mapInArrow(C.tidy(run), "doc_id long, start long, ids array<long>")


_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])


class _Library:
    """The tokenizers library behind a cache of words, which it would cut a text into itself."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.words = bpe.Codec(path)  # a codec of its own: its cache holds the library's ids only
        self.words.learn, self.words.learn_pieces = self._learn, self._learn_pieces
        self.words.pieces.limit, self.long = PIECES, []
        self.begins = np.array([b[:1] == b" " for b in self.words.bytes_of])
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")

    def ids(self, column: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each closed by ``end_id``, and how many each text has.

        Arrow cuts the texts at blanks and numbers the distinct pieces, so that Python sees a piece once a batch.
        """
        own = self.words
        texts, tail = column.to_pylist(), b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        whole = [i for i, s in enumerate(texts) if s and (len(s) > bpe.PART or own.apart(s))]
        heads = dict(zip(whole, own.encode_bytes([texts[i] for i in whole])))
        if whole:
            mask = np.zeros(len(texts), bool)
            mask[whole] = True
            column = pc.if_else(pa.array(mask), "", column)
        lists = pc.split_pattern(pc.fill_null(column, ""), " ")
        edge = lists.offsets.to_numpy().astype(np.int64)
        pieces = lists.values.dictionary_encode()
        at, first = pieces.indices.to_numpy()[edge[0] : edge[-1]], edge[:-1] - edge[0]
        # the first piece has no blank before it
        rest = np.ones(len(at), bool)
        rest[first] = False
        used = np.flatnonzero(np.bincount(at[rest], minlength=len(pieces.dictionary)))
        opening = [[] if i in heads or not s else own.words.findall(s.partition(" ")[0]) for i, s in enumerate(texts)]
        known = own.remember(pieces.dictionary.take(pa.array(used)).to_numpy(zero_copy_only=False).tolist(), set().union(*opening))
        for p in self.long:
            own.pieces.now.pop(p, None)
            own.pieces.old.pop(p, None)
        self.long.clear()
        word, join = own.known.now.__getitem__, b"".join
        known += [heads[i] if i in heads else join(map(word, w)) for i, w in enumerate(opening)]
        place = np.zeros(len(pieces.dictionary), np.int64)
        place[used] = np.arange(len(used))
        at = place[at]
        at[first] = len(used) + np.arange(len(texts))
        known.append(tail)
        at = np.insert(at, edge[1:] - edge[0], len(known) - 1)
        found = pa.array(known, pa.large_binary()).take(pa.array(at))
        _, ends, data = found.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(at) + 1]
        return np.frombuffer(data, "<u4", ends[-1] // 4), np.diff(ends[edge - edge[0] + np.arange(len(edge))]) // 4

    def _alone(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(words), 4096):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words[lo : lo + 4096], add_special_tokens=False)]
        return out

    def _together(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[str]) -> list[bytes]:
        """Words that aren't white space go to the library as lines of one text, which it cuts at the line ends again."""
        found: dict[str, bytes] = {}
        solid, line_end = [w for w in words if not w.isspace()], self.words.byte_list[10]
        for lo in range(0, len(solid), 2048):
            part = solid[lo : lo + 2048]
            ids = self._together("\n".join(part))
            at = np.flatnonzero(ids == line_end).tolist()
            if len(at) == len(part) - 1:
                raw = ids.tobytes()
                found.update(zip(part, (raw[4 * a : 4 * b] for a, b in zip([0, *(x + 1 for x in at)], [*at, len(ids)]))))
        alone = [w for w in words if w not in found]
        found.update(zip(alone, self._alone(alone)))
        return [found[w] for w in words]

    def _learn_pieces(self, pieces: list[str], words: set[str]) -> None:
        """Pieces are put together from their words; many new words with a blank before them go to the library as one text, which it cuts at the blanks again."""
        memo, cut = self.words.pieces, self.words.words.findall
        plain, mixed = set(), []
        marked, stems, marks = [], [], []
        for p in pieces:
            if p.isalpha() and (p.isascii() or max(p) < "\u0250"):
                plain.add(p)
            elif (word := p.rstrip(_MARKS)).isalpha() and (word.isascii() or max(word) < "\u0250"):
                # letters, and the marks after them, are a word each
                marked.append(p)
                stems.append(word)
                marks.append(p[len(word) :])
            else:
                mixed.append(p)
        inside = [cut(" " + p) for p in mixed]
        firsts = [x.pop(0)[1:] for x in inside]
        self.words.learn_words(words.union(marks, *inside))
        new = [*plain, *memo.missing({*stems, *firsts} - plain)]
        self.long += [p for some in (pieces, new) for p in some if len(p) > LONG]
        for lo in range(0, len(new), 2048):
            part = new[lo : lo + 2048]
            ids = self._together(" " + " ".join(part))
            at = (4 * np.flatnonzero(self.begins[ids])).tolist()
            if len(at) != len(part):
                raise ValueError("the library cuts words otherwise than the pattern")
            raw = ids.tobytes()
            memo.now.update(zip(part, [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]))
        piece, word, join = memo.now, self.words.known.now, b"".join
        piece.update(zip(marked, [piece[w] + word[m] for w, m in zip(stems, marks)]))
        piece.update(zip(mixed, [piece[w] + join(map(word.__getitem__, more)) for w, more in zip(firsts, inside)]))


@lru_cache(maxsize=2)
def _library(path: str) -> _Library:
    return _Library(path)


def _digest(doc_id, start, ids):
    return doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())


def op2(spark, sf_dir: str) -> DataFrame:
    docs = C.read_documents(spark, sf_dir)
    manifest = write(docs, C.scratch(spark, "tokens"), bpe.vocabulary(), end_id=2)
    return scan(manifest, _digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
