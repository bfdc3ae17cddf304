"""Repeated passages by content-defined chunking.

A gear hash rolls over a text's bytes; a chunk ends where its deciding bits are all zero (or after ``LONGEST`` bytes, but
not before ``SHORTEST``), so boundaries depend on the bytes near them alone and come together again after an
insertion. The hash of a position is a sum over its last 16 bytes and is computed for all positions at once, by
doubling. Chunks are deduplicated by 64-bit digests over the whole table (in 30 GB, some two billion of them,
about 0.1 pairs of different units are expected to fall together); runs of chunks that one other row holds, ``PASSAGE``
bytes or more together, are passages.

A passage's edges seldom fall on chunks' edges, so runs of ``RUN`` words are compared beside them: those with the smallest
hash among ``PICK`` in a row, so that a passage of over 50 words holds one wherever it stands, and passages of less than
``RUN`` words are left alone. Texts are compared as a whole, too. The first occurrence (smallest ``doc_id``, then place)
stays, the others are repeats; ``deduplicated`` takes them out of the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS, SHORTEST, LONGEST, PASSAGE = 6, 16, 192, 256
RUN, PICK, HOT = 40, 12, 1000
_LAG = C.mix(np.arange(1001, 1001 + RUN, dtype=np.uint64)) | np.uint64(1)
_GEAR = (C.mix(np.arange(501, 757, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def rolling(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash at each byte: the sum of its last 16 bytes' table entries, shifted by their distance."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        if len(h) > step:
            later = h.copy()
            later[step:] += h[:-step] << np.uint16(step)
            h = later
    return h


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks, the last one the text's end; none for an empty text.

    The bits that decide are the highest of 16, which all 16 bytes reach.
    """
    n = len(data)
    if not n:
        return []
    ends, last = [], 0
    for p in (np.flatnonzero(rolling(data) >> np.uint16(16 - BITS) == 0) + 1).tolist():
        while p - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if p - last >= SHORTEST:
            ends.append(p)
            last = p
    while n - last > LONGEST:
        last += LONGEST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _sliding(v: np.ndarray, best, pad: int) -> np.ndarray:
    """``best`` of each entry and the ``PICK - 1`` after it; ``pad`` stands after the end."""
    n, size = len(v), 1
    v = np.concatenate((v, np.full(PICK, pad, v.dtype)))
    while size * 2 <= PICK:
        v[:-size] = best(v[:-size], v[size:])
        size *= 2
    return best(v[:n], v[PICK - size : PICK - size + n])


def windows(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of chosen runs of ``RUN`` words in the texts that end at ``edges`` of ``data``.

    Of any ``PICK`` runs in a row the one with the smallest hash is chosen, so two texts that share ``RUN + PICK - 1`` words
    in a row share a chosen run. No run goes over a text's end. Of equal runs one word apart every 16th is told.
    """
    start, end = C.word_spans(data)
    n = len(start) - RUN + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    words = C.span_hashes(data, start, end)
    h = np.zeros(n, np.uint64)
    for k in range(RUN):
        h += words[k : k + n] * _LAG[k]
    full = C.mix(h)
    h = full >> np.uint64(1)
    text = np.searchsorted(edges, start, "right")
    whole = text[:n] == text[RUN - 1 :]
    v = np.where(whole, h, np.uint64(2**63))
    least = _sliding(v, np.minimum, 2**63)
    # a row of runs counts if all of them lie in one text
    inside = np.zeros(n, bool)
    m = n - PICK + 1
    if m > 0:
        inside[:m] = text[:m] == text[RUN + PICK - 2 :]
    least = np.where(inside, least, np.uint64(0))
    top = _sliding(np.concatenate((np.zeros(PICK - 1, np.uint64), least)), np.maximum, 0)[:n]
    chosen = whole & (v == top)
    same = np.zeros(n, bool)
    same[1:] = (v[1:] == v[:-1]) & chosen[:-1]
    at = np.flatnonzero(chosen & (~same | (np.arange(n) % 16 == 0)))
    return start[at], end[at + RUN - 1], full[at].view(np.int64)


_UNITS = "doc_id long, key long, place long, digest long, lead boolean"


def _units(batches):
    """Chunks, chosen runs of words, and each text as a whole; the latter two (``kind`` 1 and 2) are passages by themselves.

    ``key`` is a digest of the text, its lowest bit set where there is no id; ``place`` holds first byte, end and kind, by
    ``33``, ``31`` and ``2`` bits, in few bytes for the shuffles; ``lead`` marks a unit's first place in its row.
    """
    import xxhash

    for batch in batches:
        rows = list(zip(batch.column(0).to_pylist(), C.encoded(batch.column(1))))
        for lo, hi in C.batches_by_bytes([t for _, t in rows], 1 << 19):
            part = [(k, t) for k, t in rows[lo:hi] if t]
            if not part:
                continue
            # a blank between texts, so that no word goes over an end
            data = np.frombuffer(b" ".join(t for _, t in part) + b" ", np.uint8)
            edges = np.cumsum([len(t) + 1 for _, t in part])
            begin = edges - [len(t) + 1 for _, t in part]
            first, last, runs = windows(data, edges)
            owner = np.searchsorted(edges, first, "right")
            first, last = first - begin[owner], last - begin[owner]
            bounds = np.searchsorted(owner, np.arange(len(part) + 1))
            ids: list = []
            cols: list[list] = [[] for _ in range(4)]
            for j, (key, text) in enumerate(part):
                ends = boundaries(np.frombuffer(text, np.uint8))
                starts = [0, *ends[:-1]]
                digests = [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(starts, ends)]
                digests.append(xxhash.xxh3_64_intdigest(text, 1))
                x, y = bounds[j], bounds[j + 1]
                digest = np.concatenate((np.array(digests, np.uint64).view(np.int64), runs[x:y]))
                n = len(digest)
                lead = np.zeros(n, bool)
                lead[np.unique(digest, return_index=True)[1]] = True
                kind = np.ones(n, np.int64)
                kind[: len(ends)], kind[len(ends)] = 0, 2
                ids += [key] * n
                cols[0].append(np.full(n, xxhash.xxh3_64_intdigest(text, 2) >> 2 << 1 | (key is None), np.int64))
                cols[1].append(np.concatenate((starts, [0], first[x:y])) << 33 | np.concatenate((ends, [len(text)], last[x:y])) << 2 | kind)
                cols[2].append(digest)
                cols[3].append(lead)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(np.concatenate(c)) for c in cols)], names=["doc_id", "key", "place", "digest", "lead"])


def repeats(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)`` with a passage that another row holds too.

    ``shared_bytes long, shared string``: what other rows hold, as ``first-end`` byte offsets, comma-joined; ``repeat_bytes
    long, repeats string``: what is left of it without the first occurrences, which are in the row with the smallest
    ``doc_id``. Told are runs of chunks shared with one row of ``passage`` bytes or more, shared runs of ``RUN`` words (so all
    that has ``RUN + PICK - 1`` words), and texts that are equal as a whole, whatever their length; a span goes on through
    the shared chunks beside these. Rows without these give no row. What only repeats inside one row is no repeat.

    Rows that repeat a ``doc_id`` or have none are rows of their own; those without one come after all others, and of rows
    with one id the smallest digest of the text comes first. Of rows equal in id and text one holds the first occurrence.
    Null and empty texts share nothing. Other columns are ignored.
    """
    docs = C.spread(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    units = docs.mapInArrow(C.tidy(_units), _UNITS)
    # only digests that another row has travel on; they are aggregated before the shuffle
    owner = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "key")
    often = C.materialize(units.where("lead").groupBy("digest").agg(F.min(owner).alias("origin"), F.count("*").alias("rows")).where("rows > 1"), "substring-often")
    # a digest with more than a HOT-th of all these rows is dealt out by salt; there are fewer than HOT of them
    total = often.agg(F.sum("rows")).first()[0] or 1
    hot = often.where(F.col("rows") * HOT > total).select(F.col("digest").alias("_hot"), F.ceil(F.col("rows") * HOT / total).cast("int").alias("_shares"))
    salted = lambda df, salt: df.join(F.broadcast(hot), F.col("digest") == F.col("_hot"), "left").withColumn("salt", salt).drop("_hot", "_shares")
    every = salted(often, F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).select("digest", "salt", "origin")
    found = salted(units.drop("lead"), F.coalesce(F.pmod(F.xxhash64("key", "place"), F.col("_shares")).cast("int"), F.lit(0))).join(every, ["digest", "salt"])
    found = found.select("doc_id", "key", "place", "digest", (owner != F.col("origin")).alias("again"), F.col("origin.key").alias("from"))
    # equal rows have equal units: one set of them, made before the shuffle, and their number from the units of whole texts
    runs = found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("place", "digest", "again", "from"))).alias("own"), F.greatest(F.count_if(F.col("place").bitwiseAND(3) == 2), F.lit(1)).alias("n"))
    told = runs.select("doc_id", "own", "n").mapInArrow(C.tidy(_runs(passage)), "doc_id long, shared_bytes long, shared string, repeat_bytes long, repeats string, n long").where("shared_bytes > 0")
    copy = F.col("copy") > 1
    return told.withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).select(
        "doc_id", "shared_bytes", "shared", F.when(copy, F.col("shared_bytes")).otherwise(F.col("repeat_bytes")).alias("repeat_bytes"), F.when(copy, F.col("shared")).otherwise(F.col("repeats")).alias("repeats")
    )


def joined(first: np.ndarray, last: np.ndarray, least: int, sure: np.ndarray, source: np.ndarray) -> list[tuple[int, int]]:
    """Spans in order of their starts, put together where they touch; kept are those that hold a ``sure`` one, or neighbours
    of one ``source`` of ``least`` bytes together."""
    if not len(first):
        return []
    reach = np.maximum.accumulate(last)
    fresh = np.concatenate(([True], first[1:] > reach[:-1]))
    at = np.flatnonzero(fresh)
    lo, hi = first[fresh], reach[np.concatenate((at[1:] - 1, [len(first) - 1]))]
    keep = np.logical_or.reduceat(sure, at)
    chunk = np.flatnonzero(~sure)
    if len(chunk):
        x, y, z = first[chunk], last[chunk], source[chunk]
        begins = np.concatenate(([True], (x[1:] != y[:-1]) | (z[1:] != z[:-1])))
        of = np.flatnonzero(begins)
        long = y[np.concatenate((of[1:] - 1, [len(x) - 1]))] - x[of] >= least
        keep[np.searchsorted(at, chunk[of[long]], "right") - 1] = True
    return list(zip(lo[keep].tolist(), hi[keep].tolist()))


def _runs(passage: int):
    def run(batches):
        for batch in batches:
            at, own = batch.column(1).offsets.to_numpy(), batch.column(1).values
            place, d1, again, source = (own.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            first, last, kind = place >> 33, place >> 2 & 0x7FFFFFFF, place & 3
            out = []
            for key, n, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), at, at[1:]):
                x, y, sure, z = first[a:b], last[a:b], kind[a:b] > 0, source[a:b]
                late = again[a:b].astype(bool)
                _, once = np.unique(d1[a:b], return_index=True)
                second = np.ones(b - a, bool)
                second[once] = False
                late = late | second
                every, rest = joined(x, y, passage, sure, z), joined(x[late], y[late], passage, sure[late], z[late])
                text = lambda spans: ",".join(f"{a}-{b}" for a, b in spans)
                out.append((key, sum(b - a for a, b in every), text(every), sum(b - a for a, b in rest), text(rest), n))
            cols = list(zip(*out)) if out else [[]] * 6
            names = ["doc_id", "shared_bytes", "shared", "repeat_bytes", "repeats", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], names=names)

    return run


def without(text: str, spans: str) -> str:
    """``text`` without byte spans ``first-end``, comma-joined; a character that a span only touches stays."""
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for span in spans.split(","):
        a, b = map(int, span.split("-"))
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[at:a])
        at = max(at, b)
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def deduplicated(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """``docs`` with the repeats taken out of ``text``: of all rows that hold a passage one keeps it.

    Every row stays, a copy as a whole with an empty text; null texts stay null; other columns, ids that are missing or repeat
    and rows that repeat pass through. Which row keeps a passage follows the rows' order in the table.
    """
    row, spans = C.free(docs.columns, "row", "spans")
    rows = C.materialize(docs.withColumn(row, F.monotonically_increasing_id()), "substring-rows")
    told = repeats(rows.select(F.col(row).alias("doc_id"), "text"), passage).where("repeat_bytes > 0").select(F.col("doc_id").alias(row), F.col("repeats").alias(spans))

    names = [*docs.columns, spans]
    at = names.index("text")

    def run(batches):
        for batch in batches:
            cut = [t if s is None else without(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names) - 1).to_pylist())]
            columns = batch.columns[:-1]
            columns[at] = pa.array(cut, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names[:-1])

    return rows.join(told, row, "left").select(*(F.col(f"`{c}`") for c in names)).mapInArrow(C.tidy(run), docs.schema)


def op6(spark, sf_dir: str) -> DataFrame:
    return repeats(C.read_documents(spark, sf_dir))
