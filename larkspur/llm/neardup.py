"""Near-duplicate documents by a signature-coordinate inverted join.

Every distinct shingle set (a *class* of documents) gets ``COORDS`` min-wise hash values. A coordinate and its value
make one token; each class posts itself under its rarest tokens only. Two classes whose sets have a Jaccard similarity of
``num/den`` collide in at least ``MATCHES`` of the ``COORDS`` coordinates but for a chance of some 4e-6 at the threshold
itself (far less above it), and so share one of the ``COORDS - MATCHES + 1`` rarest tokens. Collisions of a pair are
counted by skip merging: the short lists of rare tokens are merged, which finds the pair once; the long lists are skipped
and only probed for the pair, by comparing the two signatures at the other coordinates. Pairs of ``MATCHES`` collisions or
more stay. A wider sketch (one permutation, ``BINS`` bins of a byte) spares those that can't reach the threshold the
comparison of full sets, which decides.

Rows are kept linear in hot lists: first every poster is held against the list's medoid only (the poster with most
collisions in all), components are built, and then only lists that still hold several components are compared block by
block inside tasks, across components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from . import common as C

COORDS, MATCHES, BINS, BLOCK, SPOKES = 64, 36, 512, 4096, 2048
_U = np.uint64
_A = C.mix(np.arange(1, COORDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_B = C.mix(np.arange(1001, 1001 + COORDS, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))
_LAG = C.mix(np.arange(77, 177, dtype=_U)) | _U(1)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's ``width``-word shingles."""
    out: list[np.ndarray] = []
    for lo, hi in C.batches_by_bytes(texts, 1 << 19):
        part = texts[lo:hi]
        data = np.frombuffer(b" ".join(part).lower(), np.uint8)
        start, end = C.word_spans(data)
        words = C.span_hashes(data, start, end)
        edges = np.cumsum([0] + [len(t) + 1 for t in part])
        at = np.searchsorted(start, edges)
        n = max(len(words) - width + 1, 0)
        runs = np.zeros(n, _U)
        for k in range(width):
            runs += C.mix(words[k : n + k] * _LAG[k])
        runs = C.mix(runs)
        for i in range(len(part)):
            a, b = at[i], at[i + 1]
            if b - a >= width:
                own = np.sort(runs[a : b - width + 1])
                out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif b > a:
                own = np.zeros(1, _U)
                for k in range(b - a):
                    own += C.mix(words[a + k : a + k + 1] * _LAG[k])
                out.append(C.mix(own + _U(b - a)))
            else:
                out.append(np.zeros(0, _U))
    return out


def set_print(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def signature(own: np.ndarray) -> np.ndarray:
    """The minimum under each of ``COORDS`` hash functions, 32 bits of each."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, _U)
    for at in range(0, len(own), 4096):
        low = np.minimum(low, (own[None, at : at + 4096] * _A[:, None] + _B[:, None]).min(axis=1))
    return (C.mix(low ^ _B) >> _U(32)).astype(np.uint32)


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many coordinates pairs of signatures (rows) collide."""
    return np.count_nonzero(a == b, axis=-1)


def sketch(own: np.ndarray) -> np.ndarray:
    """One-permutation signature: for each bin of hashes, a byte of its minimum; 0 marks an empty bin."""
    out = np.zeros(BINS, np.uint8)
    hashed = np.sort(C.mix(own ^ _U(0x1234567)))
    bins = (hashed >> _U(55)).astype(np.int64)
    if len(bins):
        first = np.concatenate(([True], bins[1:] != bins[:-1]))
        out[bins[first]] = (hashed[first] % _U(255)).astype(np.uint8) + np.uint8(1)
    return out


def alike(a: np.ndarray, b: np.ndarray, share: float, total: np.ndarray) -> np.ndarray:
    """Whether pairs of sketches (rows; ``a`` may be one row) may reach the similarity ``share``; five standard errors allowed.

    ``total``: the sum of both set sizes. A look at the first bins drops most pairs. On all bins the error is that of
    sampling without replacement: the smaller the sets, the nearer a sketch is to the set itself.
    """
    out = np.zeros(len(b), bool)
    at = np.arange(len(b))
    for first in (48, 160):
        x, y = a[:first] if a.ndim == 1 else a[at, :first], b[at, :first]
        same, union = np.count_nonzero((x == y) & (x != 0), axis=-1), np.count_nonzero(x | y, axis=-1)
        at = at[same >= share * union - 5 * np.sqrt(share * (1 - share) * np.maximum(union, 1)) - 1]
    x, y = (a if a.ndim == 1 else a[at]), b[at]
    same, union = np.count_nonzero((x == y) & (x != 0), axis=-1), np.maximum(np.count_nonzero(x | y, axis=-1), 1)
    size = np.maximum(np.maximum(total[at] / (1 + share), union), 2)
    var = share * (1 - share) * np.maximum((1 + 1 / (size - 1)) / union - 1 / (size - 1), 0)
    out[at] = same >= (share - 5 * np.sqrt(var)) * union - 1
    return out


_FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("print", T.BinaryType()),
        T.StructField("sig", T.BinaryType()),
        T.StructField("sketch", T.BinaryType()),
    ]
)


def _features(width: int):
    def run(batches):
        for batch in batches:
            for part in bpe.sliced(batch, 512):
                sets = shingle_sets(C.encoded(part.column(1)), width)
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_print(s) if f else None for s, f in zip(sets, full)], pa.binary()),
                        pa.array([signature(s).tobytes() if f else None for s, f in zip(sets, full)], pa.binary()),
                        pa.array([sketch(s).tobytes() if f else None for s, f in zip(sets, full)], pa.binary()),
                    ],
                    names=_FEATURES.names,
                )

    return run


def _tokens(batches):
    """Each coordinate and its value as one token."""
    coordinate = np.arange(COORDS, dtype=_U) << _U(32)
    for batch in batches:
        keys, sigs = batch.column(0), batch.column(1)
        n = batch.num_rows
        flat = np.frombuffer(b"".join(sigs.to_pylist()), np.uint32).reshape(n, COORDS)
        flat = C.mix(flat.astype(_U) | coordinate).view(np.int64).reshape(-1)
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(np.arange(n), COORDS))), pa.array(flat)], names=["print", "token"])


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for part in bpe.sliced(batch, 512):
                sets = shingle_sets(C.encoded(part.column(0)), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_print(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["print", "own"]
                )

    return run


def _linked(num: int, den: int):
    """Of rows sorted by hub and share, the hub's set first, the pairs whose full sets meet the threshold."""

    def run(batches):
        hub = own = None
        for batch in batches:
            a, b = [], []
            for x, y, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                other = np.frombuffer(data.as_buffer(), _U)
                if y is None:
                    hub, own = x, other.copy()
                    continue
                if x != hub:
                    raise ValueError("a pair came without its hub")
                both = len(np.intersect1d(own, other, assume_unique=True))
                if den * both >= num * (len(own) + len(other) - both):
                    a.append(min(x, y))
                    b.append(max(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs of ``(hub, spoke)`` whose full sets meet the threshold, as ``(a, b)``.

    A hub's set travels once for each ``SPOKES`` pairs of it, a spoke's once a pair; a task holds one hub's set at a time.
    """
    need = classes.join(pairs.select(F.explode(F.array("hub", "spoke")).alias("print")).distinct(), "print", "left_semi").select("print", "rep")
    texts = docs.join(need, docs.doc_id.eqNullSafe(need.rep), "left_semi").select("text")
    sets = texts.mapInArrow(C.tidy(_sets(width)), "print binary, own binary").join(need.select("print"), "print", "left_semi")
    sets = C.materialize(sets.groupBy("print").agg(F.first("own").alias("own")), "neardup-sets")
    shares = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("shares"))
    spokes = pairs.join(shares, "hub").withColumn("share", F.pmod(F.xxhash64("spoke"), F.col("shares")).cast("int"))
    spokes = spokes.join(sets.withColumnRenamed("print", "spoke"), "spoke").select("hub", "spoke", "own", "share")
    hubs = shares.join(sets.withColumnRenamed("print", "hub"), "hub").select("hub", F.lit(None).cast("binary").alias("spoke"), "own", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    rows = hubs.unionByName(spokes).repartition("hub", "share").sortWithinPartitions("hub", "share", F.col("spoke").isNotNull())
    return rows.select("hub", "spoke", "own").mapInArrow(C.tidy(_linked(num, den)), "a binary, b binary")


def _across(share: float, flush: int = 1 << 13):
    """Within blocks of posting lists: pairs of different components with ``MATCHES`` collisions that may be alike.

    Rows come sorted by list, block pair and set size; a block pair has at most two blocks of rows. Of all the lists
    that hold a pair, only that of its smallest common token tells it, so none is told twice. Candidates of many small
    lists are tested together.
    """

    def pairs_of(lo, hi, one, two, block, sizes, comp):
        """Candidate index pairs of the rows ``lo:hi``: of different components, of sizes that allow a link."""
        if comp[lo:hi].min() == comp[lo:hi].max():
            return
        rows = np.arange(lo, hi)
        x = rows[block[lo:hi] == one]
        y = x if one == two else rows[block[lo:hi] == two]
        ends = np.searchsorted(sizes[y], sizes[x] / share + 1e-9, "right")
        begins = np.arange(1, len(x) + 1) if one == two else np.searchsorted(sizes[y], share * sizes[x] - 1e-9, "left")
        for i, b, e in zip(x, begins, ends):
            j = y[b:e]
            j = j[comp[j] != comp[i]]
            if len(j):
                yield np.full(len(j), i), j

    def told(table, starts):
        token, one, two, block, sizes = (table.column(c).to_numpy() for c in ("token", "one", "two", "block", "n_shingles"))
        comp = pd.factorize(np.array(table.column("comp").to_pylist(), dtype=object))[0]
        prints = table.column("print").to_pylist()
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, COORDS)
        mine = table.column("mine").combine_chunks()
        at, values = mine.offsets.to_numpy(), mine.values.to_numpy()

        def test(i, j):
            enough = collisions(sigs[i], sigs[j]) >= MATCHES
            i, j = i[enough], j[enough]
            ok = alike(sketches[i], sketches[j], share, sizes[i] + sizes[j])
            found = []
            for a, b in zip(i[ok].tolist(), j[ok].tolist()):
                common = np.intersect1d(values[at[a] : at[a + 1]], values[at[b] : at[b + 1]])
                if common[0] == token[a]:
                    found.append((prints[a], prints[b]))
            yield from _pair_batches(found)

        held, n = [], 0
        for lo, hi in zip(starts, [*starts[1:], table.num_rows]):
            for pair in pairs_of(lo, hi, one[lo], two[lo], block, sizes, comp):
                held.append(pair)
                n += len(pair[0])
                if n >= flush:
                    yield from test(*(np.concatenate(x) for x in zip(*held)))
                    held, n = [], 0
        if held:
            yield from test(*(np.concatenate(x) for x in zip(*held)))

    def run(batches):
        held: list = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = list(zip(*(batch.column(c).to_pylist() for c in ("token", "one", "two"))))
            new = [i for i in range(len(key)) if key[i] != (key[i - 1] if i else last)]
            cut = new[-1] if new else 0
            if new and (held or cut):
                # all rows before the last list's are complete
                table = pa.Table.from_batches([*held, batch.slice(0, cut)])
                yield from told(table, _starts(table))
                held = []
            held.append(batch.slice(cut) if new else batch)
            last = key[-1]
        if held:
            table = pa.Table.from_batches(held)
            yield from told(table, _starts(table))

    return run


def _starts(table) -> list[int]:
    change = np.zeros(table.num_rows, bool)
    for c in ("token", "one", "two"):
        v = table.column(c).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    change[:1] = True
    return np.flatnonzero(change).tolist()


def _pair_batches(pairs):
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array([f(p) for p in pairs], pa.binary()) for f in (min, max)], names=["hub", "spoke"])


def _posted(classes: DataFrame) -> DataFrame:
    """``print, score, mine``: the tokens each class posts, and with how many others it collides in all its tokens."""
    with C.workspace(classes.sparkSession) as keep:
        tokens = classes.select("print", "sig").mapInArrow(C.tidy(_tokens), "print binary, token long")
        shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
        common = C.materialize(tokens.join(shared, "token"), "neardup-tokens")
        # the rarest tokens first; those that no other class has fill the prefix without being posted
        posted = (
            common.groupBy("print")
            .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"), F.sum("df").alias("score"))
            .withColumn("take", F.lit(COORDS - MATCHES + 1) - (F.lit(COORDS) - F.size("own")))
            .where("take > 0")
            .select("print", "score", F.slice("own", F.lit(1), F.col("take"))["token"].alias("mine"))
        )
        posted = C.materialize(posted, "neardup-posts")
        keep.append(C.last_path())
    return posted


def _groups(docs: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Components ``(node, comp)`` of linked classes, the last table that it writes."""
    share = num / den
    posted = _posted(classes)
    posts = posted.select("print", "score", F.explode("mine").alias("token"))
    medoid = posts.groupBy("token").agg(F.max(F.struct("score", "print")).alias("top"), F.count("*").alias("m")).where("m > 1")
    star = posts.join(medoid, "token").select("print", F.col("top.print").alias("hub")).where("print <> hub")
    # a pair once, whichever of the two is the hub
    star = star.groupBy(F.least("print", "hub").alias("one"), F.greatest("print", "hub").alias("two")).agg(F.min("hub").alias("hub"))
    star = star.select("hub", F.when(F.col("hub") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("spoke"))

    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series, total: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        rows = lambda z, kind, n: np.frombuffer(b"".join(z), kind).reshape(-1, n)
        ok = collisions(rows(a, np.uint32, COORDS), rows(b, np.uint32, COORDS)) >= MATCHES
        ok[ok] = alike(rows(x, np.uint8, BINS)[ok], rows(y, np.uint8, BINS)[ok], share, total.to_numpy()[ok])
        return pd.Series(ok)

    side = lambda c: classes.select(F.col("print").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("sketch").alias(f"sketch_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    star = star.join(side("hub"), "hub").join(side("spoke"), "spoke").where(f"n_hub * {den} >= n_spoke * {num} and n_spoke * {den} >= n_hub * {num}")
    star = star.where(may("sig_hub", "sig_spoke", "sketch_hub", "sketch_spoke", F.col("n_hub") + F.col("n_spoke"))).select("hub", "spoke")
    star = C.materialize(star, "neardup-star")
    edges = C.materialize(_confirmed(star, docs, classes, width, num, den), "neardup-edges")
    comp = C.components(edges, "neardup-comp")
    last = C.last_path()

    now = posts.select("token", "print").join(comp.withColumnRenamed("node", "print"), "print", "left").withColumn("comp", F.coalesce("comp", "print"))
    now = C.materialize(now, "neardup-now")
    mixed = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("token", "m")
    rest = (
        now.join(mixed, "token")
        .join(classes.select("print", "n_shingles", "sig", "sketch").join(posted.select("print", "mine"), "print"), "print")
        .withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("token", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "print", "comp", "n_shingles", "sig", "sketch", "mine")
    )
    lists = rest.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two", "n_shingles")
    tested = star.select(F.least("hub", "spoke").alias("hub"), F.greatest("hub", "spoke").alias("spoke"))
    across = lists.mapInArrow(C.tidy(_across(share)), "hub binary, spoke binary").join(tested, ["hub", "spoke"], "left_anti")
    across = C.materialize(across, "neardup-across")
    if not across.isEmpty():
        more = C.materialize(_confirmed(across, docs, classes, width, num, den), "neardup-more")
        if not more.isEmpty():
            return C.components(edges.unionByName(more), "neardup-comp")
    C.move_last(last)
    return comp


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Words are the runs of bytes that are not ASCII white space, with A-Z lower-cased; a document's set is its
    distinct ``width``-word shingles, or its whole sequence if it has fewer words. Two documents are linked
    when ``den * |both| >= num * |either|``.

    Null and empty texts (and texts of white space) have no set: ``n_shingles`` 0, linked with nothing,
    ``component_id`` their own ``doc_id``, kept. Rows that repeat a ``doc_id`` are rows of their own; a
    ``doc_id`` of null takes part (null ids sort after all others, so they name a component only if no other id
    is in it). Extra columns are ignored. An empty table gives an empty result.
    """
    docs = C.spread(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    features = C.materialize(docs.mapInArrow(C.tidy(_features(width)), _FEATURES), "neardup-features")
    classes = C.materialize(
        features.where("print is not null")
        .groupBy("print")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")),
        "neardup-classes",
    )
    with C.workspace(docs.sparkSession) as keep:
        comp = _groups(docs, classes, width, num, den)
        keep.append(C.last_path())

    named = classes.join(comp.withColumnRenamed("node", "print"), "print", "left").select("print", F.coalesce("comp", "print").alias("comp"), "rep")
    lowest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "comp").select("print", "component_id")
    linked = features.select("doc_id", "n_shingles", "print").join(named, "print", "left")
    own = F.coalesce("component_id", "doc_id")
    return linked.select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read_documents(spark, sf_dir), width=4, num=80, den=100)


def oracle(width: int = 4, num: int = 80, den: int = 100) -> str:
    """The same links and components in DuckDB SQL, by comparing all sets that share a shingle."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + {width - 1}], ' ') for i in range(1, len(ws) - {width - 2})] END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 e AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING {den} * count(*) >= {num} * (p.n + q.n - count(*))
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM n
  UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a
), c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""
