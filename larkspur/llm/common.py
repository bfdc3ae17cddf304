"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_root: list[str] = []


#: Rows of a record batch that goes to Python, where the session leaves Spark's own 10,000: texts can be long.
BATCH_ROWS = 1000


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and take batches that fit texts.

    A cluster whose nodes lack that path gets the package by ``--py-files`` or ``addPyFile``.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, "10000") == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session in local mode (tests) that has none gets a temporary folder; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_root:
        _local_root.append("file://" + tempfile.mkdtemp(prefix="larkspur-"))
    return _local_root[0]


_made: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new, unused path in the shared folder; a ``workspace`` around the call removes it."""
    _made.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def workspace(spark: SparkSession):
    """Remove at the end all that is put into the shared folder inside, but for the paths added to the list it gives.

    Results that read the removed folders must be written before the end.
    """
    start, keep = len(_made), []
    try:
        yield keep
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        inside = _made[start:]
        del _made[start:]
        _made.extend(name for name in inside if name in keep)
        for name in inside:
            if name not in keep:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(conf).delete(path, True)


def last_path() -> str:
    """The path of what was materialized last."""
    return _made[-1]


def move_last(path: str) -> None:
    """Make ``path`` the last one."""
    _made.remove(path)
    _made.append(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder of the shared store; works on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@lru_cache(maxsize=1)
def _libc():
    import ctypes

    found = ctypes.CDLL(None)
    return found if hasattr(found, "malloc_trim") else None


def release() -> None:
    """Give freed memory back to the system: a worker lives on between tasks, next to others."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def tidy(fn):
    """A function over record batches that leaves no freed memory behind."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/documents.parquet")


def spread(df: DataFrame, *need: str) -> DataFrame:
    """The named columns of ``df`` only; columns it lacks come as null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in need))


def free(names: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that ``names`` doesn't have, whatever the case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- bytes and words, vectorised

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Bytes that a prefix sum covers at once, so that memory beside a text does not grow with it.
SEGMENT = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, _U)
    steps[0] = 1
    return np.cumprod(steps, dtype=_U)


_UP, _DOWN = _powers(_BASE, SEGMENT), _powers(_BASE_INV, SEGMENT)


def _sums_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The polynomial's prefix sum before each of the ascending positions ``at``."""
    out = np.zeros(len(at), _U)
    total, lift, lift_by = 0, 1, pow(_BASE, SEGMENT, 1 << 64)
    cuts = np.searchsorted(at, np.arange(0, len(data) + SEGMENT, SEGMENT), "right")
    for k, lo in enumerate(range(0, len(data), SEGMENT)):
        part = data[lo : lo + SEGMENT]
        run = np.cumsum(_BYTE[part] * _UP[: len(part)], dtype=_U)
        run *= _U(lift)
        run += _U(total)
        own = slice(cuts[k], cuts[k + 1])
        out[own] = run[at[own] - lo - 1]
        total, lift = int(run[-1]), lift * lift_by % (1 << 64)
    return out


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each non-empty ``data[start:end]`` (uint8, spans in order and apart), by prefix sums of a polynomial."""
    if len(start) == 0:
        return np.zeros(0, _U)
    high, low = np.divmod(start, SEGMENT)
    down = _DOWN[low]
    if high[-1]:
        far = _powers(pow(_BASE_INV, SEGMENT, 1 << 64), int(high[-1]) + 1)
        down *= far[high]
    return mix((_sums_at(data, end) - _sums_at(data, start)) * down + (end - start).astype(_U))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    solid = np.empty(len(data) + 2, np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = ~_SPACE[data]
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def batches_by_bytes(texts: list[bytes], limit: int = 1 << 20):
    """Index ranges of ``texts`` of about ``limit`` bytes together, one text at least."""
    first = size = 0
    for i, b in enumerate(texts):
        if i > first and size + len(b) > limit:
            yield first, i
            first, size = i, 0
        size += len(b)
    if first < len(texts):
        yield first, len(texts)


def encoded(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [b"" if s is None else s.encode("utf-8", "surrogatepass") for s in column.to_pylist()]


def crc_mod(key: str, n: int):
    """crc32 of a key column as decimal text, modulo ``n``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


# ---------------------------------------------------------------- global order and components


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, comp)`` with the smallest node of each.

    Label propagation with pointer jumping, to the fixpoint; only aggregates travel, no neighbour lists, and the driver
    sees one count a round. Every round's labels are written to the shared folder. Edges with a null end, edges from a
    node to itself and repeated edges add nothing; without edges the result is empty.
    """
    spark = edges.sparkSession
    with workspace(spark) as keep:
        both = edges.select("a", "b").where("a <> b")
        both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), tag)
        labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), tag)
        while True:
            near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
            low = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
            jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
            new = materialize(low.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")), tag)
            changed = new.where("old <> comp").limit(1).count()
            labels = new.select("node", "comp")
            if not changed:
                keep.append(last_path())
                return labels
