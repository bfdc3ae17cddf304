"""Sparse rows in text (libsvm), in both of its forms, and array files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(line, width: int | None = None) -> Column:
    """``label id:value …`` to ``struct(y, ids, vals)``, padded with zeros to ``width``; ids without a value have value 1."""
    line = F.col(line) if isinstance(line, str) else line
    parts = F.split(F.trim(line), r"\s+")
    feats = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    ids = F.transform(feats, lambda f: F.split(f, ":")[0].cast("long"))
    vals = F.transform(feats, lambda f: F.coalesce(F.get(F.split(f, ":"), F.lit(1)).cast("double"), F.lit(1.0)))
    if width is not None:
        pad = lambda a, v: F.slice(F.concat(a, F.array_repeat(F.lit(v), width)), 1, width)
        ids, vals = pad(ids, 0), pad(vals, 0.0)
    return F.struct(parts[0].cast("double").alias("y"), ids.alias("ids"), vals.alias("vals"))


def format_line(y, features: list[str]) -> Column:
    return F.concat_ws(" ", F.col(y).cast("string"), *(F.concat(F.lit(f"{i}:"), F.col(c).cast("string")) for i, c in enumerate(features, 1)))


def read_libsvm(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(parse("value", width).alias("r")).select("r.*")


def read_npy(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of two-dimensional ``.npy`` arrays as ``array<double>``; one task reads one file from Spark's own reader."""

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({"path": name, "row": range(len(a)), "values": list(a.reshape(len(a), -1).astype(float))})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, row long, values array<double>")
