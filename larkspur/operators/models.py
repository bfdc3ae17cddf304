"""Layered models: training, inference, a store of layer versions with delta coding, and routing to stored models.

A model is a row of layers. It is trained in numpy on batches of rows that come to the driver in bounded numbers
(``batch_size * batch_num`` rows at most); inference runs on the executors, on Arrow batches, over all rows.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names and defaults of the settings that training reads from the session.
SETTINGS = {"larkspur.model_name": "mlp", "larkspur.batch_size": "512", "larkspur.num_batches": "80", "larkspur.epoch": "6", "larkspur.max_features": "64"}

LEAST_STEPS = 500


def setting(spark: SparkSession, name: str) -> str:
    return spark.conf.get(f"larkspur.{name}", SETTINGS[f"larkspur.{name}"])


# ---------------------------------------------------------------- networks


@dataclass
class Network:
    """Layers of weights with rectifiers between them; features are standardised by the first two rows of ``layers[0]``."""

    kind: str
    columns: list[str]
    classes: list | None
    layers: list[np.ndarray]  # the means and scales, then weights with the bias as the last row, alternating widths
    target: tuple[float, float] = (0.0, 1.0)

    def crossed(self, x: np.ndarray) -> np.ndarray:
        """The factorised model sees products of all pairs of features beside them."""
        if self.kind != "cross":
            return x
        i, j = np.triu_indices(x.shape[1])
        return np.concatenate([x, x[:, i] * x[:, j]], axis=1)

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        mean, scale = self.layers[0]
        h = [self.crossed((x - mean) / scale)]
        for k, w in enumerate(self.layers[1:]):
            z = h[-1] @ w[:-1] + w[-1]
            h.append(z if k == len(self.layers) - 2 else np.maximum(z, 0))
        return h

    def output(self, x: np.ndarray) -> np.ndarray:
        """Values, or the number of the likeliest class."""
        z = self.forward(x)[-1]
        return z.argmax(axis=1) if self.classes is not None else z[:, 0] * self.target[1] + self.target[0]

    def column(self) -> Column:
        kind = "double" if self.classes is None else "int"

        @F.pandas_udf(kind)
        def run(*features: pd.Series) -> pd.Series:
            x = np.stack([f.to_numpy(np.float64) for f in features], axis=1)
            out = self.output(np.nan_to_num(x, nan=0.0))
            return pd.Series(out)

        raw = run(*(F.expr(c).cast("double") for c in self.columns))
        if self.classes is None:
            return raw
        return F.element_at(F.array(*map(F.lit, self.classes)), raw + 1)


def _rows(df: DataFrame, columns: list[str], target: str, most: int) -> tuple[np.ndarray, list]:
    """At most ``most`` rows, drawn by a hash of their values."""
    picked = df.select(*(F.expr(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)), F.expr(target).alias("y")).dropna()
    names = picked.columns
    found = picked.orderBy(F.xxhash64(*names), *names).limit(most).collect()
    return np.array([r[:-1] for r in found], np.float64).reshape(len(found), len(columns)), [r[-1] for r in found]


def fit(df: DataFrame, columns: list[str], target: str, kind: str = "mlp", classify: bool = False, batch_size: int = 512, batch_num: int = 80, epoch: int = 6, hidden: tuple[int, ...] = (24, 12), start: Network | None = None, seed: int = 3) -> Network:
    """Train by Adam. ``kind``: ``linear`` (no hidden layer), ``mlp``, or ``cross`` (products of pairs of features).

    ``epoch``: passes over the rows, or so many that ``LEAST_STEPS`` batches are seen. ``start``: a network to go on from, as
    fine-tuning does. Ties in the order of rows don't matter; nulls don't teach.
    """
    x, labels = _rows(df, columns, target, batch_size * batch_num)
    if not len(x):
        raise ValueError("there is nothing to learn from")
    rng = np.random.default_rng(seed)
    if start is not None:
        net = Network(start.kind, start.columns, start.classes, [w.copy() for w in start.layers], start.target)
    else:
        classes = sorted(set(labels)) if classify else None
        y = None if classify else np.array(labels, np.float64)
        net = Network(kind, columns, classes, [np.stack([x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)])], (0.0, 1.0) if classify else (float(y.mean()), float(max(y.std(), 1e-9))))
        n, k = len(columns), len(columns)
        widths = [n + (k * (k + 1) // 2 if kind == "cross" else 0), *(hidden if kind == "mlp" else ()), len(classes) if classify else 1]
        for a, b in zip(widths, widths[1:]):
            net.layers.append(np.concatenate([rng.standard_normal((a, b)) * np.sqrt(2 / a), np.zeros((1, b))]))
    if net.classes is not None:
        at = {c: i for i, c in enumerate(net.classes)}
        keep = [i for i, c in enumerate(labels) if c in at]
        x, y = x[keep], np.array([at[labels[i]] for i in keep])
    else:
        y = (np.array(labels, np.float64) - net.target[0]) / net.target[1]
    m, v = ([np.zeros_like(w) for w in net.layers] for _ in range(2))
    per = -(-len(x) // batch_size)
    steps = max(epoch * per, LEAST_STEPS)
    for step in range(1, steps + 1):
        if (step - 1) % per == 0:
            order = rng.permutation(len(x))
        pick = order[(step - 1) % per * batch_size :][:batch_size]
        h = net.forward(x[pick])
        if net.classes is not None:
            p = np.exp(h[-1] - h[-1].max(axis=1, keepdims=True))
            d = p / p.sum(axis=1, keepdims=True)
            d[np.arange(len(pick)), y[pick]] -= 1
        else:
            d = h[-1] - y[pick, None]
        d = d / len(pick)
        for k in range(len(net.layers) - 1, 0, -1):
            w = net.layers[k]
            g = np.concatenate([h[k - 1].T @ d, d.sum(axis=0, keepdims=True)])
            d = (d @ w[:-1].T) * (h[k - 1] > 0)
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            rate = 0.03 * (1 - (step - 1) / steps)
            net.layers[k] = w - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


# ---------------------------------------------------------------- tensors with delta coding


def pack(x: np.ndarray, base: np.ndarray | None, tolerance: float) -> dict:
    """A tensor as codes of its difference from ``base``: every number is read back within ``tolerance``.

    The width follows the difference's span: the bits that steps of twice the tolerance need, none for a constant.
    """
    delta = x - base if base is not None else x
    low, span = float(delta.min()), float(delta.max() - delta.min())
    bits = 0 if span == 0 else int(np.ceil(np.log2(span / (2 * tolerance) + 1)))
    step = span / max(2**bits - 1, 1)
    codes = np.zeros(x.shape, np.uint64) if bits == 0 else np.rint((delta - low) / step).astype(np.uint64)
    wide = np.unpackbits(codes.reshape(-1, 1).view(np.uint8), axis=1, bitorder="little")[:, :bits]
    return {"shape": list(x.shape), "scale": step, "zero": low, "bits": bits, "codes": np.packbits(wide.reshape(-1), bitorder="little").tobytes()}


def unpack(packet: dict, base: np.ndarray | None) -> np.ndarray:
    n, bits = int(np.prod(packet["shape"])), packet["bits"]
    wide = np.zeros((n, 64), np.uint8)
    wide[:, :bits] = np.unpackbits(np.frombuffer(packet["codes"], np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    codes = np.packbits(wide, axis=1, bitorder="little").view(np.uint64).reshape(packet["shape"])
    delta = codes.astype(np.float64) * packet["scale"] + packet["zero"]
    return delta + base if base is not None else delta


# ---------------------------------------------------------------- the store


class Store:
    """Models in three tables under a folder: ``model``, ``layer`` (versions by time) and ``router``.

    A model has the newest version of each of its layers, or of those before a time. A layer is coded against the version
    of the same shape that lies nearest, of its own model or another, if that takes fewer bits.
    """

    SCHEMAS = {
        "model": "model_id long, create_time double, kind string, meta string, deleted boolean",
        "layer": "model_id long, layer_id int, create_time double, base_model long, base_time double, bits int, scale double, zero double, shape array<int>, codes binary",
        "router": "table_name string, features array<string>, target string, kind string, model_id long, create_time double",
    }

    def __init__(self, spark: SparkSession, path: str, tolerance: float = 1e-4):
        self.spark, self.path, self.tolerance = spark, path.rstrip("/"), tolerance

    def table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMAS[name]).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMAS[name])

    def _add(self, name: str, rows: list) -> None:
        self.spark.createDataFrame(rows, self.SCHEMAS[name]).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def _tensor(self, row) -> np.ndarray:
        packet = {"shape": list(row.shape), "scale": row["scale"], "zero": row.zero, "bits": row.bits, "codes": bytes(row.codes)}
        base = None
        if row.base_model is not None:
            base = self._tensor(self.table("layer").where((F.col("model_id") == row.base_model) & (F.col("layer_id") == row.layer_id) & (F.col("create_time") == row.base_time)).first())
        return unpack(packet, base)

    def _put(self, model_id: int, layer_id: int, x: np.ndarray, now: float) -> tuple:
        best, near = pack(x, None, self.tolerance), None
        same = self.table("layer").where((F.col("layer_id") == layer_id) & (F.col("shape") == F.array(*map(F.lit, x.shape)))).orderBy(F.desc("create_time")).limit(8)
        for row in same.collect():  # a few versions of one layer's size
            packet = pack(x, self._tensor(row), self.tolerance)
            if packet["bits"] < best["bits"]:
                best, near = packet, row
        return (model_id, layer_id, now, near and near.model_id, near and near.create_time, best["bits"], best["scale"], best["zero"], best["shape"], bytearray(best["codes"]))

    def save(self, net: Network, model_id: int | None = None) -> int:
        """A new model, or a new version of all its layers."""
        now = time.time()
        if model_id is None:
            model_id = (self.table("model").agg(F.max("model_id")).first()[0] or 0) + 1
            meta = json.dumps({"columns": net.columns, "classes": net.classes, "target": net.target})
            self._add("model", [(model_id, now, net.kind, meta, False)])
        self._add("layer", [self._put(model_id, i, w, now) for i, w in enumerate(net.layers)])
        return model_id

    def update(self, model_id: int, layer_id: int, x: np.ndarray) -> None:
        """A new version of one layer."""
        self._add("layer", [self._put(model_id, layer_id, x, time.time())])

    def load(self, model_id: int, before: float | None = None) -> Network:
        row = self.table("model").where(F.col("model_id") == model_id).orderBy(F.desc("create_time")).first()
        if row is None or row.deleted:
            raise KeyError(f"model {model_id} does not exist")
        layers = self.table("layer").where(F.col("model_id") == model_id)
        layers = layers.where(F.col("create_time") <= before) if before is not None else layers
        newest = layers.groupBy("layer_id").agg(F.max("create_time").alias("create_time"))
        found = sorted(layers.join(newest, ["layer_id", "create_time"]).collect(), key=lambda r: r.layer_id)
        meta = json.loads(row.meta)
        return Network(row.kind, meta["columns"], meta["classes"], [self._tensor(r) for r in found], tuple(meta["target"]))

    def delete(self, model_id: int) -> None:
        """The model is no longer found; its layers stay, as others may be coded against them."""
        row = self.table("model").where(F.col("model_id") == model_id).first()
        self._add("model", [(model_id, time.time(), row.kind, row.meta, True)])

    def route(self, table: str, features: list[str], target: str, kind: str, model_id: int) -> None:
        self._add("router", [(table, sorted(features), target, kind, model_id, time.time())])

    def lookup(self, table: str, features: list[str], target: str, kind: str) -> int | None:
        """The newest model that was trained for these, whatever the features' order."""
        gone = self.table("model").where("deleted").select("model_id").distinct()
        same = (F.col("table_name") == table) & (F.col("target") == target) & (F.col("kind") == kind) & (F.col("features") == F.array(*map(F.lit, sorted(features))))
        row = self.table("router").where(same).join(gone, "model_id", "left_anti").orderBy(F.desc("create_time")).first()
        return None if row is None else row.model_id


# ---------------------------------------------------------------- what statements call


def train(store: Store, table: str, columns: list[str], target: str, kind: str | None = None, classify: bool = False, **options) -> int:
    """Train on a table of the session and store the model; options as of ``fit``, defaults from the session's settings."""
    spark = store.spark
    if len(columns) > int(setting(spark, "max_features")):
        raise ValueError(f"{len(columns)} features are more than larkspur.max_features allows")
    options = {"batch_size": int(setting(spark, "batch_size")), "batch_num": int(setting(spark, "num_batches")), "epoch": int(setting(spark, "epoch"))} | options
    net = fit(spark.table(table), columns, target, kind or setting(spark, "model_name"), classify, **options)
    model_id = store.save(net)
    store.route(table, columns, target, "class" if classify else "value", model_id)
    return model_id


def inference(store: Store, model_id: int, df: DataFrame, out: str = "prediction") -> DataFrame:
    return df.withColumn(out, store.load(model_id).column())


def finetune(store: Store, model_id: int, df: DataFrame, target: str, **options) -> int:
    """Go on training a stored model with new rows; its layers get a new version."""
    old = store.load(model_id)
    return store.save(fit(df, old.columns, target, start=old, **options), model_id)


def predict(store: Store, table: str, ask: DataFrame, columns: list[str], target: str, kind: str, learn: DataFrame | None = None) -> DataFrame:
    """A stored model of the same table, features and target answers; if there is none, one is trained and stored."""
    found = store.lookup(table, columns, target, kind)
    if found is None:
        classify = kind == "class"
        rows = learn if learn is not None else store.spark.table(table)
        spark = store.spark
        net = fit(rows, columns, target, setting(spark, "model_name"), classify, int(setting(spark, "batch_size")), int(setting(spark, "num_batches")), int(setting(spark, "epoch")))
        found = store.save(net)
        store.route(table, columns, target, kind, found)
    return inference(store, found, ask)
