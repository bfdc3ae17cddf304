"""In-engine learning: encoding, preparation, training, prediction, metrics and vector search.

Models are fitted by distributed aggregates (normal equations, class counts) or by Spark's own learners; nothing but
sums of a size fixed by the number of features reaches the driver.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .relational import running_sum

#: Categories that an expression may list; beyond it a dictionary is joined, or the step refuses.
CATEGORIES = 1000
#: Query vectors that are broadcast at once.
QUERIES = 20_000

# ---------------------------------------------------------------- encoding


def encode_mapping(df: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """``(text, encoded)``: stable codes from 1; new values get the next codes in order, known ones keep theirs."""
    values = df.select(F.col(column).alias("text")).where("text is not null").distinct()
    base = 0
    if known is not None:
        values = values.join(known, "text", "left_anti")
        base = known.agg(F.max("encoded")).first()[0] or 0
    fresh = running_sum(values, [F.col("text")], F.lit(1).cast("long"), "_n").select("text", (F.col("_n") + 1 + base).cast("int").alias("encoded"))
    return fresh if known is None else known.unionByName(fresh)


def encode_column(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """The column replaced by its codes; null for null and for values the mapping lacks."""
    m = mapping.withColumnsRenamed({"text": "_text", "encoded": "_code"})
    return df.join(m, df[column] == m._text, "left").select(*(F.col("_code").alias(c) if c == column else df[c] for c in df.columns))


# ---------------------------------------------------------------- preparation (fitted on training rows, applied anywhere)


@dataclass
class Step:
    """A fitted preparation: an expression for each column it makes, or a dictionary that is joined to one column."""

    name: str
    exprs: dict[str, Column] = field(default_factory=dict)
    drop: list[str] = field(default_factory=list)
    codes: tuple[str, DataFrame] | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.codes:
            return encode_column(df, *self.codes)
        return df.withColumns(self.exprs).drop(*self.drop)


def _categories(df: DataFrame, column: str) -> list | None:
    """A column's values in order; None if they are more than ``CATEGORIES``."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(CATEGORIES + 1).collect()
    return None if len(found) > CATEGORIES else sorted(r[0] for r in found)


def _stats(df: DataFrame, aggs: dict[str, Column]) -> dict:
    return df.agg(*(a.alias(k) for k, a in aggs.items())).first().asDict()


def imputer(df: DataFrame, columns: list[str], how: str = "mean", value=None) -> Step:
    """``mean``, ``median``, ``mode`` (smallest of the most frequent) or a given ``value``."""
    if how == "value":
        got = dict.fromkeys(columns, value)
    else:
        make = {"mean": lambda c: F.avg(c), "median": lambda c: F.expr(f"percentile_cont(0.5) WITHIN GROUP (ORDER BY {c})"), "mode": lambda c: F.expr(f"mode() WITHIN GROUP (ORDER BY {c})")}[how]
        got = _stats(df, {c: make(c) for c in columns})
    return Step(f"imputer_{how}", {c: F.coalesce(F.col(c), F.lit(got[c])) for c in columns})


def scaler(df: DataFrame, columns: list[str], how: str) -> Step:
    """``minmax``, ``maxabs``, ``standard`` (population deviation) or ``robust``; a constant column becomes 0."""
    aggs: dict[str, Column] = {}
    for c in columns:
        if how == "minmax":
            aggs |= {f"{c}_a": F.min(c), f"{c}_b": F.max(c) - F.min(c)}
        elif how == "maxabs":
            aggs |= {f"{c}_a": F.lit(0.0), f"{c}_b": F.max(F.abs(F.col(c)))}
        elif how == "standard":
            aggs |= {f"{c}_a": F.avg(c), f"{c}_b": F.stddev_pop(c)}
        else:
            q = lambda p: F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY {c})")  # noqa: B023, E731
            aggs |= {f"{c}_a": q(0.5), f"{c}_b": q(0.75) - q(0.25)}
    got = _stats(df, {k: F.max(a) if how == "maxabs" and k.endswith("_a") else a for k, a in aggs.items()})
    return Step(f"scaler_{how}", {c: F.coalesce(F.try_divide(F.col(c) - F.lit(float(got[f"{c}_a"] or 0)), F.lit(float(got[f"{c}_b"] or 0))), F.when(F.col(c).isNotNull(), 0.0)) for c in columns})


def normalizer(columns: list[str]) -> Step:
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0)))
    return Step("normalizer", {c: F.coalesce(F.try_divide(F.col(c), norm), F.lit(0.0)) for c in columns})


def kbins(df: DataFrame, column: str, n: int, how: str = "quantile") -> Step:
    """Bin numbers from 0; quantile bins have upper edges inside, uniform ones lower."""
    if how == "uniform":
        s = _stats(df, {"lo": F.min(column), "hi": F.max(column)})
        width = (s["hi"] - s["lo"]) / n or 1
        return Step("kbins", {column: F.least(F.floor((F.col(column) - s["lo"]) / width), F.lit(n - 1)).cast("int")})
    s = _stats(df, {f"q{i}": F.expr(f"percentile_cont({i / n}) WITHIN GROUP (ORDER BY {column})") for i in range(1, n)})
    edges = sorted({float(v) for v in s.values() if v is not None})
    return Step("kbins", {column: F.when(F.col(column).isNotNull(), sum(((F.col(column) > e).cast("int") for e in edges), F.lit(0)))})


def one_hot(df: DataFrame, column: str) -> Step:
    """A 0/1 column for each value, in order, of which there may be ``CATEGORIES``."""
    values = _categories(df, column)
    if values is None:
        raise ValueError(f"{column} has more than {CATEGORIES} values; encode it by a dictionary instead")
    return Step("one_hot", {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}, [column])


def label_encoder(df: DataFrame, column: str) -> Step:
    """Codes from 0 in order of the values; null for null and for new values. Many values make a dictionary that is joined."""
    values = _categories(df, column)
    if values is None:
        m = encode_mapping(df, column)
        return Step("label", codes=(column, m.withColumn("encoded", F.col("encoded").cast("long") - 1)))
    return Step("label", {column: F.nullif(F.array_position(F.array(*map(F.lit, values)), F.col(column)), F.lit(0).cast("long")) - 1})


def variance_threshold(df: DataFrame, columns: list[str], least: float = 0.0) -> Step:
    got = _stats(df, {c: F.var_pop(c) for c in columns})
    return Step("variance_threshold", {}, [c for c in columns if (got[c] or 0.0) <= least])


def polynomial(columns: list[str], squares: bool = True) -> Step:
    """Products of pairs, with squares (``polynomial``) or without (``interaction``)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i if squares else i + 1 :]]
    return Step("polynomial", {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def power_transform(columns: list[str]) -> Step:
    """A signed log, the fixed member of the power family."""
    return Step("power", {c: F.signum(F.col(c)) * F.log1p(F.abs(F.col(c))) for c in columns})


def pca(df: DataFrame, columns: list[str], k: int) -> Step:
    """Principal components from one pass of sums; signs are set so that each one's largest weight is positive."""
    _, mean, cov = _moments(df, columns)
    values, vectors = np.linalg.eigh(cov)
    out = {}
    for j, i in enumerate(np.argsort(values)[::-1][:k]):
        v = vectors[:, i] * np.sign(vectors[np.argmax(np.abs(vectors[:, i])), i])
        out[f"pc{j + 1}"] = sum(((F.col(c) - float(m)) * float(w) for c, m, w in zip(columns, mean, v)), F.lit(0.0))
    return Step("pca", out)


def _moments(df: DataFrame, columns: list[str]):
    aggs = {"n": F.count("*")} | {f"m{i}": F.avg(F.col(c).cast("double")) for i, c in enumerate(columns)}
    aggs |= {f"c{i}_{j}": F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i}
    s = _stats(df, aggs)
    n = len(columns)
    cov = np.array([[s[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    return s["n"], np.array([s[f"m{i}"] or 0.0 for i in range(n)]), cov


def prepare(df: DataFrame, train: DataFrame, numeric: list[str], text: list[str], order: str = "impute,encode,scale,features,select") -> DataFrame:
    """A preparation pipeline; every step is fitted on ``train`` as the steps before left it."""
    for what in order.split(","):
        live = [c for c in numeric if c in train.columns]
        steps = {
            "impute": lambda: [imputer(train, live, "mean"), *([imputer(train, text, "mode")] if text else [])],
            "encode": lambda: [label_encoder(train, c) for c in text],
            "scale": lambda: [scaler(train, live, "standard")],
            "features": lambda: [polynomial(live[:2], squares=False)] if len(live) > 1 else [],
            "select": lambda: [variance_threshold(train, live)],
        }[what]()
        for s in steps:
            df, train = s.apply(df), s.apply(train)
    return df


# ---------------------------------------------------------------- models


@dataclass
class Linear:
    columns: list[str]
    weights: list[float]
    bias: float
    classes: list | None = None

    def raw(self) -> Column:
        return sum((F.col(c).cast("double") * w for c, w in zip(self.columns, self.weights)), F.lit(float(self.bias)))

    def column(self) -> Column:
        if self.classes is None:
            return self.raw()
        p = 1 / (1 + F.exp(-self.raw()))
        return F.when(p >= 0.5, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0]))

    def dump(self) -> bytes:
        return json.dumps(self.__dict__).encode()

    @staticmethod
    def load(data: bytes) -> Linear:
        return Linear(**json.loads(data))


def fit_linear(df: DataFrame, columns: list[str], target: str, ridge: float = 0.0) -> Linear:
    """Least squares in closed form: one aggregation of moments, solved on the driver (features squared numbers)."""
    rows = df.dropna(subset=[*columns, target])
    _, mean, cov = _moments(rows, [*columns, target])
    k = len(columns)
    w = np.linalg.lstsq(cov[:k, :k] + ridge * np.eye(k), cov[:k, k], rcond=None)[0]
    return Linear(columns, [float(x) for x in w], float(mean[k] - mean[:k] @ w))


def fit_logistic(df: DataFrame, columns: list[str], target: str, rounds: int = 8, ridge: float = 1e-3) -> Linear:
    """Two classes by Newton steps; each step is one aggregation of a gradient and a Hessian."""
    rows = df.dropna(subset=[*columns, target])
    classes = [r[0] for r in rows.select(target).distinct().orderBy(target).limit(3).collect()]
    if len(classes) != 2:
        raise ValueError(f"{target} has {len(classes)} classes or more; two are needed")
    _, mean, cov = _moments(rows, columns)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    x = [F.lit(1.0), *((F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(columns, mean, sd))]
    w = np.zeros(len(x))
    y = (F.col(target) == F.lit(classes[1])).cast("double")
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-sum((v * float(c) for v, c in zip(x, w)), F.lit(0.0))))
        q = p * (1 - p)
        aggs = {f"g{i}": F.sum((y - p) * a) for i, a in enumerate(x)} | {f"h{i}_{j}": F.sum(q * a * b) for i, a in enumerate(x) for j, b in enumerate(x) if j >= i}
        s = _stats(rows, aggs)
        h = np.array([[s[f"h{min(i, j)}_{max(i, j)}"] for j in range(len(x))] for i in range(len(x))]) + ridge * np.eye(len(x))
        step = np.linalg.solve(h, np.array([s[f"g{i}"] for i in range(len(x))]) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    own = w[1:] / sd
    return Linear(columns, [float(v) for v in own], float(w[0] - own @ mean), classes)


def predict(learn: DataFrame, ask: DataFrame, columns: list[str], target: str, kind: str, out: str = "prediction") -> DataFrame:
    """Train, then add ``prediction`` to the rows of ``ask``: a value by least squares, a class by logistic regression,
    or by a forest of Spark's own where there are more than two classes."""
    if kind == "value":
        return ask.withColumn(out, fit_linear(learn, columns, target).column())
    n = learn.select(target).distinct().limit(3).count()
    if n == 2:
        return ask.withColumn(out, fit_logistic(learn, columns, target).column())
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    index = StringIndexer(inputCol=target, outputCol="_y", handleInvalid="keep").fit(learn)
    plan = Pipeline(stages=[index, VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep"), RandomForestClassifier(featuresCol="_x", labelCol="_y", predictionCol="_p", seed=1, numTrees=20, maxBins=256), IndexToString(inputCol="_p", outputCol=out, labels=index.labels)])
    return plan.fit(learn).transform(ask).select(*ask.columns, out)


class Registry:
    """Models by table, features and target, with versions, as Parquet: ``train``, ``lookup``, ``inference``, ``finetune``."""

    SCHEMA = "model_id long, create_time double, table_name string, feature_columns array<string>, target_column string, model_meta binary"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def models(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def _save(self, model_id: int, table: str, model: Linear, target: str) -> int:
        row = [(model_id, time.time(), table, model.columns, target, bytearray(model.dump()))]
        self.spark.createDataFrame(row, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return model_id

    def train(self, table: str, columns: list[str], target: str, kind: str = "value") -> int:
        fit = fit_linear if kind == "value" else fit_logistic
        top = self.models().agg(F.max("model_id")).first()[0] or 0
        return self._save(top + 1, table, fit(self.spark.table(table), columns, target), target)

    def lookup(self, table: str, columns: list[str], target: str) -> int | None:
        same = (F.col("table_name") == table) & (F.col("target_column") == target) & (F.array_sort("feature_columns") == F.array(*map(F.lit, sorted(columns))))
        return self.models().where(same).agg(F.max("model_id")).first()[0]

    def load(self, model_id: int) -> Linear:
        row = self.models().where(F.col("model_id") == model_id).orderBy(F.desc("create_time")).first()
        if row is None:
            raise KeyError(f"model {model_id} doesn't exist")
        return Linear.load(bytes(row.model_meta))

    def inference(self, model_id: int, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.load(model_id).column())

    def finetune(self, model_id: int, df: DataFrame, target: str, rate: float = 0.5) -> int:
        """A new version between the old weights and those of the new rows."""
        old = self.load(model_id)
        new = (fit_linear if old.classes is None else fit_logistic)(df, old.columns, target)
        mixed = Linear(old.columns, [a + rate * (b - a) for a, b in zip(old.weights, new.weights)], old.bias + rate * (new.bias - old.bias), old.classes)
        table = self.models().where(F.col("model_id") == model_id).first().table_name
        return self._save(model_id, table, mixed, target)


# ---------------------------------------------------------------- metrics


def classification_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    tp, fp, fn, ok = (F.count_if(c) for c in ((F.col(y) == 1) & (F.col(p) == 1), (F.col(y) == 0) & (F.col(p) == 1), (F.col(y) == 1) & (F.col(p) == 0), F.col(y) == F.col(p)))
    half = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return df.agg((ok / F.count("*")).alias("accuracy"), half(tp, tp + fp).alias("prec"), half(tp, tp + fn).alias("recall"), half(2 * tp, 2 * tp + fp + fn).alias("f1"))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the curve by rank sums over distinct scores (ties count half); 0 if there is one class only."""
    by = df.groupBy(score).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    below = running_sum(by, [F.col(score)], F.col("neg"), "below")
    return below.agg(F.coalesce(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")), F.lit(0.0)).alias("auc"))


def accuracy_at(df: DataFrame, key: str, y: str, score: str, k: int) -> DataFrame:
    """``accuracy@k``: the share of keys with a row ``y = 1`` among their ``k`` best scores; ties go to the positive row."""
    best = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(y).desc())
    top = df.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).groupBy(key).agg(F.max(F.col(y)).alias("hit"))
    return top.agg(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("accuracy"))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    tot = F.var_pop(y) * F.count(y)
    return df.agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.avg(F.when(F.col(y) != 0, F.abs(e / F.nullif(F.col(y), F.lit(0.0))))) * 100).alias("mape"), F.when(tot == 0, 0.0).otherwise(1 - F.sum(e * e) / F.nullif(tot, F.lit(0.0))).alias("r2"))


# ---------------------------------------------------------------- vectors


def knn(queries: DataFrame, base: DataFrame, k: int, qid: str, bid: str, vec: str, distance) -> DataFrame:
    """Exact nearest neighbours: each query's ``k`` nearest, ids breaking ties.

    The queries are counted. Up to ``QUERIES`` are broadcast; more are dealt into blocks of about that many, each of which
    meets every base row by an equi-join on the block's number.
    """
    n = queries.count()
    q = queries.select(F.col(qid).alias("query_id"), F.col(vec).alias("_q"))
    b = base.select(F.col(bid).alias("neighbor_id"), F.col(vec).alias("_b"))
    if n <= QUERIES:
        pairs = b.crossJoin(F.broadcast(q))
    else:
        blocks = -(-n // QUERIES)
        pairs = b.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(q.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "_block")
    near = pairs.select("query_id", "neighbor_id", distance(F.col("_q"), F.col("_b")).alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class VectorIndex:
    """An inverted-file vector index: vectors lie by their nearest of ``cells`` centroids, a query reads its ``probes`` nearest cells.

    Centroids come from at most ``SAMPLE`` vectors by k-means in numpy; every vector is indexed. The index is a Parquet table
    partitioned by cell in the shared folder, so inserts append and a query's cells are pruned at the scan.
    """

    SAMPLE = 20_000

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray):
        self.spark, self.path, self.centroids = spark, path, centroids

    @staticmethod
    def build(df: DataFrame, vec_id: str, vec: str, path: str, cells: int, rounds: int = 12, seed: int = 5) -> VectorIndex:
        rows = df.select(F.col(vec).cast("array<double>").alias("v")).orderBy(F.xxhash64(F.col(vec_id), F.lit(seed)), vec_id).limit(VectorIndex.SAMPLE).collect()
        x = np.array([r.v for r in rows])
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
        for _ in range(rounds):
            near = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).argmin(1)
            sums, counts = np.zeros_like(c), np.bincount(near, minlength=len(c))
            np.add.at(sums, near, x)
            c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        index = VectorIndex(df.sparkSession, path, c)
        index.insert(df, vec_id, vec)
        return index

    def _distances(self, v: Column) -> Column:
        """``(distance, cell)`` of each centroid."""
        cells = F.array(*(F.struct(F.lit(i).alias("cell"), F.array(*map(F.lit, map(float, c))).alias("c")) for i, c in enumerate(self.centroids)))
        return F.transform(cells, lambda x: F.struct(F.aggregate(F.zip_with(v, x["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d).alias("d"), x["cell"].alias("cell")))

    def insert(self, df: DataFrame, vec_id: str, vec: str) -> None:
        """Add vectors, one or many."""
        v = F.col(vec).cast("array<double>")
        rows = df.select(F.col(vec_id).alias("vec_id"), v.alias("vec"), F.array_min(self._distances(v))["cell"].alias("cell"))
        rows.repartition("cell").write.mode("append").partitionBy("cell").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def size(self) -> int:
        return self.table().count()

    def retrieve(self, ids: list) -> DataFrame:
        return self.table().where(F.col("vec_id").isin(ids)).select("vec_id", "vec")

    def query(self, queries: DataFrame, qid: str, vec: str, k: int, probes: int, distance) -> DataFrame:
        """``query_id, neighbor_id, distance, rank``: the ``k`` nearest among the cells that are probed."""
        v = F.col(vec).cast("array<double>")
        q = queries.select(F.col(qid).alias("query_id"), v.alias("_q"), F.explode(F.slice(F.array_sort(self._distances(v)), 1, probes)["cell"]).alias("cell"))
        near = self.table().join(q, "cell").select("query_id", F.col("vec_id").alias("neighbor_id"), distance(F.col("_q"), F.col("vec")).alias("distance"))
        w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
        return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def kmeans_route(df: DataFrame, centroids: DataFrame, vec: str, distance) -> DataFrame:
    """Each vector's nearest centroid (``centroid_id``); the centroids are a fixed small table."""
    c = centroids.agg(F.sort_array(F.collect_list(F.struct("centroid_id", "centroid"))).alias("_c"))
    best = F.array_min(F.transform("_c", lambda x: F.struct(distance(F.col(vec), x["centroid"]).alias("d"), x["centroid_id"].alias("centroid_id"))))
    return df.crossJoin(F.broadcast(c)).withColumn("_best", best).select(*df.columns, F.col("_best.centroid_id").alias("centroid_id"), F.col("_best.d").alias("distance"))


def running_centroid(old: Column, n: Column, x: Column) -> Column:
    """A centroid of ``n`` vectors moved by one more."""
    return F.zip_with(old, x, lambda a, b: a + (b - a) / (n + 1))


def distance_strategy(d: Column, top: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log2(d) / np.log2(top)))


def nbits_strategy(scale: Column, tolerance: float, standard: int, alpha: float) -> Column:
    """Bits for a delta of this scale, and how far beyond the standard number they are."""
    bits = F.ceil(F.log2(scale / tolerance))
    return F.when(bits <= standard, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.exp(-alpha * (bits - standard)))))


def quantize(x: Column, bits: int = 8) -> Column:
    """A vector as ``struct(scale, zero, codes)``; read back within half a step."""
    lo, hi = F.array_min(x), F.array_max(x)
    step = (hi - lo) / float(2**bits - 1)
    codes = F.transform(x, lambda v: F.coalesce(F.round(F.try_divide(v - lo, step)), F.lit(0.0)).cast("int"))
    return F.struct(step.alias("scale"), lo.alias("zero"), codes.alias("codes"))


def dequantize(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: c * q["scale"] + q["zero"])
