"""Models over pairs of embeddings: projections, closed-form regressors, a small shared-tower network."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import finite_or_zero, squared_difference

#: Labelled rows that the network is fitted on at most: those with the smallest hash of their key.
FIT_ROWS = 20_000


def cleaned(vector: str) -> Column:
    return F.transform(vector, lambda x: finite_or_zero(x.cast("double")))


def pca_project(df: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, list[float]]:
    """`key`, `scores` (k centred projections) and the cumulative explained variance of the k components.

    Non-finite components become 0. The covariance is summed over the cluster; vectors share one length. Signs are
    fixed so that each component's largest loading is positive.
    """
    rows = df.select(key, cleaned(vector).alias("v"))
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    mean = rows.agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(dim)]).first()
    centred = rows.select(key, array_to_vector(F.zip_with("v", F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)).alias("c"))
    model = PCA(k=k, inputCol="c", outputCol="p").fit(centred)
    loads = model.pc.toArray()
    signs = [float(np.sign(loads[np.argmax(np.abs(loads[:, i])), i]) or 1.0) for i in range(k)]
    scores = F.zip_with(vector_to_array("p"), F.array(*[F.lit(s) for s in signs]), lambda a, b: a * b)
    return model.transform(centred).select(key, scores.alias("scores")), np.cumsum(model.explainedVariance.toArray()).tolist()


def pair_features(kind: str, a: str, b: str) -> Column:
    """`linear`: both vectors joined; `linear_distance`: squared differences."""
    joined = F.concat(F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: x.cast("double")))
    return array_to_vector(squared_difference(a, b) if kind == "linear_distance" else joined)


def fit_linear(pairs: DataFrame, kind: str, a: str, b: str, label: str):
    """Least-squares regressor, the optimum of the loss that gradient descent approaches."""
    data = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(label).isNotNull()).select(pair_features(kind, a, b).alias("features"), F.col(label).cast("double").alias("label"))
    return LinearRegression(solver="normal", regParam=1e-6, standardization=False).fit(data)


def predict_linear(model, pairs: DataFrame, kind: str, a: str, b: str, keep: Sequence[str]) -> DataFrame:
    data = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keep, pair_features(kind, a, b).alias("features"))
    return model.transform(data).select(*keep, "prediction")


@dataclass
class Network:
    """One tower shared by both sides, two hidden layers on the joined towers, one output."""

    weights: list[np.ndarray]

    @staticmethod
    def start(dim: int, tower: int, hidden: int, rng: np.random.Generator) -> "Network":
        shapes = [(dim, tower), (2 * tower, hidden), (hidden, hidden), (hidden, 1)]
        out: list[np.ndarray] = []
        for n, m in shapes:
            out += [rng.uniform(-1, 1, (n, m)) / np.sqrt(n), np.zeros(m)]
        return Network(out)

    def forward(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        ta, tb = np.maximum(a @ w[0] + w[1], 0), np.maximum(b @ w[0] + w[1], 0)
        joined = np.concatenate([ta, tb], 1)
        h1 = np.maximum(joined @ w[2] + w[3], 0)
        h2 = np.maximum(h1 @ w[4] + w[5], 0)
        return (h2 @ w[6] + w[7])[:, 0], (ta, tb, joined, h1, h2)

    def gradients(self, a: np.ndarray, b: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w = self.weights
        out, (ta, tb, joined, h1, h2) = self.forward(a, b)
        d = (2 * (out - y) / len(y))[:, None]
        g6, g7 = h2.T @ d, d.sum(0)
        d2 = (d @ w[6].T) * (h2 > 0)
        g4, g5 = h1.T @ d2, d2.sum(0)
        d1 = (d2 @ w[4].T) * (h1 > 0)
        g2, g3 = joined.T @ d1, d1.sum(0)
        dj = d1 @ w[2].T
        half = ta.shape[1]
        da, db = dj[:, :half] * (ta > 0), dj[:, half:] * (tb > 0)
        return [a.T @ da + b.T @ db, da.sum(0) + db.sum(0), g2, g3, g4, g5, g6, g7]


class Checkpoints:
    """Training states in a folder of any file system Spark knows: `epoch_<n>` files and their validation losses.

    A state is an archive of plain arrays, so reading one runs no code. The newest and the best state stay, older ones go.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path, name)

    def epochs(self) -> list[int]:
        if not self.fs.exists(self.path):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path)]
        return sorted(int(n[6:]) for n in names if n.startswith("epoch_") and n[6:].isdigit())

    def save(self, epoch: int, state: dict[str, np.ndarray], keep: Sequence[int] = ()) -> None:
        data = io.BytesIO()
        np.savez(data, **state)
        # Written beside and moved, so a run that ends in between leaves no half state.
        part = self._at(f".part_{epoch}")
        out = self.fs.create(part, True)
        out.write(bytearray(data.getvalue()))
        out.close()
        self.fs.delete(self._at(f"epoch_{epoch}"), False)
        self.fs.rename(part, self._at(f"epoch_{epoch}"))
        for old in self.epochs():
            if old not in (epoch, *keep):
                self.fs.delete(self._at(f"epoch_{old}"), False)

    def load(self, epoch: int) -> dict[str, np.ndarray]:
        stream = self.fs.open(self._at(f"epoch_{epoch}"))
        data = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        stream.close()
        return dict(np.load(io.BytesIO(data), allow_pickle=False))

    def newest(self) -> dict[str, np.ndarray] | None:
        known = self.epochs()
        return self.load(known[-1]) if known else None


def _pack(name: str, arrays: Sequence[np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}_{i}": x for i, x in enumerate(arrays)}


def _unpack(name: str, state: dict[str, np.ndarray]) -> list[np.ndarray]:
    return [state[f"{name}_{i}"] for i in range(sum(k.startswith(f"{name}_") for k in state))]


def train_network(a: np.ndarray, b: np.ndarray, y: np.ndarray, tower: int = 64, hidden: int = 32, epochs: int = 60, batch: int = 256, rate: float = 1e-3, patience: int = 5, seed: int = 42, checkpoints: Checkpoints | None = None) -> tuple[Network, list[float]]:
    """Adam on the mean squared error; a tenth of the rows stops it early. The best network counts, not the last.

    With `checkpoints` every epoch is saved and a run that ended early goes on after its newest epoch, with the result
    of a run that never ended: each epoch has random numbers of its own. An empty sample gives the starting network.
    """
    rng = np.random.default_rng(seed)
    net = Network.start(a.shape[1], tower, hidden, rng)
    order = rng.permutation(len(y))
    held, fit = order[: max(1, len(y) // 10)], order[max(1, len(y) // 10) :]
    first, second = ([np.zeros_like(w) for w in net.weights] for _ in range(2))
    best, best_loss, best_epoch, bad, step, begin, history = [w.copy() for w in net.weights], np.inf, -1, 0, 0, 0, []
    if checkpoints and (state := checkpoints.newest()):
        net.weights, first, second, best = (_unpack(n, state) for n in ("weight", "first", "second", "best"))
        begin, bad, step, best_epoch = (int(x) for x in state["counts"])
        best_loss, history = float(state["loss"]), state["history"].tolist()
    for epoch in range(begin, epochs if len(y) else 0):
        if bad >= patience:
            break
        mixed = np.random.default_rng([seed, epoch]).permutation(fit)
        for at in range(0, len(fit), batch):
            rows = mixed[at : at + batch]
            step += 1
            for i, g in enumerate(net.gradients(a[rows], b[rows], y[rows])):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                net.weights[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        loss = float(np.mean((net.forward(a[held], b[held])[0] - y[held]) ** 2))
        history.append(loss)
        if loss < best_loss - 1e-6:
            best, best_loss, best_epoch, bad = [w.copy() for w in net.weights], loss, epoch, 0
        else:
            bad += 1
        if checkpoints:
            state = _pack("weight", net.weights) | _pack("first", first) | _pack("second", second) | _pack("best", best)
            checkpoints.save(epoch, state | {"counts": np.array([epoch + 1, bad, step, best_epoch]), "loss": np.array(best_loss), "history": np.array(history)}, [best_epoch])
    return Network(best), history


def checkpoint_network(state: dict[str, np.ndarray]) -> Network:
    """The best network known at a checkpoint."""
    return Network(_unpack("best", state))


def fit_network(pairs: DataFrame, key: Sequence[str], a: str, b: str, label: str, rows: int = FIT_ROWS, folder: str | None = None, **options) -> Network:
    """Network fitted on at most `rows` labelled rows, those with the smallest hash of their key. With a `folder` the run
    can be taken up again after its newest epoch."""
    data = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(label).isNotNull())
    sample = data.orderBy(F.xxhash64(*key), *key).limit(rows).select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(label).cast("double").alias("y")).toPandas()
    if folder:
        options["checkpoints"] = Checkpoints(pairs.sparkSession, folder)
    return train_network(*(np.stack(sample[c].to_list()).astype(np.float64) for c in "ab"), sample["y"].to_numpy(), **options)[0]


def predict_experiments(experiments: Sequence[tuple[str, str, str]], pairs: DataFrame, stores: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """`experiment`, `query`, `target`, `prediction` of every experiment (name, embedding name, folder of checkpoints), each
    by the best network of its newest checkpoint.

    `stores`: `id`, `embedding_name`, `embedding`. Experiments without a checkpoint, and those in `done` (`experiment`),
    give no rows. One join per embedding serves its experiments; pairs without both vectors fall out.
    """
    spark = pairs.sparkSession
    known = {r[0] for r in done.select("experiment").distinct().collect()} if done is not None else set()
    out = spark.createDataFrame([], "experiment string, query string, target string, prediction double")
    by_store: dict[str, list[tuple[str, Network]]] = {}
    for name, embedding, folder in experiments:
        if name not in known and (state := Checkpoints(spark, folder).newest()):
            by_store.setdefault(embedding, []).append((name, checkpoint_network(state)))
    for embedding, networks in by_store.items():
        one = stores.filter(F.col("embedding_name") == embedding)
        side = lambda c, v: one.select(F.col("id").alias(c), F.col("embedding").alias(v))  # noqa: E731, B023
        both = pairs.select("query", "target").join(side("query", "a"), "query").join(side("target", "b"), "target")
        for name, net in networks:
            out = out.unionByName(predict_network(net, both, "a", "b", ["query", "target"]).withColumn("experiment", F.lit(name)))
    return out


def predict_network(net: Network, pairs: DataFrame, a: str, b: str, keep: Sequence[str]) -> DataFrame:
    """`keep` and `prediction` of every pair with both vectors, batch by batch on the executors."""
    rows = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keep, F.col(a).alias("_a"), F.col(b).alias("_b"))
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "prediction double"])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.asarray(batch.column(i).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1) for i in (n, n + 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(net.forward(x, y)[0])], names=[*keep, "prediction"])

    return rows.mapInArrow(run, schema)


def random_vectors(ids: DataFrame, key: str, dim: int) -> DataFrame:
    """Standard normal baseline vectors that depend only on id and dimension."""
    from ..functions.scores import hashed_normal

    return ids.select(key, F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda p: hashed_normal(F.col(key), p, dim).cast("float")).alias("embedding"))
