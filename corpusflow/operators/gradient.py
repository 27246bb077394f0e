"""Mini-batch gradient training with state: a distributed step per batch.

A softmax classifier over feature vectors (dense, or sparse as TF-IDF makes them). Rows are dealt to batches
once and written by batch, so a step reads its own rows only and an epoch is one pass. In a step every task sums the
gradient of its rows for the broadcast weights; the sums are added by feature, and the driver holds what an optimizer
holds: weights and two moments, of fixed size. Weights, moments and group weights carry over from step to step and
from one call to the next, so training goes on where it stopped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.arrays import pieces
from corpusflow.operators.positions import hash_key
from corpusflow.session import bound_batches, scratch_path

OBJECTIVES = ("ce", "rdrop", "group_dro", "irm")
MAX_GROUPS = 10_000


@dataclass
class GradientConfig:
    """Settings of a run. ``total_steps`` (0: constant rate) is the length of the linear schedule after ``warmup``."""
    n_features: int
    n_classes: int = 2
    objective: str = "ce"
    lr: float = 0.05
    weight_decay: float = 0.0
    clip: float = 1.0             # largest norm of a step's gradient; 0: any
    warmup: int = 0
    total_steps: int = 0
    accumulate: int = 1           # batches whose mean gradient makes a step
    betas: tuple = (0.9, 0.999)
    eps: float = 1e-8
    eta: float = 0.01             # group_dro
    cumulative: bool = True       # group_dro: weights move on from batch to batch, else each batch has its own
    alpha: float = 2.0            # rdrop
    dropout: float = 0.1          # rdrop
    irm_weight: float = 1e3
    irm_mode: str = "reference"
    seed: int = 42

    def rate(self, step: int) -> float:
        """Learning rate of the step after ``step`` steps: linear up over ``warmup``, then linear down to 0."""
        if step < self.warmup:
            return self.lr * step / max(1, self.warmup)
        if not self.total_steps:
            return self.lr
        return self.lr * max(0.0, (self.total_steps - step) / max(1, self.total_steps - self.warmup))


@dataclass
class TrainState:
    """What training carries on: weights (classes x features + bias), Adam moments, steps taken, group weights."""
    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    step: int = 0
    batches: int = 0
    q: dict = field(default_factory=dict)

    @staticmethod
    def new(cfg: GradientConfig) -> TrainState:
        zeros = np.zeros((cfg.n_classes, cfg.n_features + 1))
        return TrainState(zeros.copy(), zeros.copy(), zeros.copy())

    def copy(self) -> TrainState:
        return TrainState(self.w.copy(), self.m.copy(), self.v.copy(), self.step, self.batches, dict(self.q))


# ------------------------------------------------------------------ batches

def batch_of(n_batches: int, id_col: str, seed: int = 42):
    """The batch of a row by seeded hash of its id."""
    return F.pmod(F.conv(F.substring(hash_key(seed, id_col), 1, 8), 16, 10).cast("long"), F.lit(n_batches)).cast("int")


def write_batches(df: DataFrame, n_batches: int, id_col: str, features: str = "features", label: str = "label",
                  group: str | None = None, seed: int = 42, pieces: int = 8, path: str | None = None) -> str:
    """Deal the rows to ``n_batches`` batches by seeded hash of the id and write them by batch: one shuffle for a whole run.

    A batch lies in up to ``pieces`` parts, so a large one keeps many tasks busy. Null labels, ids or features take no
    part; without ``group`` all rows are one group, a null group is the group ''. ``label_b`` and ``lam`` of mixup pairs are kept.
    """
    path = path or scratch_path(df.sparkSession, "batches")
    key = hash_key(seed, id_col)
    batch = batch_of(n_batches, id_col, seed)
    soft = [F.col(c) for c in ("label_b", "lam") if c in df.columns]
    rows = df.select(F.xxhash64(id_col).alias("rid"), F.col(features).alias("features"), F.col(label).cast("int").alias("label"),
                     F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp") if group else F.lit("").alias("grp"),
                     batch.alias("batch"), F.pmod(F.conv(F.substring(key, 9, 8), 16, 10).cast("long"), F.lit(pieces)).alias("piece"), *soft,
                     F.col(id_col).alias("_cf_id")).where("label is not null and features is not null and _cf_id is not null").drop("_cf_id")
    rows.repartition("batch", "piece").drop("piece").write.partitionBy("batch").parquet(path)
    return path


# ------------------------------------------------------------------ one task's rows

class Rows:
    """Rows of an Arrow batch as a sparse matrix, with a constant feature for the bias."""

    def __init__(self, b: pa.RecordBatch, cfg: GradientConfig):
        get = {n: b.column(k) for k, n in enumerate(b.schema.names)}
        vec, n, d = get["features"], b.num_rows, cfg.n_features
        values, index = vec.field("values"), vec.field("indices")
        count = np.diff(values.offsets.to_numpy()).astype(np.int64)
        dense = np.asarray(vec.field("type")) == 1
        sparse_index = index.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.concatenate([np.repeat(np.arange(n), count), np.arange(n)])
        at, into = np.empty(int(count.sum()), np.int64), np.repeat(dense, count)
        at[into] = np.concatenate([np.arange(c) for c in count[dense]]) if dense.any() else []
        at[~into] = sparse_index
        if len(at) and at.max() >= d:
            raise ValueError(f"a vector has feature {at.max()} of {d}")
        self.at = np.concatenate([at, np.full(n, d)])
        self.val = np.concatenate([values.flatten().to_numpy(zero_copy_only=False), np.ones(n)])
        self.n, self.rid, self.grp = n, get["rid"].to_numpy().view(np.uint64), get["grp"].to_pylist()
        y = np.zeros((n, cfg.n_classes))
        lab = get["label"].to_numpy(zero_copy_only=False)
        lam = get["lam"].to_numpy(zero_copy_only=False) if "lam" in get else np.ones(n)
        y[np.arange(n), lab] += lam
        if "label_b" in get:
            y[np.arange(n), get["label_b"].to_numpy(zero_copy_only=False)] += 1 - lam
        self.y, self.cfg = y, cfg

    def dropped(self, salt: int) -> np.ndarray:
        """Values after dropout: which features of a row fall out is a hash of (row, feature, pass)."""
        p = self.cfg.dropout
        with np.errstate(over="ignore"):
            h = self.rid[self.row] + self.at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt) * np.uint64(0xBF58476D1CE4E5B9)
            for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(mult)
            u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
        return np.where((u >= p) | (self.at == self.cfg.n_features), self.val / np.where(self.at == self.cfg.n_features, 1, 1 - p), 0.0)

    def logits(self, w: np.ndarray, val: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, val * w[k, self.at], self.n) for k in range(len(w))], 1)

    def back(self, r: np.ndarray, val: np.ndarray) -> np.ndarray:
        """Gradient of the weights for the gradient ``r`` of the logits."""
        return np.stack([np.bincount(self.at, val * r[self.row, k], self.cfg.n_features + 1) for k in range(r.shape[1])])


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _invariance(z: np.ndarray, p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """IRMv1's derivative by a scale of the logits, per row, and its gradient by the logits."""
    g = ((p - y) * z).sum(1)
    return g, (p - y) + p * (z - (p * z).sum(1, keepdims=True))


# ------------------------------------------------------------------ a step

class Trainer:
    """Trains on the batches of a folder that :func:`write_batches` made, or on frames with its columns, one per batch."""

    def __init__(self, spark, path: str | dict[int, DataFrame], cfg: GradientConfig, state: TrainState | None = None):
        if cfg.objective not in OBJECTIVES:
            raise ValueError(f"objective is one of {OBJECTIVES}")
        bound_batches(spark)
        self.spark, self.cfg = spark, cfg
        self.state = state.copy() if state else TrainState.new(cfg)
        if isinstance(path, str):
            data = spark.read.parquet(path)
            path = {r["batch"]: data.where(F.col("batch") == r["batch"]).drop("batch") for r in data.select("batch").distinct().collect()}
            kinds = [data.schema]
        else:
            kinds = [df.schema for df in path.values()]
        if not all(isinstance(x["features"].dataType, VectorUDT) for x in kinds):
            raise ValueError("features is a vector column")
        self.data, self.ids = path, sorted(path)
        self.sum: np.ndarray | None = None          # gradients waiting for a step
        self.waiting = 0

    def order(self, epoch: int) -> list[int]:
        """Batches of an epoch in a seeded order of its own."""
        return [int(b) for b in np.random.default_rng([self.cfg.seed, epoch]).permutation(self.ids)]

    def _rows(self, batch: int) -> DataFrame:
        return self.data[batch]

    def group_sums(self, batch: int) -> dict[str, tuple[float, float, int]]:
        """Per group of the batch: sum of losses, sum of IRMv1 derivatives, rows."""
        cfg, held = self.cfg, self.spark.sparkContext.broadcast(self.state.w)

        def run(batches):
            sums: dict[str, list] = {}
            for b in pieces(batches):
                rows = Rows(b, cfg)
                z = rows.logits(held.value, rows.val)
                lp = log_softmax(z)
                ce, g = -(rows.y * lp).sum(1), _invariance(z, np.exp(lp), rows.y)[0]
                for k, name in enumerate(rows.grp):
                    s = sums.setdefault(name, [0.0, 0.0, 0])
                    s[0] += ce[k]
                    s[1] += g[k]
                    s[2] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([v[k] for v in sums.values()], t) for k, t in
                                              enumerate((pa.float64(), pa.float64(), pa.int64())))], names=["grp", "ce", "g", "n"])

        got = (self._rows(batch).mapInArrow(run, "grp string, ce double, g double, n long").groupBy("grp")
               .agg(F.sum("ce").alias("ce"), F.sum("g").alias("g"), F.sum("n").alias("n")).limit(MAX_GROUPS + 1).collect())
        held.unpersist()
        if len(got) > MAX_GROUPS:
            raise ValueError(f"more than {MAX_GROUPS} groups in a batch: deal them to buckets with domain_bucket first")
        return {r["grp"]: (r["ce"], r["g"], r["n"]) for r in sorted(got, key=lambda r: r["grp"])}

    def gradient(self, batch: int, ce_weight: dict | None = None, inv_weight: dict | None = None) -> tuple[np.ndarray, float, int]:
        """(sum over rows of the weighted gradient, sum of row losses, rows); a row weighs as its group does."""
        cfg, width, salt = self.cfg, self.cfg.n_features + 1, 2 * self.state.batches
        held = self.spark.sparkContext.broadcast((self.state.w, ce_weight, inv_weight))

        def run(batches):
            w, by_group, by_inv = held.value
            grad, loss, n = np.zeros(w.shape), 0.0, 0
            for b in pieces(batches):
                rows = Rows(b, cfg)
                if not rows.n:
                    continue
                n += rows.n
                if cfg.objective == "rdrop":
                    x1, x2 = rows.dropped(salt + cfg.seed), rows.dropped(salt + cfg.seed + 1)
                    l1, l2 = log_softmax(rows.logits(w, x1)), log_softmax(rows.logits(w, x2))
                    p1, p2 = np.exp(l1), np.exp(l2)
                    kl = (p2 * (l2 - l1)).sum(1, keepdims=True)
                    grad += rows.back((p1 - rows.y) / 2 + cfg.alpha * (p1 - p2), x1)
                    grad += rows.back((p2 - rows.y) / 2 + cfg.alpha * p2 * ((l2 - l1) - kl), x2)
                    loss += float((-(rows.y * (l1 + l2)).sum(1) / 2).sum() + cfg.alpha * kl.sum())
                    continue
                z = rows.logits(w, rows.val)
                lp = log_softmax(z)
                r, p = np.exp(lp) - rows.y, np.exp(lp)
                if by_group is not None:
                    r = r * np.array([by_group[x] for x in rows.grp])[:, None]
                if by_inv is not None:
                    r = r + _invariance(z, p, rows.y)[1] * np.array([by_inv[x] for x in rows.grp])[:, None]
                grad += rows.back(r, rows.val)
                loss += float(-(rows.y * lp).sum())
            at = np.flatnonzero(grad.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(grad.ravel()[at], [loss, n]))], names=["i", "x"])

        got = self._rows(batch).mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()   # one row per weight at most
        held.unpersist()
        i, x = got["i"].to_numpy(), got["x"].to_numpy()
        out = np.zeros(cfg.n_classes * width)
        out[i[i >= 0]] = x[i >= 0]
        return out.reshape(cfg.n_classes, width), float(x[i == -1].sum()), int(x[i == -2].sum())

    def batch(self, batch: int) -> dict:
        """Loss and gradient of one batch, then a step if enough batches have met."""
        cfg, st = self.cfg, self.state
        if cfg.objective in ("ce", "rdrop"):
            grad, loss, n = self.gradient(batch)
            loss /= max(1, n)
        else:
            sums = self.group_sums(batch)
            n = sum(s[2] for s in sums.values())
            if cfg.objective == "group_dro":
                step = {g: np.exp(cfg.eta * s[0] / s[2]) for g, s in sums.items()}
                if cfg.cumulative:
                    for g in sums:
                        st.q.setdefault(g, 1.0)
                    total = sum(st.q[g] * step.get(g, 1.0) for g in st.q)
                    st.q = {g: q * step.get(g, 1.0) / total for g, q in sorted(st.q.items())}
                    here = sum(st.q[g] for g in sums)
                    weight = {g: st.q[g] / here for g in sums}
                else:
                    weight = {g: x / sum(step.values()) for g, x in step.items()}
                loss = sum(weight[g] * s[0] for g, s in sums.items()) / n
                grad, _, _ = self.gradient(batch, weight)
            else:
                able = {g: s for g, s in sums.items() if s[2] >= 2} if len(sums) >= 2 else {}
                per = cfg.irm_weight / max(1, len(able))
                value = 0 if cfg.irm_mode == "reference" else 1
                mean = {g: able[g][value] / able[g][2] if g in able else 0.0 for g in sums}
                loss = sum(s[0] for s in sums.values()) / n + per * sum(m * m for m in mean.values())
                pull = {g: n * per * 2 * m / sums[g][2] for g, m in mean.items()}
                if cfg.irm_mode == "reference":
                    grad, _, _ = self.gradient(batch, {g: 1 + x for g, x in pull.items()})
                else:
                    grad, _, _ = self.gradient(batch, None, pull)
        st.batches += 1
        grad = grad / max(1, n)
        self.sum = grad if self.sum is None else self.sum + grad
        self.waiting += 1
        row = {"batch": batch, "n": n, "loss": float(loss), "grad_norm": float(np.sqrt((grad ** 2).sum())), "lr": 0.0, "step": st.step}
        if self.waiting == cfg.accumulate:
            row["lr"] = self.apply()
            row["step"] = st.step
        return row

    def apply(self) -> float:
        """AdamW on the mean of the waiting gradients, clipped by its norm; the bias does not decay."""
        cfg, st = self.cfg, self.state
        g = self.sum / cfg.accumulate
        norm = float(np.sqrt((g ** 2).sum()))
        if cfg.clip and norm > cfg.clip:
            g = g * (cfg.clip / (norm + 1e-6))
        rate, (b1, b2) = cfg.rate(st.step), cfg.betas
        st.step += 1
        st.m, st.v = b1 * st.m + (1 - b1) * g, b2 * st.v + (1 - b2) * g * g
        st.w[:, :-1] *= 1 - rate * cfg.weight_decay
        st.w -= rate * (st.m / (1 - b1 ** st.step)) / (np.sqrt(st.v / (1 - b2 ** st.step)) + cfg.eps)
        self.sum, self.waiting = None, 0
        return rate

    def epoch(self, number: int) -> list[dict]:
        """One pass: a record per batch. Batches that wait for a step at the end of an epoch wait on."""
        return [{"epoch": number, **self.batch(b)} for b in self.order(number)]


# ------------------------------------------------------------------ runs

def score(df: DataFrame, state: TrainState, features: str = "features", keep_features: bool = False) -> DataFrame:
    """``df`` with ``logits``, ``probs``, ``pred`` and ``confidence`` of the trained weights; the vector column goes, but with
    ``keep_features``. A row without a vector has nulls."""
    bound_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(state.w)
    cfg = GradientConfig(state.w.shape[1] - 1, state.w.shape[0])
    keep = [c for c in df.columns if c not in ((() if keep_features else (features,)) + ("logits", "probs", "pred", "confidence"))]

    def run(batches):
        for b in pieces(batches):
            if not b.num_rows:
                continue
            vec = b.column(b.schema.get_field_index(features))
            some = np.flatnonzero(np.asarray(vec.is_valid()))
            logits = [None] * b.num_rows
            if len(some):
                part = pa.RecordBatch.from_arrays([vec.take(pa.array(some)), pa.array(np.zeros(len(some), np.int64)), pa.array([""] * len(some)),
                                                   pa.array(np.zeros(len(some), np.int32))], names=["features", "rid", "grp", "label"])
                rows = Rows(part, cfg)
                for k, z in zip(some, rows.logits(held.value, rows.val).tolist(), strict=True):
                    logits[k] = z
            cols = [b.column(b.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(logits, pa.list_(pa.float64()))], names=[*keep, "logits"])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
    from corpusflow.functions.arrays import argmax, softmax
    schema = StructType([df.schema[c] for c in keep] + [StructField("logits", ArrayType(DoubleType()))])
    out = df.select(*keep, *([] if keep_features else [features])).mapInArrow(run, schema).withColumn("probs", softmax("logits"))
    return out.withColumn("pred", argmax("probs")).withColumn("confidence", F.array_max("probs"))


def train_epochs(spark, path: str | dict[int, DataFrame], cfg: GradientConfig, epochs: int, val: DataFrame | None = None, state: TrainState | None = None,
                 first_epoch: int = 1, patience: int | None = None, metric: str = "val_f1"):
    """M1-M3: train ``epochs`` epochs on from ``state`` -> ({epoch: state after it}, history, steps).

    ``history`` (epoch, train_loss = mean of the batch losses, val_loss, val_acc, val_f1) has a row per epoch and ``steps`` a
    row per batch, as DataFrames. ``path`` is a folder of :func:`write_batches`, or the rows of
    each batch. ``val`` has ``features`` and ``label``. The run ends after ``patience`` epochs in a row that do
    not exceed the best ``metric`` (a loss: that are not below the lowest).
    """
    from corpusflow.functions.arrays import cross_entropy
    from corpusflow.operators.evaluate import prf
    trainer, states, history, steps, best, since = Trainer(spark, path, cfg, state), {}, [], [], None, 0
    for e in range(first_epoch, first_epoch + epochs):
        rows = trainer.epoch(e)
        steps += rows
        states[e] = trainer.state.copy()
        record = (e, float(np.mean([r["loss"] for r in rows])) if rows else None, None, None, None)
        if val is not None:
            scored = score(val, trainer.state).withColumn("_cf_ce", cross_entropy("logits", "label")).select("label", "pred", "_cf_ce").checkpoint()
            m, loss = prf(scored, "macro").first(), scored.agg(F.avg("_cf_ce")).first()[0]
            record = (*record[:2], loss, m["accuracy"], m["f1"])
        history.append(record)
        if val is not None and patience:
            now = dict(zip(("epoch", "train_loss", "val_loss", "val_acc", "val_f1"), record, strict=True))[metric]
            now = -now if metric.endswith("loss") else now
            best, since = (now, 0) if best is None or now > best else (best, since + 1)
            if since >= patience:
                break
    return (states, spark.createDataFrame(history, "epoch int, train_loss double, val_loss double, val_acc double, val_f1 double"),
            spark.createDataFrame([tuple(r[c] for c in ("epoch", "batch", "n", "loss", "grad_norm", "lr", "step")) for r in steps],
                                  "epoch int, batch int, n long, loss double, grad_norm double, lr double, step int"))
