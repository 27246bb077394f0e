"""Domain-invariant features: the part of a vector that tells its domain is taken out.

After the map found here, features and domains have no covariance, so no linear classifier of the domain
does better than the shares of the domains, while the features move as little as that allows (in the least-squares
sense, measured by their own covariance). One pass gathers moments; the map is a matrix of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

MAX_DOMAINS = 10_000


@dataclass
class Eraser:
    """x -> x - remove @ (x - mean)."""
    mean: np.ndarray
    remove: np.ndarray
    n: int


def _as_array(df: DataFrame, features: str):
    plain = df.schema[features].dataType.typeName() == "array"
    return (F.col(features) if plain else F.when(F.col(features).isNotNull(), vector_to_array(features))).cast("array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def moments(df: DataFrame, features: str, domain: str, width: int):
    """(n, sum of x, sum of x x', {domain: (rows, sum of x)}) over rows with both, each task adding up its own rows."""
    def run(batches):
        square, sums = np.zeros((width, width)), {}
        for b in batches:
            if not b.num_rows:
                continue
            x, names = _matrix(b.column(0), width), np.array(b.column(1).to_pylist(), object)
            square += x.T @ x
            for d in set(names):
                some = names == d
                s = sums.setdefault(d, [0, np.zeros(width)])
                s[0] += int(some.sum())
                s[1] += x[some].sum(0)
        at = np.flatnonzero(square.ravel())
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(at), pa.string()), pa.array(at), pa.array(square.ravel()[at])], names=["d", "i", "x"])
        for d, (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * (width + 1), pa.string()), pa.array(np.arange(-1, width)), pa.array(np.append(n, s))], names=["d", "i", "x"])

    rows = (df.select(_as_array(df, features).alias("x"), F.col(domain).cast("string").alias("d"))
            .where(f"x is not null and d is not null and size(x) = {width}"))
    summed = rows.mapInArrow(run, "d string, i long, x double").groupBy("d", "i").agg(F.sum("x").alias("x")).checkpoint()
    names = sorted(r["d"] for r in summed.where("d is not null and i = -1").select("d").limit(MAX_DOMAINS + 1).collect())
    if len(names) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains: deal them to buckets with domain_bucket first")
    got = summed.toPandas()                                  # width * (width + domains) numbers
    square, of = np.zeros(width * width), {d: np.zeros(width + 1) for d in names}
    for d, i, x in zip(got["d"], got["i"], got["x"], strict=True):
        if d is None or d != d:
            square[i] = x
        else:
            of[d][i + 1] = x
    by = {d: (int(v[0]), v[1:]) for d, v in of.items()}
    return sum(n for n, _ in by.values()), sum((s for _, s in by.values()), np.zeros(width)), square.reshape(width, width), by


def fit_eraser(df: DataFrame, features: str = "features", domain: str = "domain", width: int | None = None) -> Eraser:
    """The map that takes the domain out of ``features`` (a vector or an array of numbers, all of ``width``, by default that
    of the first row). Rows without features or domain, or of another width, take no part; one domain or none: nothing is taken out.

    With the covariance S of the features and their cross covariance C with the domains' indicators, the removed part is
    S^(1/2) P S^(-1/2) (x - mean), where P projects on the columns of S^(-1/2) C.
    """
    if width is None:
        first = df.select(F.size(_as_array(df, features)).alias("n")).where("n > 0").first()
        width = first["n"] if first else 0
    n, total, square, by = moments(df, features, domain, width)
    mean = total / max(1, n)
    if len(by) < 2:
        return Eraser(mean, np.zeros((width, width)), n)
    cov = square / n - np.outer(mean, mean)
    cross = np.stack([s / n - mean * (k / n) for k, s in by.values()], 1)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    some = values > max(values.max(), 0) * 1e-10
    root, inverse = (vectors[:, some] * values[some] ** p @ vectors[:, some].T for p in (0.5, -0.5))
    u, s, _ = np.linalg.svd(inverse @ cross, full_matrices=False)
    u = u[:, s > (s.max() if len(s) else 0) * 1e-9]
    return Eraser(mean, root @ (u @ u.T) @ inverse, n)


def erase(df: DataFrame, eraser: Eraser, features: str = "features", out: str | None = None) -> DataFrame:
    """``df`` with ``out`` (default: in place of ``features``), the array without what tells the domain. Null or of
    another width: null. No shuffle; the matrix is broadcast."""
    out, width = out or features, len(eraser.mean)
    held = df.sparkSession.sparkContext.broadcast(eraser)
    keep = [c for c in df.columns if c != out]
    src = "_cf_x"

    def run(batches):
        e = held.value
        for b in batches:
            vec = b.column(b.schema.get_field_index(src))
            lists = [None] * b.num_rows
            ok = np.flatnonzero(np.asarray(pc.equal(pc.list_value_length(vec), width).fill_null(False)))
            if len(ok):
                x = _matrix(vec.take(pa.array(ok)), width)
                for k, v in zip(ok, x - (x - e.mean) @ e.remove.T, strict=True):
                    lists[k] = v
            cols = [b.column(b.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lists, pa.list_(pa.float64()))], names=[*keep, out])

    schema = StructType([df.schema[c] for c in keep] + [StructField(out, ArrayType(DoubleType()))])
    return df.withColumn(src, _as_array(df, features)).select(*keep, src).mapInArrow(run, schema)


def erasure_report(train: DataFrame, features: str = "features", domain: str = "domain", label: str = "label",
                   max_iter: int = 100) -> DataFrame:
    """(stage, n, n_domains, majority, probe_accuracy, probe_log_loss, label_accuracy) before and after the map: how well a
    linear probe tells the domain, against the share of the largest, and what is left to tell the label."""
    from pyspark.ml.functions import array_to_vector
    from corpusflow.operators.train import TrainConfig, domain_probe, score_model, train_text_classifier
    df = train.where(F.col(domain).isNotNull() & F.col(label).isNotNull()).checkpoint()
    eraser, rows = fit_eraser(df, features, domain), []
    share = df.groupBy(domain).count().agg((F.max("count") / F.sum("count")).alias("m")).first()["m"]
    for stage, part in (("before", df.withColumn("_cf_a", _as_array(df, features))), ("after", erase(df, eraser, features, "_cf_a"))):
        part = part.select(F.col(domain).alias("domain"), F.col(label).alias("label"), array_to_vector("_cf_a").alias("features")).checkpoint()
        probe = domain_probe(part, "domain", TrainConfig(max_iter=max_iter, reg_param=0.0, features="vector")).first()
        fitted = train_text_classifier(part, TrainConfig(max_iter=max_iter, reg_param=1e-4, features="vector"))
        right = score_model(fitted, part).agg(F.avg((F.col("pred") == F.col("label").cast("int")).cast("double"))).first()[0]
        rows.append((stage, eraser.n, probe["n_domains"], share, probe["accuracy"], probe["log_loss"], right))
    return train.sparkSession.createDataFrame(rows, "stage string, n long, n_domains long, majority double, probe_accuracy double, probe_log_loss double, label_accuracy double")
