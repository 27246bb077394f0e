"""Domain erasure and self-training on small tables."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from corpusflow.operators import gradient as G
from corpusflow.operators.invariant import erase, erasure_report, fit_eraser
from corpusflow.operators.selftrain import self_train


@pytest.fixture(scope="module")
def shifted(spark):
    """Three domains, shifted along two directions; the label lies along a third."""
    rng = np.random.default_rng(3)
    n = 600
    dom, lab = rng.choice(3, n, p=[0.5, 0.3, 0.2]), rng.integers(0, 2, n)
    x = rng.normal(size=(n, 8)) @ rng.normal(size=(8, 8))
    x += np.array([[0, 0], [3, -2], [-2, 4]])[dom] @ rng.normal(size=(2, 8))
    x += (4 * lab - 2)[:, None] * rng.normal(size=8)
    rows = [(k, v.tolist(), f"d{d}", int(y)) for k, (v, d, y) in enumerate(zip(x, dom, lab, strict=True))]
    return spark.createDataFrame(rows, "id long, features array<double>, domain string, label int").repartition(5), x, dom, lab


def test_no_covariance_is_left(spark, shifted):
    df, x, dom, _ = shifted
    e = fit_eraser(df)
    rows = {r["id"]: r["features"] for r in erase(df, e).collect()}
    after = np.array([rows[k] for k in range(len(x))])
    one = np.eye(3)[dom]
    assert e.n == len(x) and np.allclose(e.mean, x.mean(0))
    assert np.abs((after - after.mean(0)).T @ (one - one.mean(0)) / len(x)).max() < 1e-9
    assert np.abs((x - x.mean(0)).T @ (one - one.mean(0)) / len(x)).max() > 0.3
    assert np.linalg.matrix_rank(e.remove, tol=1e-6) == 2 and np.allclose(e.remove @ e.remove, e.remove)      # a projection of rank domains - 1
    means = np.array([after[dom == d].mean(0) for d in range(3)])
    assert np.allclose(means, means[0], atol=1e-9)


def test_probe_falls_to_the_majority(shifted):
    r = {x["stage"]: x for x in erasure_report(shifted[0]).collect()}
    assert r["before"]["probe_accuracy"] > r["before"]["majority"] + 0.1
    assert r["after"]["probe_accuracy"] <= r["after"]["majority"] + 0.01 and r["after"]["label_accuracy"] > 0.8
    shares = np.bincount(shifted[2]) / len(shifted[2])
    assert abs(r["after"]["probe_log_loss"] + (shares * np.log(shares)).sum()) < 1e-3                            # the entropy of the domains
    assert r["after"]["n"] == 600 and r["after"]["n_domains"] == 3


def test_eraser_of_odd_rows(spark):
    rows = [(1, Vectors.dense([1.0, 2.0]), "a"), (2, None, "a"), (3, Vectors.dense([3.0, 1.0]), None), (4, Vectors.sparse(2, {0: 2.0}), "b"), (5, Vectors.dense([1.0]), "b")]
    df = spark.createDataFrame(rows, ["id", "features", "domain"])
    e = fit_eraser(df)
    got = {r["id"]: r["features"] for r in erase(df, e).collect()}
    assert e.n == 2 and got[2] is None and got[5] is None and np.allclose(got[1], got[4])
    one = df.where("domain = 'a'")
    assert not fit_eraser(one).remove.any() and erase(one, fit_eraser(one)).where("id = 1").first()["features"] == [1.0, 2.0]
    none = df.limit(0)
    assert fit_eraser(none).n == 0 and erase(none, fit_eraser(none)).count() == 0


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 260)
    x = rng.normal(size=(260, 3)) + (4 * y - 2)[:, None]
    df = spark.createDataFrame([(k, Vectors.dense(v.tolist()), int(c)) for k, (v, c) in enumerate(zip(x, y, strict=True))], ["id", "features", "label"])
    return df.where("id < 20"), df.where("id >= 20 and id < 220"), df.where("id >= 220"), y


def test_self_training_reaches_a_fixpoint(spark, blobs):
    gold, rest, held, y = blobs
    again = rest.unionByName(rest.limit(5)).unionByName(gold.limit(3))          # repeated ids, and ids that are gold
    state, accepted, hist = self_train(gold, again.drop("label"), held, G.GradientConfig(3, lr=0.2), "id", rounds=12, epochs=2, threshold=0.8)
    h = [r.asDict() for r in hist.orderBy("round").collect()]
    assert h[0]["n_pseudo"] == 0 and all(a["n_pseudo"] + a["n_added"] - a["n_left"] == b["n_pseudo"] for a, b in zip(h, h[1:], strict=False))
    assert (h[-1]["n_added"], h[-1]["n_changed"], h[-1]["n_left"]) == (0, 0, 0) or not h[-1]["kept"] or len(h) == 12
    assert max(r["n_pseudo"] for r in h) > 100 and max(r["f1"] for r in h) > 0.9 and all(r["n_pseudo"] <= 200 for r in h)
    rows = accepted.collect()
    assert len({r["id"] for r in rows}) == len(rows) and all(20 <= r["id"] < 220 for r in rows) and np.mean([y[r["id"]] == r["label"] for r in rows] or [1]) > 0.9


def test_self_training_stops_when_nothing_is_added(blobs):
    gold, rest, held, _ = blobs
    _, accepted, hist = self_train(gold, rest, held, G.GradientConfig(3, lr=0.01), "id", rounds=5, epochs=1, threshold=1.1)
    assert hist.count() == 1 and accepted.count() == 0 and hist.first()["n_added"] == 0


def test_held_out_guard_discards_a_worse_round(blobs):
    gold, rest, held, _ = blobs
    _, accepted, hist = self_train(gold, rest, held, G.GradientConfig(3, lr=0.2), "id", rounds=4, epochs=1, threshold=0.5, tolerance=-1.0)
    h = hist.orderBy("round").collect()         # a tolerance that no round meets
    assert [r["kept"] for r in h] == [True, False] and accepted.count() == 0
