"""Mini-batch training: losses, gradients, weights and group weights per step, recomputed by dense numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from corpusflow.operators import gradient as G


@pytest.fixture(scope="module")
def table(spark):
    """60 rows, 6 features (two rows sparse), 3 classes, 4 groups."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 6)).round(3)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.7)
    x[:10, 3:] = 0
    rows = [(k, Vectors.sparse(6, {j: float(v) for j, v in enumerate(r) if v}) if k < 10 else Vectors.dense(r.tolist()), int(y[k]), f"g{k % 4 if k % 7 else 0}")
            for k, r in enumerate(x)]
    return spark.createDataFrame(rows, ["id", "features", "label", "domain"]), x, y, [r[3] for r in rows]


def batches(spark, path):
    """{batch: sorted ids} of what was written, by the row's hash."""
    got = {}
    for r in spark.read.parquet(path).collect():
        got.setdefault(r["batch"], []).append(r["rid"])
    return got


def soft(z):
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def objective(w, x, y, grp, cfg, weight=None):
    """The loss of a batch as a function of the weights, by its definition."""
    z = np.c_[x, np.ones(len(x))] @ w.T
    p = soft(z)
    ce = -np.log(p[np.arange(len(y)), y])
    if cfg.objective == "ce":
        return ce.mean()
    names = sorted(set(grp))
    mask = {g: np.array([h == g for h in grp]) for g in names}
    if cfg.objective == "group_dro":
        return sum(weight[g] * ce[mask[g]].sum() for g in names) / len(y)
    one = np.eye(cfg.n_classes)[y]
    pen = []
    for g in names:
        if mask[g].sum() >= 2:
            pen.append(ce[mask[g]].mean() ** 2 if cfg.irm_mode == "reference" else ((p - one) * z).sum(1)[mask[g]].mean() ** 2)
    return ce.mean() + cfg.irm_weight * np.mean(pen) if len(names) >= 2 and pen else ce.mean()


def numeric(f, w, h=1e-6):
    g = np.zeros_like(w)
    for i in np.ndindex(w.shape):
        a, b = w.copy(), w.copy()
        a[i] += h
        b[i] -= h
        g[i] = (f(a) - f(b)) / (2 * h)
    return g


@pytest.mark.parametrize("cfg", [
    G.GradientConfig(6, 3, lr=0.1, weight_decay=0.05, clip=0.5, warmup=2, total_steps=9),
    G.GradientConfig(6, 3, objective="group_dro", lr=0.1, eta=0.5, clip=0), G.GradientConfig(6, 3, objective="group_dro", cumulative=False, eta=2.0),
    G.GradientConfig(6, 3, objective="irm", irm_weight=2.0, clip=0), G.GradientConfig(6, 3, objective="irm", irm_weight=5.0, irm_mode="paper", clip=0),
    G.GradientConfig(6, 3, accumulate=2, lr=0.3)])
def test_steps_equal_numpy(spark, table, cfg):
    df, x, y, grp = table
    path = G.write_batches(df, 4, "id", group="domain", pieces=2)
    rid = {r["rid"]: r["id"] for r in df.select("id", F.xxhash64("id").alias("rid")).collect()}
    held = {b: [rid[i] for i in ids] for b, ids in batches(spark, path).items()}
    assert sorted(i for ids in held.values() for i in ids) == list(range(60))
    trainer = G.Trainer(spark, path, cfg)
    w = m = v = np.zeros((3, 7))
    q, wait, step = {}, [], 0
    for row in trainer.epoch(1) + trainer.epoch(2):
        at = held[row["batch"]]
        bx, by, bg = x[at], y[at], [grp[k] for k in at]
        weight = None
        if cfg.objective == "group_dro":
            ce = -np.log(soft(np.c_[bx, np.ones(len(at))] @ w.T)[np.arange(len(at)), by])
            up = {g: np.exp(cfg.eta * np.mean([ce[k] for k in range(len(at)) if bg[k] == g])) for g in set(bg)}
            if cfg.cumulative:
                q = {g: q.get(g, 1.0) * up.get(g, 1.0) for g in {*q, *up}}
                q = {g: a / sum(q.values()) for g, a in q.items()}
                weight = {g: q[g] / sum(q[h] for h in up) for g in up}
            else:
                weight = {g: a / sum(up.values()) for g, a in up.items()}

        def f(u):
            return objective(u, bx, by, bg, cfg, weight)
        g = numeric(f, w)
        assert row["n"] == len(at) and abs(row["loss"] - f(w)) < 1e-9 and abs(row["grad_norm"] - np.sqrt((g ** 2).sum())) < 1e-4 * max(1, row["grad_norm"])
        wait.append(g)
        if len(wait) == cfg.accumulate:
            g, wait = sum(wait) / cfg.accumulate, []
            norm = np.sqrt((g ** 2).sum())
            g = g * min(1, cfg.clip / (norm + 1e-6)) if cfg.clip else g
            rate = cfg.lr * step / cfg.warmup if step < cfg.warmup else cfg.lr * (9 - step) / 7 if cfg.total_steps else cfg.lr
            assert abs(row["lr"] - rate) < 1e-12
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w * np.array([1 - rate * cfg.weight_decay] * 6 + [1.0]) - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    assert step == trainer.state.step > 0 and np.allclose(trainer.state.w, w, atol=2e-3) and (not q or all(abs(trainer.state.q[g] - a) < 1e-6 for g, a in q.items()))


def test_gradient_of_rdrop(spark, table):
    df, x, y, _ = table
    cfg = G.GradientConfig(6, 3, objective="rdrop", dropout=0.3, alpha=1.5)
    path = G.write_batches(df, 1, "id")
    trainer = G.Trainer(spark, path, cfg)
    trainer.state.w = np.random.default_rng(2).normal(size=(3, 7))
    grad, loss, n = trainer.gradient(0)
    rid = [r["rid"] for r in df.orderBy("id").select(F.xxhash64("id").alias("rid")).collect()]

    def mask(salt):
        """The dropout of the definition, a number at a time."""
        out, top = np.zeros((60, 7)), (1 << 64) - 1
        for k in range(60):
            for j in range(6):
                h = (rid[k] + j * 0x9E3779B97F4A7C15 + salt * 0xBF58476D1CE4E5B9) & top
                h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & top
                h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & top
                out[k, j] = (((h ^ (h >> 31)) >> 11) / (1 << 53) >= 0.3) / 0.7
            out[k, 6] = 1
        return out
    xb = np.c_[x, np.ones(60)]
    x1, x2 = xb * mask(42), xb * mask(43)
    assert 0.15 < 1 - (mask(42)[:, :6] > 0).mean() < 0.45 and (mask(42) != mask(43)).any()

    def f(w):
        p1, p2 = soft(x1 @ w.T), soft(x2 @ w.T)
        ce = -(np.log(p1[np.arange(60), y]) + np.log(p2[np.arange(60), y])) / 2
        return (ce + 1.5 * (p2 * np.log(p2 / p1)).sum(1)).sum()
    assert n == 60 and abs(loss - f(trainer.state.w)) < 1e-9 and np.allclose(grad, numeric(f, trainer.state.w), atol=1e-5)


def test_rounds_go_on_from_the_former_model(spark, table):
    df = table[0]
    path = G.write_batches(df, 3, "id", group="domain")
    cfg = G.GradientConfig(6, 3, objective="group_dro", lr=0.2)
    whole, hist, steps = G.train_epochs(spark, path, cfg, 4, df)
    first, _, _ = G.train_epochs(spark, path, cfg, 2, df)
    then, _, _ = G.train_epochs(spark, path, cfg, 2, df, first[2], first_epoch=3)
    assert np.allclose(whole[4].w, then[4].w, atol=1e-12) and whole[4].step == then[4].step == 12 and np.allclose(list(whole[4].q.values()), list(then[4].q.values()))
    assert not np.allclose(first[2].w, whole[4].w)
    h = {r["epoch"]: r for r in hist.collect()}
    per = steps.groupBy("epoch").agg(F.avg("loss").alias("l")).collect()
    assert all(abs(h[r["epoch"]]["train_loss"] - r["l"]) < 1e-12 for r in per) and h[4]["train_loss"] < h[1]["train_loss"] and h[4]["val_acc"] > 0.8
    order = {e: [r["batch"] for r in steps.where(f"epoch = {e}").collect()] for e in h}
    assert all(sorted(o) == [0, 1, 2] for o in order.values()) and len({tuple(o) for o in order.values()}) > 1


def test_scores_and_odd_rows(spark, table):
    df = table[0]
    odd = df.unionByName(spark.createDataFrame([(None, Vectors.dense([0.0] * 6), 1, "g1"), (70, None, 1, "g1"), (71, Vectors.dense([1.0] * 6), None, None),
                                                (72, Vectors.dense([1.0] * 6), 2, None)], df.schema))
    path = G.write_batches(odd, 2, "id", group="domain")
    assert spark.read.parquet(path).count() == 61 and spark.read.parquet(path).where("grp = ''").count() == 1
    states, hist, _ = G.train_epochs(spark, path, G.GradientConfig(6, 3, lr=0.2), 9, df, patience=2, metric="val_loss")
    out = {r["id"]: r for r in G.score(odd.where("id is not null"), states[max(states)]).collect()}
    w = states[max(states)].w
    x = np.array(table[1][20])
    assert np.allclose(out[20]["logits"], w[:, :6] @ x + w[:, 6]) and out[20]["pred"] == int(np.argmax(out[20]["probs"])) and abs(sum(out[20]["probs"]) - 1) < 1e-12
    assert out[70]["logits"] is None and out[70]["pred"] is None and len(out) == 63
    empty = G.write_batches(df.limit(0), 2, "id")
    with pytest.raises(Exception):      # noqa: B017 - no schema can be read from an empty folder
        G.Trainer(spark, empty, G.GradientConfig(6, 3)).epoch(1)
    with pytest.raises(ValueError):
        G.Trainer(spark, path, G.GradientConfig(6, 3, objective="other"))


def test_mixup_pairs_train_with_two_labels(spark):
    from corpusflow.operators.robust import mixup_features, mixup_pairs
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    rows = [(k, x[k].tolist(), int(x[k, 0] > 0), k // 10) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int, batch_id long")
    pairs = mixup_features(mixup_pairs(df, "id", alpha=0.4), out="mixed").withColumn("vec", array_to_vector("mixed")).checkpoint()
    path = G.write_batches(pairs, 1, "id", features="vec")
    t = G.Trainer(spark, path, G.GradientConfig(4, 2))
    t.state.w = rng.normal(size=(2, 5))
    _, loss, n = t.gradient(0)
    want = 0.0
    for r in pairs.collect():
        lp = np.log(soft((t.state.w[:, :4] @ np.array(r["mixed"]) + t.state.w[:, 4])[None]))[0]
        want -= r["lam"] * lp[r["label"]] + (1 - r["lam"]) * lp[r["label_b"]]
    assert n == 40 and abs(loss - want) < 1e-9
