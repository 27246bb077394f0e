"""Metrics, losses, history and ensembles on handmade rows (FIXTURES §4)."""

import math

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import evaluate as E
from corpusflow.operators import history as H
from corpusflow.operators import robust as L


def _pred(spark, pairs):
    return spark.createDataFrame(pairs, "label int, pred int")


def test_metrics_class_never_predicted(spark):
    m = E.prf(_pred(spark, [(0, 0), (1, 0), (1, 0), (0, 0)]), "macro").first()
    assert m.accuracy == 0.5 and m.precision == 0.25 and m.recall == 0.5
    assert abs(m.f1 - (2 * 0.5 / 1.5 + 0) / 2) < 1e-12


def test_metrics_predicted_class_never_true(spark):
    m = E.prf(_pred(spark, [(0, 0), (0, 1)]), "macro").first()
    assert m.precision == 0.5 and m.recall == 0.25  # classes {0, 1}; class 1 has no support
    w = E.prf(_pred(spark, [(0, 0), (0, 1)]), "weighted").first()
    assert w.recall == 0.5 and w.precision == 1.0


def test_macro_equals_weighted_with_equal_support(spark):
    d = _pred(spark, [(0, 0), (0, 1), (1, 1), (1, 1)])
    a, b = E.prf(d, "macro").first(), E.prf(d, "weighted").first()
    assert abs(a.recall - b.recall) < 1e-12


def test_auc_one_class_and_ties(spark):
    assert E.auc_hard(_pred(spark, [(1, 1), (1, 0)])).first().auc == 0.0
    assert E.auc_hard(_pred(spark, [(1, 1), (0, 0)])).first().auc == 1.0
    s = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert E.auc_score(s).first().auc == (1 + 0.5 + 1 + 1) / 4
    one = spark.createDataFrame([(1, 0.5)], "label int, score double")
    assert E.auc_score(one).first().auc == 0.0


def test_confusion_all_correct(spark):
    c = {r.label: (r.pred_0, r.pred_1) for r in E.confusion(_pred(spark, [(0, 0), (1, 1), (1, 1)])).collect()}
    assert c == {0: (1, 0), 1: (0, 2)}


def _scored(spark, rows):
    return spark.createDataFrame(rows, "id long, batch_id long, domain string, label int, logits array<double>")


def test_rdrop_equal_logits_is_ce(spark):
    df = _scored(spark, [(1, 0, "a", 1, [0.0, 2.0]), (2, 0, "b", 0, [1.0, -1.0])]).withColumn("logits2", F.col("logits"))
    ce = L.epoch_loss(L.row_cross_entropy(df)).first().epoch_loss
    rd = L.rdrop_loss(df).first().rdrop_loss
    assert abs(ce - rd) < 1e-12
    assert abs(ce - (math.log(1 + math.exp(-2.0)) + math.log(1 + math.exp(-2.0))) / 2) < 1e-12


def test_group_dro_one_group_is_mean(spark):
    df = L.row_cross_entropy(_scored(spark, [(1, 0, "a", 1, [0.0, 2.0]), (2, 0, "a", 0, [1.0, -1.0])]))
    mean = df.agg(F.avg("ce")).first()[0]
    assert abs(L.group_dro(df).first().dro_loss - mean) < 1e-12


def test_irm_edge_cases(spark):
    one = L.row_cross_entropy(_scored(spark, [(1, 0, "a", 1, [0.0, 2.0]), (2, 0, "a", 0, [1.0, -1.0])]))
    assert L.irm_penalty(one).first().irm_penalty == 0.0
    # two domains, one with a single row (skipped)
    two = L.row_cross_entropy(_scored(spark, [(1, 0, "a", 1, [0.0, 2.0]), (2, 0, "a", 0, [1.0, -1.0]),
                                             (3, 0, "b", 1, [0.0, 0.0])]))
    m = two.where(F.col("domain") == "a").agg(F.avg("ce")).first()[0]
    assert abs(L.irm_penalty(two).first().irm_penalty - 1e3 * m * m) < 1e-9


def test_mixup_lambda_one_is_identity(spark):
    df = spark.createDataFrame([(i, 0, [float(i), 1.0], i % 2) for i in range(6)],
                               "id long, batch_id long, features array<double>, label int")
    out = L.mixup_features(L.mixup_pairs(df, "id", lam=1.0)).collect()
    assert len(out) == 6 and all(r.mixed == r.features for r in out)
    assert sorted(r.partner_id for r in out) == list(range(6))


def test_beta_draw_alpha_zero(spark):
    df = spark.createDataFrame([(i, 0, i % 2) for i in range(4)], "id long, batch_id long, label int")
    out = L.mixup_pairs(df, "id", alpha=0.0).collect()
    assert all(r.lam == 1.0 for r in out)
    lams = {r.lam for r in L.mixup_pairs(df, "id", alpha=0.2).collect()}
    assert len(lams) == 1 and 0.0 <= lams.pop() <= 1.0  # one lambda per batch


def _hist(spark, f1s, run="r"):
    return spark.createDataFrame([(run, i + 1, float(v)) for i, v in enumerate(f1s)], "run_id string, epoch int, val_f1 double")


def test_best_epoch_and_checkpoints(spark):
    assert H.best_epoch(_hist(spark, [0, 0, 0])).first().best_epoch is None
    assert H.best_epoch(_hist(spark, [0.5, 0.7, 0.7, 0.6])).first().best_epoch == 2
    flags = [r.improved for r in H.checkpoint_flags(_hist(spark, [0.5, 0.7, 0.7, 0.6])).orderBy("epoch").collect()]
    assert flags == [True, True, False, False]


def test_early_stop(spark):
    assert H.early_stop(_hist(spark, [0.5, 0.4, 0.4, 0.4, 0.9])).first().stop_epoch == 4
    assert H.early_stop(_hist(spark, [0.5, 0.4, 0.4, 0.6, 0.5])).first().stop_epoch is None


def test_ensemble_summary(spark):
    per = spark.createDataFrame([("a", 0.8), ("b", 0.9), ("c", None)], "model string, accuracy double")
    r = H.ensemble_summary(per).collect()
    assert len(r) == 2 and abs(r[0].projected - 0.87) < 1e-12
    per2 = spark.createDataFrame([("a", 0.99)], "model string, accuracy double")
    assert H.ensemble_summary(per2).first().projected == 0.95


def test_mixup_mask_is_the_union(spark):
    d = spark.createDataFrame([(1, [1, 1, 0], [1, 0, 0, 0]), (2, [1], None)], "id int, attention_mask array<int>, attention_mask_b array<int>")
    assert [r.mixed_mask for r in L.mixup_mask(d).orderBy("id").collect()] == [[1, 1, 0, 0], [1]]


def test_training_rounds_stop_early(spark):
    from corpusflow.operators.train import TrainConfig, evaluate, train_rounds
    d = spark.createDataFrame([(f"good word{i % 7}" if i % 2 else f"bad word{i % 5}", i % 2) for i in range(60)], "text string, label int")
    models, hist = train_rounds(d, d, [5, 10, 15, 20], TrainConfig(num_features=1 << 8), patience=1)
    h = hist.orderBy("epoch").collect()
    # the first round is perfect, the second is not better: the loop ends
    assert [r.epoch for r in h] == [1, 2] and h[0].val_f1 == 1.0 and h[0].val_loss == pytest.approx(h[0].train_loss)
    assert {r.model_epoch for r in evaluate(models, hist, d).select("model_epoch").collect()} == {1}


def test_group_weights_follow_losses(spark):
    from corpusflow.operators.train import TrainConfig, train_group_dro
    rows = [(f"good w{i}" if i % 2 else f"bad w{i}", i % 2, "easy") for i in range(40)] + [(f"same w{i}", i % 2, "hard") for i in range(40)]
    _, w, hist = train_group_dro(spark.createDataFrame(rows, "text string, label int, domain string"), rounds=2, eta=0.5,
                                 cfg=TrainConfig(num_features=1 << 8, max_iter=10))
    q = {r.domain: r.q for r in w.collect()}
    assert q["hard"] > q["easy"] and sum(q.values()) == pytest.approx(1.0)
    assert hist.count() == 4


def test_domain_probe_gives_each_domain_a_class(spark):
    from corpusflow.operators.train import TrainConfig, domain_probe
    # src2/src12, src5/src11 and src13/src18 share an md5 bucket of 64
    rows = [(f"src{k}", f"own{k} words{k} of{k}") for k in (2, 5, 11, 12, 13, 18) for _ in range(6)] + [(None, "x")]
    d = spark.createDataFrame(rows, "domain string, text string")
    cfg = TrainConfig(num_features=1 << 10, max_iter=20)
    got = domain_probe(d, "domain", cfg).first()
    assert (got.n_domains, got.n_classes, got.accuracy) == (6, 6, 1.0)
    few = domain_probe(d, "domain", cfg, buckets=4).first()
    assert few.n_domains == 6 and few.n_classes == len({r[0] for r in d.where("domain is not null").select(L.domain_bucket("domain", 4)).collect()})
    assert domain_probe(d.where("domain = 'src2'"), "domain", cfg).first().n_classes == 1
