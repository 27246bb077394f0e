"""Registered Spark ML jobs plus the run report (K4).

Model fits have no SQL oracle: the driver records a rows-only check for them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import curate as C
from corpusflow.operators import evaluate as E
from corpusflow.operators import history as H
from corpusflow.operators.features import array_features
from corpusflow.operators.split import assign_batches, stratified_split
from corpusflow.operators.train import (TrainConfig, domain_probe, load_model, save_model, score_model,
                                        train_ensemble, train_group_dro, train_mixup, train_text_classifier)
from corpusflow.plans.fixtures import CORPUS_SQL, labelled_docs, table
from corpusflow.plans.q_corpus import _sql_clean_b
from corpusflow.plans.registry import query, with_ctes
from corpusflow.session import scratch_path

CFG = TrainConfig(num_features=1 << 16, max_iter=30, reg_param=0.01)


_FIRST_B_SQL = f"""
firstb AS (
  SELECT text, label, row_idx FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY row_idx) AS rn FROM (
      SELECT {_sql_clean_b('text')} AS text, label, row_idx FROM corpus WHERE dataset_rank = 0) WHERE length(text) > 10)
  WHERE rn = 1
)"""


def labelled_split(spark, sf, parts=(("train", 0.8), ("val", 0.2))):
    """Labelled documents (rank 0), cleaner B, > 10 chars, keep-first dedupe, 80/20 by label."""
    # the first source wins each duplicate, so the others need not be read
    first = C.min_length(C.clean(labelled_docs(spark, sf), "b"), 10)
    # read by every fit and score of a flow: written once to the shared folder, nothing stays cached
    return stratified_split(C.dedupe_first(first, narrow=True).checkpoint(), ["label"], list(parts), seed=42).checkpoint()


def _fit(spark, sf, cfg=CFG):
    s = labelled_split(spark, sf)
    model = train_text_classifier(s.where(F.col("split") == "train"), cfg)
    return s, model


@query("train_text_lr")
def q_train_text_lr(spark, sf):
    s, model = _fit(spark, sf)
    return score_model(model, s.where(F.col("split") == "val")).select("row_idx", "label", "pred", "confidence")


@query("score_model")
def q_score_model(spark, sf):
    s, model = _fit(spark, sf)
    out = score_model(model, s)
    return out.select("row_idx", "split", "label", "pred", "confidence",
                      F.element_at("probs", 1).alias("p0"), F.element_at("probs", 2).alias("p1"))


@query("evaluate_model")
def q_evaluate_model(spark, sf):
    s, model = _fit(spark, sf)
    val = score_model(model, s.where(F.col("split") == "val"))
    val = assign_batches(val, 16, order="row_idx").withColumn(
        "ce", -F.log(F.greatest(F.element_at("probs", F.col("label") + 1), F.lit(1e-15))))
    return E.evaluate_table(val)


@query("model_roundtrip", with_ctes(CORPUS_SQL, _FIRST_B_SQL) + "SELECT row_idx, true AS same FROM firstb")
def q_model_roundtrip(spark, sf):
    s, model = _fit(spark, sf)
    path = scratch_path(spark, "model")
    save_model(model, path)
    again = load_model(path)
    a = score_model(model, s).select("row_idx", F.col("pred").alias("pred_saved"))
    b = score_model(again, s).select("row_idx", F.col("pred").alias("pred_loaded"))
    return a.join(b, "row_idx").select("row_idx", (F.col("pred_saved") == F.col("pred_loaded")).alias("same"))


@query("train_group_dro")
def q_train_group_dro(spark, sf):
    s = labelled_split(spark, sf)
    _, weights, hist = train_group_dro(s.where(F.col("split") == "train"), rounds=3, eta=0.01, cfg=CFG)
    return hist.join(weights, "domain").select("round", "domain", "loss", F.col("q").alias("final_weight"))


def _embedding_batches(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features_arr"), "label")
    return assign_batches(emb, 16, order="vec_id", seed=42, epoch=0).drop("epoch", "position")


@query("train_mixup")
def q_train_mixup(spark, sf):
    """M3: mixup pairs inside batches, two weighted rows per pair, LR on the blend."""
    b = _embedding_batches(spark, sf)
    model = train_mixup(b, "vec_id", seed=42, alpha=0.2)
    test = array_features(b, "features_arr")
    return model.transform(test).select("vec_id", "label", F.col("prediction").cast("int").alias("pred"))


@query("domain_probe")
def q_domain_probe(spark, sf):
    s = labelled_split(spark, sf).where(F.col("split") == "train")
    return domain_probe(s, "domain", TrainConfig(num_features=1 << 14, max_iter=20))


@query("train_ensemble")
def q_train_ensemble(spark, sf):
    s = labelled_split(spark, sf)
    train, val = s.where(F.col("split") == "train"), s.where(F.col("split") == "val")
    cfgs = [TrainConfig(num_features=1 << 12, reg_param=0.1, max_iter=20, name="small"),
            TrainConfig(num_features=1 << 16, reg_param=0.01, max_iter=20, name="base"),
            TrainConfig(num_features=1 << 18, reg_param=0.001, max_iter=20, name="wide")]
    models, _report = train_ensemble(train, cfgs)
    per = None
    for name, m in models.items():
        acc = score_model(m, val).agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))
        acc = acc.select(F.lit(name).alias("model"), "accuracy")
        per = acc if per is None else per.unionByName(acc)
    return H.ensemble_summary(per)




@query("evaluate_best_epoch")
def q_evaluate_best_epoch(spark, sf):
    """M1, M5, H1: rounds of more L-BFGS iterations each, validated after each round with early
    stopping, then the test rows scored by the best round's model."""
    from corpusflow.operators.train import evaluate, train_rounds
    s = labelled_split(spark, sf, (("train", 0.7), ("val", 0.1), ("test", 0.2)))
    train, val, test = (s.where(F.col("split") == x) for x in ("train", "val", "test"))
    models, hist = train_rounds(train, val, [2, 5, 15], TrainConfig(num_features=1 << 14, reg_param=0.01), patience=2)
    return evaluate(models, hist, test, use="best").select("row_idx", "label", "pred", "confidence", "model_epoch")
