"""Registered gradient training, domain erasure and self-training.

Fits have no SQL oracle: their steps are recomputed by numpy in the tests.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from corpusflow.operators import gradient as G
from corpusflow.operators.features import text_features
from corpusflow.operators.invariant import erasure_report
from corpusflow.operators.selftrain import self_train
from corpusflow.plans.fixtures import table
from corpusflow.plans.q_train import labelled_split
from corpusflow.plans.registry import query

WIDTH = 1 << 12


def text_vectors(df, width: int = WIDTH, fit_on=None):
    """TF-IDF vectors of ``text`` (weights learnt from ``fit_on``), scaled to length one."""
    from pyspark.ml.feature import Normalizer
    stages = [*text_features(width)[:2], text_features(width)[2].setOutputCol("_cf_idf"), Normalizer(inputCol="_cf_idf", outputCol="features")]
    model = Pipeline(stages=stages).fit(df if fit_on is None else fit_on)
    return model.transform(df).drop("_cf_words", "_cf_tf", "_cf_idf")


def _vectors(spark, sf, parts=(("train", 0.7), ("val", 0.1), ("test", 0.2)), width=WIDTH):
    s = labelled_split(spark, sf, parts)
    return text_vectors(s, width, s.where("split = 'train'")).checkpoint()


def _steps(spark, sf, epochs=2, n_batches=4, **settings):
    """Per-batch records of a run on the training rows, group by source."""
    v = _vectors(spark, sf)
    path = G.write_batches(v.where("split = 'train'"), n_batches, "row_idx", group="domain")
    cfg = G.GradientConfig(WIDTH, lr=0.1, warmup=2, total_steps=epochs * n_batches, **settings)
    states, history, steps = G.train_epochs(spark, path, cfg, epochs, v.where("split = 'val'"))
    return v, states, history, steps


@query("train_minibatch")
def q_train_minibatch(spark, sf):
    """M1, M5, H1: epochs of AdamW steps with warm-up, clipping and weight decay, each going on from the last; the test rows are
    scored by the epoch of the best validation F1."""
    v, states, history, _ = _steps(spark, sf, epochs=3)
    best = history.orderBy(F.desc("val_f1"), "epoch").first()["epoch"]
    out = G.score(v.where("split = 'test'"), states[best])
    return out.select("row_idx", "label", "pred", F.round("confidence", 9).alias("confidence"), F.lit(best).alias("model_epoch"))


@query("train_minibatch_dro")
def q_train_minibatch_dro(spark, sf):
    """Group weights move with every batch."""
    return _steps(spark, sf, objective="group_dro", eta=0.1)[3]


@query("train_minibatch_irm")
def q_train_minibatch_irm(spark, sf):
    """L7 as an objective: cross entropy plus the invariance penalty over sources."""
    return _steps(spark, sf, objective="irm", irm_weight=1.0, irm_mode="paper")[3]


@query("train_minibatch_rdrop")
def q_train_minibatch_rdrop(spark, sf):
    """L3 as an objective: two passes under dropout, their cross entropies and their divergence."""
    return _steps(spark, sf, objective="rdrop", alpha=2.0)[3]


@query("domain_erasure")
def q_domain_erasure(spark, sf):
    """The language is taken out of text vectors; a probe and the label's classifier before and after."""
    s = labelled_split(spark, sf)
    return erasure_report(text_vectors(s, 1 << 7).withColumn("domain", F.col("language")))


@query("self_training")
def q_self_training(spark, sf):
    """M6 on the language of documents: one in twenty is labelled, a fifth is held out, the rest is learnt from round by round."""
    docs = table(spark, sf, "documents").where("text is not null").select(
        "doc_id", "text", (F.array_position(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.col("lang")) - 1).cast("int").alias("label"))
    v = text_vectors(docs).where("label >= 0").select("doc_id", "features", "label").checkpoint()
    part = F.pmod(F.col("doc_id"), F.lit(20))
    cfg = G.GradientConfig(WIDTH, 4, lr=0.1)
    _, _, history = self_train(v.where(part == 0), v.where(part >= 5).drop("label"), v.where((part > 0) & (part < 5)), cfg, "doc_id",
                               rounds=6, threshold=0.8)
    return history
