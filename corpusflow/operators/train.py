"""Training and scoring with Spark ML.

The transformer fine-tune is re-aimed as distributed logistic regression (L-BFGS, one
tree-aggregate per iteration) over TF-IDF or ready-made embedding features.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.arrays import argmax
from corpusflow.operators.features import text_features
from corpusflow.session import broadcast_checked, ensure_checkpoint_dir


@dataclass
class TrainConfig:
    num_features: int = 1 << 16
    max_iter: int = 50
    reg_param: float = 0.01
    elastic_net: float = 0.0
    weight_col: str | None = None
    features: str = "text"       # "text" (TF-IDF) or "vector" (ready-made `features`)
    name: str = "lr"


def _pipeline(cfg: TrainConfig, label: str = "label") -> Pipeline:
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=cfg.max_iter, regParam=cfg.reg_param,
                            elasticNetParam=cfg.elastic_net)
    if cfg.weight_col:
        lr.setWeightCol(cfg.weight_col)
    stages = text_features(cfg.num_features) if cfg.features == "text" else []
    return Pipeline(stages=stages + [lr])


def train_text_classifier(train: DataFrame, cfg: TrainConfig | None = None, label: str = "label") -> PipelineModel:
    """M1: fit the pipeline on the train split."""
    cfg = cfg or TrainConfig()
    return _pipeline(cfg, label).fit(train.withColumn(label, F.col(label).cast("double")))


def score_model(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M4 with a fitted model: probabilities as ``ARRAY<DOUBLE>``, argmax, confidence."""
    out = model.transform(df).withColumn("probs", vector_to_array("probability"))
    out = out.withColumn("pred", argmax("probs")).withColumn("confidence", F.element_at("probs", F.col("pred") + 1))
    out = out.withColumn("logits", vector_to_array("rawPrediction"))
    return out.drop("probability", "rawPrediction", "prediction", "features", "_cf_words", "_cf_tf")


def _featurised(train: DataFrame, cfg: TrainConfig, keep: list[str]):
    """(feature stages fitted once, (keep..., features) written to the checkpoint folder)."""
    ensure_checkpoint_dir(train.sparkSession)
    stages = Pipeline(stages=text_features(cfg.num_features)).fit(train).stages if cfg.features == "text" else []
    out = PipelineModel(stages).transform(train) if stages else train
    return stages, out.select(*keep, "features").checkpoint()


def _classifier(cfg: TrainConfig, label: str, weight_col: str | None = None) -> LogisticRegression:
    return _pipeline(TrainConfig(**{**cfg.__dict__, "features": "vector", "weight_col": weight_col}), label).getStages()[0]


def train_group_dro(train: DataFrame, rounds: int = 3, eta: float = 0.01, cfg: TrainConfig | None = None,
                    group: str = "domain", label: str = "label"):
    """M2: outer rounds fit -> score -> per-group mean loss -> multiplicative group weights
    ``q_g <- q_g * exp(eta * loss_g)`` (normalised, row weight ``q_g * G``) -> refit.
    Texts are featurised once and the vectors written to the checkpoint folder; the weight table
    has one row per group and is broadcast behind a check of its size. Rows without a group take no
    part."""
    from functools import reduce
    from corpusflow.functions.arrays import cross_entropy
    cfg = cfg or TrainConfig()
    stages, data = _featurised(train.withColumn(label, F.col(label).cast("int")).where(F.col(group).isNotNull()), cfg, [group, label])
    weights = data.select(group).distinct().withColumn("q", F.lit(1.0)).checkpoint()
    history, fitted = [], None
    for r in range(rounds):
        g_count = weights.count()
        w = (data.join(broadcast_checked(weights), group).withColumn("_cf_w", F.col("q") * F.lit(float(g_count)))
             .withColumn(label, F.col(label).cast("double")))
        fitted = _classifier(cfg, label, "_cf_w").fit(w)
        scored = score_model(PipelineModel([fitted]), data).withColumn(
            "_cf_ce", cross_entropy(F.transform("probs", lambda p: F.log(p)), label))
        loss = scored.groupBy(group).agg(F.avg("_cf_ce").alias("loss")).checkpoint()
        upd = (weights.join(loss, group, "left")
               .withColumn("q", F.col("q") * F.exp(F.lit(eta) * F.coalesce(F.col("loss"), F.lit(0.0)))))
        total = upd.agg(F.sum("q").alias("_cf_t"))
        # cut the lineage of the round loop (reliable checkpoint in the shared folder)
        weights = upd.crossJoin(F.broadcast(total)).select(group, (F.col("q") / F.col("_cf_t")).alias("q")).checkpoint()
        history.append(loss.withColumn("round", F.lit(r)))
    return PipelineModel([*stages, fitted]), weights, reduce(lambda a, b: a.unionByName(b), history)


def train_mixup(df: DataFrame, id_col: str, features: str = "features_arr", label: str = "label", batch: str = "batch_id", alpha: float = 0.2,
                seed: int = 42, max_iter: int = 30, reg_param: float = 0.01):
    """M3: mixup pairs inside batches (L4), two weighted rows per pair - the blend with either label, weights lambda and
    1 - lambda (L5) - and a multinomial classifier on them. ``features`` is an array of numbers. Returns the model."""
    from pyspark.ml.functions import array_to_vector
    from corpusflow.operators.robust import mixup_features, mixup_pairs
    pairs = mixup_features(mixup_pairs(df, id_col, batch, seed, alpha=alpha), feat=features, out="_cf_mixed")
    side = F.explode(F.array(F.struct(F.col(label).cast("double").alias("y"), F.col("lam").alias("w")),
                             F.struct(F.col(f"{label}_b").cast("double").alias("y"), (1 - F.col("lam")).alias("w"))))
    rows = pairs.select(array_to_vector("_cf_mixed").alias("features"), side.alias("s")).select("features", "s.*").where("w > 0")
    return LogisticRegression(labelCol="y", weightCol="w", maxIter=max_iter, regParam=reg_param, family="multinomial").fit(rows)


def train_rounds(train: DataFrame, val: DataFrame, iterations: list[int], cfg: TrainConfig | None = None,
                 patience: int | None = None, metric: str = "val_f1", label: str = "label"):
    """M1 with H1-H3: one fit per round with a growing number of L-BFGS iterations, validated after
    each -> ({epoch: model}, history).

    Texts are featurised once. History has a row per round: epoch, train_loss, val_loss, val_acc,
    val_f1 (macro). The loop ends after ``patience`` rounds in a row that do not exceed the best
    ``metric`` of the rounds before (for a loss: that are not below the lowest)."""
    from corpusflow.operators.evaluate import prf
    cfg = cfg or TrainConfig()
    stages, data = _featurised(train.withColumn(label, F.col(label).cast("double")), cfg, [label])
    checked = (PipelineModel(stages).transform(val) if stages else val).select(label, "features").checkpoint()
    models, rows, best, since = {}, [], None, 0

    def log_loss(scored: DataFrame):
        return scored.agg(F.avg(-F.log(F.greatest(F.element_at("probs", F.col(label).cast("int") + 1), F.lit(1e-15))))).first()[0]

    for epoch, n in enumerate(iterations, start=1):
        fitted = _classifier(TrainConfig(**{**cfg.__dict__, "max_iter": n}), label).fit(data)
        models[epoch] = PipelineModel([*stages, fitted])
        scored = score_model(PipelineModel([fitted]), checked.withColumn(label, F.col(label).cast("int"))).checkpoint()
        m = prf(scored, "macro").first()
        row = {"epoch": epoch, "train_loss": log_loss(score_model(PipelineModel([fitted]), data)), "val_loss": log_loss(scored),
               "val_acc": m["accuracy"], "val_f1": m["f1"]}
        rows.append(row)
        now = -(row[metric] or 0.0) if metric.endswith("loss") else row[metric] or 0.0
        best, since = (now, 0) if best is None or now > best else (best, since + 1)
        if patience and since >= patience:
            break
    history = train.sparkSession.createDataFrame(
        [tuple(r.values()) for r in rows], "epoch int, train_loss double, val_loss double, val_acc double, val_f1 double")
    return models, history


def evaluate(models_by_epoch: dict, history: DataFrame, df: DataFrame, use: str = "best",
             metric: str = "val_f1") -> DataFrame:
    """M5: score ``df`` with the best epoch's model (H1: strictly better than all before,
    first of ties) or the last one, as the reference variants do. The choice reads one row
    of the (tiny) history table."""
    from corpusflow.operators.history import best_epoch
    if use == "last":
        pick = max(models_by_epoch)
    else:
        hist = history.withColumn("run_id", F.lit("run")) if "run_id" not in history.columns else history
        row = best_epoch(hist, metric).first()
        pick = row.best_epoch if row is not None and row.best_epoch is not None else max(models_by_epoch)
    return score_model(models_by_epoch[pick], df).withColumn("model_epoch", F.lit(pick))


def domain_probe(df: DataFrame, domain: str = "domain", cfg: TrainConfig | None = None, buckets: int = 1000) -> DataFrame:
    """L8 re-aim: fit a multinomial classifier of the domain from the features; its accuracy and
    log-loss measure how much domain leaks into the representation. Up to ``buckets`` domains are a
    class each; more are dealt to ``buckets`` classes by T6, and ``n_classes`` tells how many are
    used. So the coefficients hold at most ``buckets`` x features. Rows without a domain take no part."""
    from corpusflow.operators.robust import domain_bucket
    cfg = cfg or TrainConfig(max_iter=30)
    _, data = _featurised(df.where(F.col(domain).isNotNull()), cfg, [domain])
    key = F.col(domain).cast("string")
    if len(data.select(key).distinct().limit(buckets + 1).collect()) > buckets:
        key = domain_bucket(domain, buckets).cast("string")
    names = sorted(r[0] for r in data.select(key).distinct().collect())            # at most ``buckets``
    classes = df.sparkSession.createDataFrame([(x, float(k)) for k, x in enumerate(names)], "_cf_key string, _cf_dom double")
    data = data.withColumn("_cf_key", key).join(F.broadcast(classes), "_cf_key")
    lr = LogisticRegression(featuresCol="features", labelCol="_cf_dom", maxIter=cfg.max_iter,
                            regParam=cfg.reg_param, family="multinomial")
    out = lr.fit(data).transform(data).withColumn("_cf_p", vector_to_array("probability"))
    ll = -F.log(F.greatest(F.element_at("_cf_p", F.col("_cf_dom").cast("int") + 1), F.lit(1e-15)))
    return out.agg(F.countDistinct(domain).alias("n_domains"), F.countDistinct("_cf_dom").alias("n_classes"),
                   F.avg((F.col("prediction") == F.col("_cf_dom")).cast("double")).alias("accuracy"),
                   F.avg(ll).alias("log_loss"))


def train_ensemble(train: DataFrame, configs: list[TrainConfig], label: str = "label"):
    """Fit each base model; a failing configuration is reported, not fatal."""
    models, report = {}, []
    for cfg in configs:
        try:
            models[cfg.name] = train_text_classifier(train, cfg, label)
            report.append((cfg.name, "ok", None))
        except Exception as e:  # noqa: BLE001 - one failure does not stop the rest
            report.append((cfg.name, "failed", str(e).splitlines()[0][:200]))
    return models, report


def save_model(model: PipelineModel, path: str) -> None:
    """K5: persist (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """K5: reload for inference."""
    return PipelineModel.load(path)
