"""Run history, best epoch, early stopping, ensembles.

History tables are tiny ``(run_id, epoch, ...)``; windows are per run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.arrays import argmax


def checkpoint_flags(history: DataFrame, metric: str = "val_f1", run: str = "run_id",
                     epoch: str = "epoch") -> DataFrame:
    """H1 flag: strictly better than every earlier epoch, starting from 0.0."""
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("improved", F.col(metric) > F.coalesce(F.max(metric).over(w), F.lit(0.0)))


def best_epoch(history: DataFrame, metric: str = "val_f1", run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """H1: best epoch per run (first of ties); runs whose metric never exceeds 0 have none."""
    best = history.groupBy(run).agg(
        F.min_by(F.struct(F.col(epoch).alias("best_epoch"), F.col(metric).alias("best_f1")),
                 F.struct(-F.col(metric), F.col(epoch))).alias("b"))
    return best.select(run, F.when(F.col("b.best_f1") > 0, F.col("b.best_epoch")).alias("best_epoch"),
                       F.col("b.best_f1").alias("best_f1"))


def early_stop(history: DataFrame, patience: int = 3, metric: str = "val_f1", run: str = "run_id",
               epoch: str = "epoch") -> DataFrame:
    """H2: stop epoch = first evaluation that is the ``patience``-th in a row without
    improvement (null when training runs to the end)."""
    f = checkpoint_flags(history, metric, run, epoch)
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    # evaluations since the last improvement (all so far if none yet)
    f = f.withColumn("_cf_rank", F.row_number().over(Window.partitionBy(run).orderBy(epoch)))
    f = f.withColumn("_cf_imp_rank", F.max(F.when(F.col("improved"), F.col("_cf_rank"))).over(w))
    f = f.withColumn("since", F.col("_cf_rank") - F.coalesce(F.col("_cf_imp_rank"), F.lit(0)))
    stop = f.groupBy(run).agg(F.min(F.when(F.col("since") >= patience, F.col(epoch))).alias("stop_epoch"),
                              F.max(epoch).alias("last_epoch"))
    return stop


def history_arrays(history: DataFrame, cols=("val_f1",), run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """K1: long history -> parallel arrays ordered by epoch."""
    s = F.sort_array(F.collect_list(F.struct(F.col(epoch), *[F.col(c) for c in cols])))
    g = history.groupBy(run).agg(s.alias("_cf_h"))
    def field(name):
        return F.transform("_cf_h", lambda e: e[name])
    return g.select(run, field(epoch).alias("epochs"), *[field(c).alias(c) for c in cols])


def ensemble_average(scored_long: DataFrame, id_col: str = "id", probs: str = "probs",
                     n_classes: int = 2) -> DataFrame:
    """Average the models' class probabilities per row, then argmax."""
    g = scored_long.groupBy(id_col).agg(
        *[F.avg(F.element_at(probs, k + 1)).alias(f"p{k}") for k in range(n_classes)],
        F.count(F.lit(1)).alias("n_models"))
    return g.withColumn("pred", argmax(F.array(*[F.col(f"p{k}") for k in range(n_classes)])))


def ensemble_summary(per_model: DataFrame, model: str = "model", acc: str = "accuracy",
                     bonus: float = 0.02, cap: float = 0.95) -> DataFrame:
    """Accuracy per model, their mean and the projection min(mean + bonus, cap).
    Failed models (null accuracy) are absent."""
    ok = per_model.where(F.col(acc).isNotNull())
    mean = ok.agg(F.avg(acc).alias("mean_accuracy"), F.count(F.lit(1)).alias("n_models"))
    return (ok.select(model, acc).crossJoin(mean)
            .withColumn("projected", F.least(F.col("mean_accuracy") + F.lit(bonus), F.lit(cap))))
