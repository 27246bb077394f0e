"""Classification metrics as aggregations.

All metrics start from the confusion counts ``groupBy(label, pred).count()`` (one partial
aggregate, at most classes^2 rows), so they cost one pass over the scored rows. Rows with a null
label or prediction are no part of any metric; :func:`unscored` counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.operators.positions import value_bucket
from corpusflow.session import ensure_checkpoint_dir


def unscored(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(n, no_label, no_pred): all rows, and those that metrics leave out for want of a label or a prediction."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label).isNull()).alias("no_label"), F.count_if(F.col(pred).isNull()).alias("no_pred"))


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.where(F.col(label).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """tp/fp/fn/support per class over labels ∪ predictions."""
    return _per_class(confusion_counts(df, label, pred))


def _per_class(cc: DataFrame) -> DataFrame:
    """From (label, pred, n): each cell counts for the class of its label and for that of its prediction; one scan of the cells."""
    side = F.explode(F.array(F.struct(F.col("label").alias("cls"), F.lit(True).alias("is_true")), F.struct(F.col("pred").alias("cls"), F.lit(False).alias("is_true"))))
    u = cc.select(side.alias("s"), "n", (F.col("label") == F.col("pred")).alias("hit")).select("s.*", "n", "hit")

    def total(cond):
        return F.sum(F.when(cond, F.col("n")).otherwise(0))
    true, hit = F.col("is_true"), F.col("hit")
    return u.groupBy("cls").agg(total(true & hit).alias("tp"), total(~true & ~hit).alias("fp"), total(true & ~hit).alias("fn"), total(true).alias("support"))


def _prf_cols():
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return prec, rec, f1


def prf(df: DataFrame, average: str = "macro", label: str = "label", pred: str = "pred") -> DataFrame:
    """Accuracy and macro or weighted precision / recall / F1 (zero division -> 0)."""
    return _prf(per_class(df, label, pred), average)


def _prf(pc: DataFrame, average: str) -> DataFrame:
    prec, rec, f1 = _prf_cols()
    pc = pc.select("*", prec.alias("p"), rec.alias("r"), f1.alias("f"))
    if average == "weighted":
        w = F.col("support").cast("double")
        aggs = [(F.sum(F.col(m) * w) / F.sum(w)).alias(n) for m, n in [("p", "precision"), ("r", "recall"), ("f", "f1")]]
    else:
        aggs = [F.avg(F.col(m)).alias(n) for m, n in [("p", "precision"), ("r", "recall"), ("f", "f1")]]
    aggs.append((F.sum("tp") / F.sum("support")).alias("accuracy"))
    return pc.agg(*aggs)


def _auc_of_cells(cells: list) -> Column:
    tp, fn, tn, fp = cells
    pos, neg = tp + fn, tn + fp
    return F.when((pos == 0) | (neg == 0), F.lit(0.0)).otherwise((tp / pos + tn / neg) / 2)


def auc_hard(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """ROC AUC of hard 0/1 predictions = (TPR + TNR) / 2; one class only -> 0.0."""
    cc = df.agg(
        F.count_if((F.col(label) == 1) & (F.col(pred) == 1)).alias("tp"),
        F.count_if((F.col(label) == 1) & (F.col(pred) != 1)).alias("fn"),
        F.count_if((F.col(label) != 1) & (F.col(pred) != 1)).alias("tn"),
        F.count_if((F.col(label) != 1) & (F.col(pred) == 1)).alias("fp"))
    return cc.select(_auc_of_cells([F.col(c) for c in ("tp", "fn", "tn", "fp")]).alias("auc"))


def auc_score(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """E5: exact ROC AUC on scores (ties count one half): counts per distinct score, written once, then the negatives
    below each score - ranges of scores from their quantiles, a running sum inside each (no single-task sort) and the
    totals of the ranges before. Rows without a score or a label take no part."""
    ensure_checkpoint_dir(df.sparkSession)
    per = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")).checkpoint()
    run = value_bucket(per, "s", 1024, "b").checkpoint()
    below = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = run.groupBy("b").agg(F.sum("neg").alias("n")).select("b", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("before"))   # 1,025 rows at most
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tot = (run.withColumn("inside", inside).join(F.broadcast(before), "b")
           .agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("P"), F.coalesce(F.sum("neg"), F.lit(0)).alias("N"),
                F.sum(F.col("pos").cast("double") * (F.col("before") + F.col("inside") + 0.5 * F.col("neg"))).alias("U")))
    return tot.select(F.when((F.col("P") == 0) | (F.col("N") == 0), F.lit(0.0))
                      .otherwise(F.col("U") / F.col("P").cast("double") / F.col("N").cast("double")).alias("auc"))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", classes=(0, 1)) -> DataFrame:
    """Confusion matrix, one row per true class, one column per predicted class;
    ``pred_other`` counts predictions outside ``classes`` (null included)."""
    known = F.coalesce(F.col(pred).isin(*classes), F.lit(False))
    return df.groupBy(F.col(label).alias("label")).agg(
        *[F.count_if(F.col(pred) == c).alias(f"pred_{c}") for c in classes], F.count_if(~known).alias("pred_other"))


def evaluate_table(df: DataFrame, loss: str = "ce", batch: str = "batch_id", label: str = "label",
                   pred: str = "pred") -> DataFrame:
    """One metric record: loss (L2), accuracy, macro P/R/F1, hard AUC."""
    parts = (df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred"), F.col(batch).alias("batch"))
             .agg(F.sum(loss).alias("s"), F.count(loss).alias("m"), F.count(F.lit(1)).alias("n")).checkpoint())   # the one pass over the rows
    per_batch = parts.groupBy("batch").agg((F.sum("s") / F.sum("m")).alias("l"))
    cells = parts.where("label is not null and pred is not null").groupBy("label", "pred").agg(F.sum("n").alias("n"))

    def cell(cond):
        return F.coalesce(F.sum(F.when(F.expr(cond), F.col("n"))), F.lit(0))
    auc = cells.agg(_auc_of_cells([cell("label = 1 and pred = 1"), cell("label = 1 and pred <> 1"), cell("label <> 1 and pred <> 1"), cell("label <> 1 and pred = 1")]).alias("auc"))
    m = _prf(_per_class(cells), "macro")
    return per_batch.agg(F.avg("l").alias("loss")).crossJoin(m).crossJoin(auc).select("loss", "accuracy", "precision", "recall", "f1", "auc")


def target_met(metrics: DataFrame, accuracy: float = 0.93, f1: float | None = 0.93) -> DataFrame:
    """Accuracy >= target and (when given) F1 >= target."""
    cond = F.col("accuracy") >= accuracy
    if f1 is not None:
        cond = cond & (F.col("f1") >= f1)
    return metrics.withColumn("target_met", cond)
