"""Losses and domain-robustness statistics over scored rows.

Input: a scored table ``(id, batch_id, domain, label, logits ARRAY<DOUBLE>)``. Every
statistic is a two-level aggregate: partial sums per ``(batch, domain)`` first (combined
map-side, so a domain holding a third of the rows costs nothing special), then per batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.arrays import blend, cross_entropy, kl_div, softmax
from corpusflow.operators.positions import hash_key, running_agg
from corpusflow.session import ensure_checkpoint_dir


def row_cross_entropy(df: DataFrame, logits: str = "logits", label: str = "label", out: str = "ce") -> DataFrame:
    """L1: per-row cross-entropy."""
    return df.withColumn(out, cross_entropy(logits, label))


def epoch_loss(df: DataFrame, loss: str = "ce", batch: str = "batch_id") -> DataFrame:
    """L2: mean over batches of the batch mean (a short last batch weighs the same)."""
    per_batch = df.groupBy(batch).agg(F.avg(loss).alias("_cf_bl"))
    return per_batch.agg(F.avg("_cf_bl").alias("epoch_loss"), F.count(F.lit(1)).alias("n_batches"))


def rdrop_loss(df: DataFrame, logits1: str = "logits", logits2: str = "logits2", label: str = "label",
               alpha: float = 2.0, batch: str = "batch_id") -> DataFrame:
    """L3: per batch ``(CE1 + CE2)/2 + alpha * KL(softmax2 || softmax1)``, batch means."""
    row = (0.5 * (cross_entropy(logits1, label) + cross_entropy(logits2, label))
           + F.lit(alpha) * kl_div(logits2, logits1))
    return df.groupBy(batch).agg(F.avg(row).alias("rdrop_loss"), F.count(F.lit(1)).alias("n"))


def mixup_pairs(df: DataFrame, id_col: str, batch: str = "batch_id", seed: int = 42,
                lam=None, alpha: float = 0.2) -> DataFrame:
    """L4: one partner per row inside its batch (a seeded permutation) and one lambda per
    batch. Partner of row i = the row whose rank by a second hash equals i's rank by the
    first; batches are small, so the self-join is on ``(batch, rank)``.

    ``lam`` fixed -> that value; else a per-batch Beta(alpha, alpha) draw (alpha <= 0 -> 1), see :func:`beta_draw`. Rows
    with a null batch id are one batch."""
    a = df.withColumn("_cf_r1", F.row_number().over(
        Window.partitionBy(batch).orderBy(hash_key(seed, id_col), id_col)))
    b = df.select(F.col(batch).alias("_cf_b"), F.col(id_col).alias("partner_id"),
                  *[F.col(c).alias(f"{c}_b") for c in df.columns if c not in (batch, id_col)],
                  F.row_number().over(Window.partitionBy(batch).orderBy(hash_key(seed + 1, id_col), id_col))
                  .alias("_cf_r2"))
    j = a.join(b, a[batch].eqNullSafe(b["_cf_b"]) & (a["_cf_r1"] == b["_cf_r2"])).drop("_cf_b", "_cf_r1", "_cf_r2")
    if lam is not None:
        return j.withColumn("lam", F.lit(float(lam)))
    return j.withColumn("lam", beta_draw(F.col(batch), seed, alpha))


def beta_draw(batch_col, seed: int, alpha: float):
    """Seeded Beta(alpha, alpha) per batch id of any kind, negative or null: its hash seeds the batch's own draw (one per batch and
    Arrow batch; alpha <= 0 gives 1.0). A null batch id is a batch of its own."""

    @F.pandas_udf("double")
    def _draw(h: pd.Series) -> pd.Series:
        if alpha <= 0:
            return pd.Series(np.ones(len(h)))
        lam = {x: np.random.default_rng([seed, int(x) & (1 << 64) - 1]).beta(alpha, alpha) for x in h.unique()}
        return h.map(lam)
    return _draw(F.xxhash64(batch_col))


def mixup_features(pairs: DataFrame, feat: str = "features", out: str = "mixed") -> DataFrame:
    """Blend feature vectors (not token ids, V8): ``lam*a + (1-lam)*b``."""
    return pairs.withColumn(out, blend(F.col(feat).cast("array<double>"), F.col(f"{feat}_b").cast("array<double>"),
                                       F.col("lam")))


def mixup_mask(pairs: DataFrame, mask: str = "attention_mask", out: str = "mixed_mask") -> DataFrame:
    """Attention mask of a blended pair: a place counts if either row has a token there. Masks of
    different lengths: the shorter one is 0 beyond its end; a null mask is empty."""
    empty = F.array().cast("array<int>")
    a, b = (F.coalesce(F.col(c).cast("array<int>"), empty) for c in (mask, f"{mask}_b"))
    return pairs.withColumn(out, F.zip_with(a, b, lambda x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0)))))


def mixup_loss(pairs: DataFrame, logits: str = "logits", label: str = "label", batch: str = "batch_id") -> DataFrame:
    """``lam*CE(pred, a) + (1-lam)*CE(pred, b)``, batch means."""
    row = F.col("lam") * cross_entropy(logits, label) + (1 - F.col("lam")) * cross_entropy(logits, f"{label}_b")
    return pairs.groupBy(batch).agg(F.avg(row).alias("mixup_loss"))


def _group_stats(df: DataFrame, loss: str, batch: str, group: str) -> DataFrame:
    return df.groupBy(batch, group).agg(F.sum(loss).alias("s"), F.count(F.lit(1)).alias("n"))


def group_dro(df: DataFrame, eta: float = 0.01, loss: str = "ce", batch: str = "batch_id",
              group: str = "domain") -> DataFrame:
    """Per batch, w_g = softmax(eta * mean loss of g) over the groups present;
    loss = sum_i w_g(i) l_i / N."""
    g = _group_stats(df, loss, batch, group)
    g = g.withColumn("e", F.exp(F.lit(eta) * F.col("s") / F.col("n")))
    g = g.withColumn("w", F.col("e") / F.sum("e").over(Window.partitionBy(batch)))
    return g.groupBy(batch).agg((F.sum(F.col("w") * F.col("s")) / F.sum("n")).alias("dro_loss"),
                                F.count(F.lit(1)).alias("n_groups"))


def group_weights(df: DataFrame, eta: float = 0.01, loss: str = "ce", batch: str = "batch_id",
                  group: str = "domain") -> DataFrame:
    """L6 weights per ``(batch, group)``."""
    g = _group_stats(df, loss, batch, group)
    g = g.withColumn("e", F.exp(F.lit(eta) * F.col("s") / F.col("n")))
    return g.select(batch, group, (F.col("e") / F.sum("e").over(Window.partitionBy(batch))).alias("weight"))


def irm_penalty(df: DataFrame, weight: float = 1e3, mode: str = "reference", loss: str = "ce",
                logits: str = "logits", label: str = "label", batch: str = "batch_id",
                group: str = "domain") -> DataFrame:
    """Per batch; batches with < 2 domains -> 0; domains with < 2 rows skipped.

    ``reference``: the gradient of the scaled loss is the loss -> weight * mean_g(m_g^2).
    ``paper`` (IRMv1): g = mean_i sum_k (p_k - y_k) z_k per domain -> weight * mean_g(g^2)."""
    if mode == "paper":
        p = softmax(logits)
        y = F.col(label).cast("int")
        pairs = F.arrays_zip(p.alias("p"), F.col(logits).alias("z"))
        grad = F.aggregate(F.transform(pairs, lambda e, i: (e["p"] - F.when(i == y, 1.0).otherwise(0.0)) * e["z"]),
                           F.lit(0.0), lambda acc, x: acc + x)
        df = df.withColumn("_cf_g", grad)
        val = "_cf_g"
    else:
        val = loss
    g = df.groupBy(batch, group).agg(F.avg(val).alias("m"), F.count(F.lit(1)).alias("n"))
    per = g.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_domains"),
        F.avg(F.when(F.col("n") >= 2, F.col("m") * F.col("m"))).alias("_cf_pen"))
    return per.select(batch, (F.when(F.col("n_domains") < 2, F.lit(0.0))
                              .otherwise(F.coalesce(F.col("_cf_pen") * F.lit(weight), F.lit(0.0)))).alias("irm_penalty"))


def group_loss_running(df: DataFrame, loss: str = "ce", batch: str = "batch_id", group: str = "domain") -> DataFrame:
    """Running per-domain loss total and count over batches. Works on the per-(domain,
    batch) partial sums, never on raw rows, and a domain's batches are spread over ranges."""
    ensure_checkpoint_dir(df.sparkSession)
    g = _group_stats(df, loss, batch, group).checkpoint()     # read once for the ranges, once for the sums
    g = running_agg(g, "s", "loss_sum", [group], batch, how="sum", exclusive=False)
    g = running_agg(g, "n", "n_seen", [group], batch, how="sum", exclusive=False)
    return g.select(group, batch, "loss_sum", "n_seen")


def domain_bucket(col, buckets: int = 1000):
    """Reproducible domain bucket ``int(md5[:8], 16) % buckets`` (the reference uses
    the salted Python ``hash`` and is not reproducible)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
