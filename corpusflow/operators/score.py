"""Scoring of logits and pseudo-labelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.arrays import argmax, softmax
from corpusflow.functions.text import decode_label


def score(df: DataFrame, logits: str = "logits", names=("FAKE", "TRUE")) -> DataFrame:
    """M4: softmax, argmax (first wins), confidence = p[argmax], per-class probabilities,
    decoded name."""
    out = df.withColumn("probs", softmax(logits)).withColumn("pred", argmax(logits))
    out = out.withColumn("confidence", F.element_at("probs", F.col("pred") + 1))
    for i, n in enumerate(names):
        out = out.withColumn(f"p_{n.lower()}", F.element_at("probs", i + 1))
    return out.withColumn("pred_name", decode_label("pred", names))


def pseudo_label(gold: DataFrame, scored: DataFrame, id_col: str, threshold: float = 0.9) -> DataFrame:
    """M6: keep confident predictions of rows that have no gold label, add them to gold."""
    cand = scored.join(gold.select(id_col), id_col, "left_anti").where(F.col("confidence") >= threshold)
    return (gold.select(id_col, "label", F.lit("gold").alias("origin"))
            .unionByName(cand.select(id_col, F.col("pred").alias("label"), F.lit("pseudo").alias("origin"))))
