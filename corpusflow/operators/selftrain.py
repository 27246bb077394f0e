"""Self-training: fit, score the rows without a label, accept the confident ones, fit again."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.evaluate import prf
from corpusflow.operators.gradient import GradientConfig, TrainState, batch_of, score, train_epochs
from corpusflow.session import broadcast_checked, ensure_checkpoint_dir, scratch_path


def self_train(gold: DataFrame, unlabelled: DataFrame, held_out: DataFrame, cfg: GradientConfig, id_col: str, rounds: int = 5,
               epochs: int = 2, n_batches: int = 4, threshold: float = 0.9, tolerance: float = 0.0):
    """Rounds of training on gold and accepted rows -> (state of the best round, accepted rows, history).

    ``gold`` has id, ``features``, ``label``; ``unlabelled`` id and ``features`` (rows whose id is in gold are left out, repeated ids
    count once); ``held_out`` features and label, and takes no part in training. A round goes on from the former weights (a
    fresh optimiser), trains on gold and on what was accepted so far, is measured on ``held_out``, then accepts again: all
    rows not in gold whose confidence is at least ``threshold``, with the class of now, so a doubtful row leaves as it came.

    The loop stops after a round whose accepted rows are those of the round before (the fixpoint), after a
    round whose held-out macro F1 is more than ``tolerance`` below the best, whose work is then discarded, or after
    ``rounds``. History, a row per round: round, n_pseudo (accepted rows trained on), n_added, n_changed (new class), n_left,
    accuracy, f1, kept. Vectors are written once, by batch, and never move after that: a round finds its rows' classes by scoring
    them again with the weights that accepted them. Ids and classes of the accepted rows are written once per round, nothing is
    collected but counts and weights.
    """
    ensure_checkpoint_dir(gold.sparkSession)
    spark = gold.sparkSession

    def by_batch(df, name):
        path = scratch_path(spark, name)
        (df.withColumn("rid", F.xxhash64("id")).withColumn("grp", F.lit("")).withColumn("batch", batch_of(n_batches, "id", cfg.seed))
         .write.partitionBy("batch").parquet(path))          # by the tasks that have the rows: nothing is shuffled
        return spark.read.schema(df.select("*", F.lit(0).cast("long").alias("rid"), F.lit("").alias("grp"), F.lit(0).alias("batch")).schema).parquet(path)

    gold = by_batch(gold.select(F.col(id_col).alias("id"), "features", F.col("label").cast("int").alias("label")).where("id is not null and label is not null"), "gold")
    rest = unlabelled.select(F.col(id_col).alias("id"), "features").where("id is not null and features is not null")
    pool = by_batch(_once(rest.join(broadcast_checked(gold.select("id").distinct().checkpoint()), "id", "left_anti")), "pool")
    known = gold.where("features is not null")
    gold_batches = {r["batch"] for r in known.select("batch").distinct().collect()}
    check = held_out.select("features", F.col("label").cast("int").alias("label")).where("label is not null").checkpoint()
    pseudo = spark.createDataFrame([], "id " + gold.schema["id"].dataType.simpleString() + ", label int")
    state, best, history, n_pseudo = None, None, [], 0
    columns = ("features", "label", "rid", "grp")

    def accepted(rows, by, *cols):
        """Rows of the pool that the weights ``by`` are sure of, with their class."""
        return (score(rows, by, keep_features="features" in cols).where(F.col("confidence") >= threshold)
                .withColumn("label", F.col("pred").cast("int")).select(*cols))

    def training_rows(batch):
        rows = known.where(F.col("batch") == batch).select(*columns)
        return rows if state is None else rows.unionByName(accepted(pool.where(F.col("batch") == batch), state, *columns))

    took_batches = set()
    for r in range(1, rounds + 1):
        train = {b: training_rows(b) for b in gold_batches | took_batches}
        start = None if state is None else TrainState(state.w.copy(), np.zeros_like(state.m), np.zeros_like(state.v), 0, state.batches, dict(state.q))
        states, _, _ = train_epochs(spark, train, replace(cfg, seed=cfg.seed + r), epochs, state=start)
        now = states[max(states)]
        m = prf(score(check, now).select("label", "pred").checkpoint(), "macro").first()
        kept = best is None or m["f1"] >= best[0] - tolerance
        if not kept:
            history.append((r, n_pseudo, 0, 0, 0, m["accuracy"], m["f1"], False))
            break
        took = accepted(pool, now, "id", "batch", "label").checkpoint()
        took_batches = {x["batch"] for x in took.select("batch").distinct().collect()}
        took = took.drop("batch")
        moved = (took.join(pseudo.withColumnRenamed("label", "was"), "id", "full_outer")
                 .agg(F.count_if(F.expr("was is null")).alias("added"), F.count_if(F.expr("label <> was")).alias("changed"), F.count_if(F.expr("label is null")).alias("left")).first())
        history.append((r, n_pseudo, moved["added"], moved["changed"], moved["left"], m["accuracy"], m["f1"], True))
        state = now
        if best is None or m["f1"] > best[0]:
            best = (m["f1"], now, pseudo)
        pseudo, n_pseudo = took, n_pseudo + moved["added"] - moved["left"]
        if not (moved["added"] or moved["changed"] or moved["left"]):
            break
    hist = spark.createDataFrame(history, "round int, n_pseudo long, n_added long, n_changed long, n_left long, accuracy double, f1 double, kept boolean")
    return best[1], best[2].withColumnRenamed("id", id_col), hist


def _once(df: DataFrame) -> DataFrame:
    """One row per ``id``. Only the ids that repeat are joined back, so rows are not dealt anew for what is mostly unique."""
    many = df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id").checkpoint()
    few = broadcast_checked(many)
    return df.join(few, "id", "left_anti").unionByName(df.join(few, "id", "left_semi").groupBy("id").agg(F.first("features").alias("features")))
