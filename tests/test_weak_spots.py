"""Null labels in metrics, any batch id in mixup, hash aggregates in the narrow de-duplication, one pass of metrics."""

import random

from pyspark.sql import functions as F

from corpusflow.operators import curate as C
from corpusflow.operators import evaluate as E
from corpusflow.operators import robust as L


def test_rows_without_label_or_prediction_are_no_class(spark):
    rows = [(1, 1, 0.9, 0), (0, 1, 0.4, 0), (0, 0, 0.2, 1), (1, 0, 0.3, 1)]
    odd = [(None, 1, 0.5, 0), (1, None, None, 1), (None, None, 0.1, 1)]
    schema = "label int, pred int, score double, batch_id int"
    clean, all_ = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + odd, schema)
    for average in ("macro", "weighted"):
        assert E.prf(all_, average).first() == E.prf(clean, average).first()
    assert E.auc_score(all_).first() == E.auc_score(clean).first() and abs(E.auc_score(clean).first()["auc"] - 0.75) < 1e-12
    assert E.per_class(all_).count() == 2
    assert tuple(E.unscored(all_).first()) == (7, 2, 2)
    a, b = (E.evaluate_table(x.withColumn("ce", F.when(F.col("label").isNotNull(), F.col("score")))).first() for x in (all_, clean))
    assert (a["accuracy"], a["f1"], a["auc"]) == (b["accuracy"], b["f1"], b["auc"])


def test_auc_of_many_tied_scores(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(2), float(rng.randrange(-20, 20))) for _ in range(800)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(E.auc_score(spark.createDataFrame(rows, "label int, score double")).first()["auc"] - want) < 1e-12
    assert E.auc_score(spark.createDataFrame([], "label int, score double")).first()["auc"] == 0.0


def test_metrics_read_the_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    schema = "label int, pred int, ce double, batch_id int"
    df = spark.createDataFrame([(k % 2, k % 3 % 2, 0.1 * k, k // 4) for k in range(20)], schema).mapInPandas(read, schema)
    assert E.evaluate_table(df).count() == 1 and seen.value == 20


def test_mixup_of_any_batch_id(spark):
    rows = [(k, b, float(k)) for k, b in enumerate([None, None, None, -5, -5, 0, 0, 7, 7, 2 ** 40])]
    df = spark.createDataFrame(rows, "id long, batch_id long, x double")
    out = L.mixup_pairs(df, "id", alpha=0.2).collect()
    by = {}
    for r in out:
        by.setdefault(r["batch_id"], []).append(r)
        assert dict((i, b) for i, b, _ in rows)[r["partner_id"]] == r["batch_id"] and r["x_b"] == float(r["partner_id"])
    assert {b: len(v) for b, v in by.items()} == {None: 3, -5: 2, 0: 2, 7: 2, 2 ** 40: 1}
    lam = {b: {r["lam"] for r in v} for b, v in by.items()}
    assert all(len(v) == 1 and 0 <= min(v) <= 1 for v in lam.values()) and len({min(v) for v in lam.values()}) == 5
    again = {(r["batch_id"], r["lam"]) for r in L.mixup_pairs(df.repartition(3), "id", alpha=0.2).collect()}
    assert again == {(b, min(v)) for b, v in lam.items()}
    assert {r["lam"] for r in L.mixup_pairs(df, "id", alpha=0.0).collect()} == {1.0}


def test_beta_draws_have_the_distribution(spark):
    lam = [r[0] for r in spark.range(-2000, 2000).select(L.beta_draw(F.col("id"), 3, 0.5)).collect()]
    mean = sum(lam) / len(lam)
    assert abs(mean - 0.5) < 0.03 and abs(sum((x - mean) ** 2 for x in lam) / len(lam) - 0.125) < 0.01       # 1 / (4 (2a + 1))


def test_narrow_dedupe_uses_hash_aggregates_and_equals_the_wide_one(spark):
    rng = random.Random(3)
    rows = [(f"t{rng.randrange(150)}" if k % 9 else None, rng.randrange(3), k, "x" * 50) for k in range(600)]
    df = spark.createDataFrame(rows, "text string, dataset_rank int, row_idx long, body string").repartition(5)
    out = C.dedupe_first(df, narrow=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan and "SortMergeJoin" not in plan
    assert sorted(map(repr, out.collect())) == sorted(map(repr, C.dedupe_first(df).select(*out.columns).collect()))
    text = C.dedupe_first(df.withColumn("row_idx", F.col("row_idx").cast("string")), narrow=True)        # other kinds of keys
    assert text.count() == out.count()
    low = spark.createDataFrame([("a", -1, -5), ("a", -1, -6), ("b", 0, None), ("a", 3, -9)], "text string, dataset_rank int, row_idx long")
    assert sorted(map(repr, C.dedupe_first(low, narrow=True).collect())) == sorted(map(repr, [x for x in low.collect() if x["row_idx"] in (-6, None)]))
