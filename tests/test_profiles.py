"""Profiles, dedupe keep-first, tail, report."""

from pyspark.sql import functions as F

from corpusflow.operators import curate as C
from corpusflow.operators.split import tail
from corpusflow.sources.sinks import run_report


def _corpus(spark):
    rows = [("same text", 1, "a", "en", "s1", 0, 5), ("same text", 0, "b", "fr", "s2", 1, 1),
            ("same text", 0, "c", "en", "s1", 0, 7), ("other", 0, "a", "en", "s1", 0, 2)]
    return spark.createDataFrame(rows, "text string, label int, domain string, language string, dataset string, "
                                       "dataset_rank int, row_idx long")


def test_dedupe_keeps_first_in_source_then_row_order(spark):
    out = {r.text: (r.dataset_rank, r.row_idx, r.domain) for r in C.dedupe_first(_corpus(spark).repartition(3)).collect()}
    assert out == {"same text": (0, 5, "a"), "other": (0, 2, "a")}


def test_distribution_one_pass(spark):
    got = {(r.column, r.value): r.n for r in C.distribution(_corpus(spark)).collect()}
    assert got == {("label", "1"): 1, ("label", "0"): 3, ("language", "en"): 3, ("language", "fr"): 1,
                   ("dataset", "s1"): 3, ("dataset", "s2"): 1}


def test_filters(spark):
    df = spark.createDataFrame([("   ",), ("a" * 10,), ("a" * 11,), (None,)], "text string")
    assert C.drop_blank(df).count() == 2
    assert C.min_length(df, 10).count() == 1


def test_tail(spark):
    df = spark.range(25).withColumnRenamed("id", "seq")
    assert sorted(r.seq for r in tail(df, 10, ["seq"]).collect()) == list(range(15, 25))


def test_run_report_long_form(spark):
    info = spark.createDataFrame([(10, 4)], "total long, n_fake long")
    metrics = spark.createDataFrame([(0.8233, 2.0 / 3)], "accuracy double, f1 double")
    rep = {(r.section, r.key): r.value for r in run_report(info, {"seed": 42}, metrics).collect()}
    assert rep == {("dataset", "total"): "10", ("dataset", "n_fake"): "4", ("config", "seed"): "42",
                   ("metrics", "accuracy"): "0.823300", ("metrics", "f1"): "0.666667"}


def test_dedupe_narrow_equals_default(spark):
    import __spark_entry__  # noqa: F401 - repo root on the path
    from corpusflow.plans.fixtures import corpus
    c = C.clean(corpus(spark, "/root/testdata/sf0.001"), "a").persist()
    a = sorted(tuple(r) for r in C.dedupe_first(c).select("dataset_rank", "row_idx", "text").collect())
    b = sorted(tuple(r) for r in C.dedupe_first(c, narrow=True).select("dataset_rank", "row_idx", "text").collect())
    assert a == b and len(a) > 0
    small = C.dedupe_first(_corpus(spark), narrow=True).collect()
    assert {r.text: (r.dataset_rank, r.row_idx) for r in small} == {"same text": (0, 5), "other": (0, 2)}
