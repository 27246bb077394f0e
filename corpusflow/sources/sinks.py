"""Sinks: history, results, splits, appended history rows, run report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.history import history_arrays


def write_history(history: DataFrame, path: str, arrays: bool = True,
                  cols=("train_loss", "val_loss", "val_f1", "val_acc")) -> None:
    """K1: training history; ``arrays`` -> one JSON object per run with parallel arrays."""
    present = [c for c in cols if c in history.columns]
    out = history_arrays(history, present) if arrays else history
    out.write.mode("overwrite").json(path)


def append_history(row: DataFrame, path: str) -> None:
    """H3: append one epoch row to the long history table."""
    row.write.mode("append").parquet(path)


def results_record(metrics: DataFrame, best_val_f1: DataFrame) -> DataFrame:
    """K2: ``{test_metrics: {...}, best_val_f1}`` as one nested row."""
    m = metrics.select(F.struct(*[F.col(c) for c in metrics.columns]).alias("test_metrics"))
    return m.crossJoin(best_val_f1.select(F.col(best_val_f1.columns[0]).alias("best_val_f1")))


def write_results(record: DataFrame, path: str) -> None:
    """K2: write the record as JSON (one small file)."""
    record.coalesce(1).write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """K6: persist splits partitioned by split name (readers prune by partition)."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def append_jsonl(entries: DataFrame, path: str, compression: str | None = None) -> None:
    """K3: append entries (one JSON string column, or any columns) as JSON lines. ``compression`` names Spark's
    codec for the files; readers know it by their names."""
    out = entries.write.mode("append")
    if compression:
        out = out.option("compression", compression)
    if entries.dtypes and len(entries.dtypes) == 1 and entries.dtypes[0][1] == "string":
        out.text(path)
    else:
        out.json(path)


def run_report(dataset_info: DataFrame, config: dict, metrics: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """K4: the result report as a long ``(section, key, value)`` table: dataset counts,
    configuration literals, metric values and, when given, examples (rendering to text is left to
    readers). ``examples`` has a column ``example`` (their number) beside what to show of each: text,
    prediction, confidence, probabilities; keys are ``<number>.<column>``."""
    def as_text(c, t):
        # doubles with six decimals (Python-compatible rounding), everything else as is
        return (f"regexp_replace(format_number(`{c}`, 6), ',', '')" if t in ("double", "float")
                else f"CAST(`{c}` AS STRING)")

    def longify(df: DataFrame, section: str) -> DataFrame:
        cols = df.dtypes
        st = "stack({}, {})".format(len(cols), ", ".join(f"'{c}', {as_text(c, t)}" for c, t in cols))
        return df.selectExpr(f"'{section}' AS section", f"{st} AS (key, value)")
    cfg = dataset_info.sparkSession.createDataFrame([(k, str(v)) for k, v in config.items()], "key string, value string")
    shown = []
    if examples is not None:
        cols = [(c, t) for c, t in examples.dtypes if c != "example"]
        st = "stack({}, {})".format(len(cols), ", ".join(f"concat(example, '.{c}'), {as_text(c, t)}" for c, t in cols))
        shown = [examples.selectExpr("'examples' AS section", f"{st} AS (key, value)")]
    report = (longify(dataset_info, "dataset")
            .unionByName(cfg.select(F.lit("config").alias("section"), "key", "value"))
            .unionByName(longify(metrics, "metrics")))
    return report.unionByName(shown[0]) if shown else report
