"""Filters, union, de-duplication and profile aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import clean_text_a, clean_text_b, py_strip

CANONICAL = ["text", "label", "domain", "language"]
ORDER_KEYS = ["dataset_rank", "row_idx"]


def drop_incomplete(df: DataFrame, cols=CANONICAL) -> DataFrame:
    """drop rows with a null in any canonical column."""
    return df.na.drop(subset=list(cols))


def drop_blank(df: DataFrame, col: str = "text") -> DataFrame:
    """drop null text and text that is empty after ``str.strip()``."""
    return df.where(F.col(col).isNotNull() & (F.length(py_strip(col)) > 0))


def min_length(df: DataFrame, n: int = 10, col: str = "text") -> DataFrame:
    """keep text longer than ``n`` code points (strict)."""
    return df.where(F.length(col) > n)


def clean(df: DataFrame, cleaner: str = "a", col: str = "text") -> DataFrame:
    """Apply cleaner A (P13) or B (P14) in place."""
    fn = clean_text_a if cleaner == "a" else clean_text_b
    return df.withColumn(col, fn(col))


def union_sources(dfs: list[DataFrame]) -> DataFrame:
    """Union all by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def dedupe_first(df: DataFrame, key: str = "text", order=ORDER_KEYS,
                 narrow: bool = False) -> DataFrame:
    """Keep the first row per ``key`` in ``order`` (pandas ``keep='first'``).

    One shuffle keyed on sha-256 of the text (32 bytes instead of the whole text as the
    key); ``min_by`` over a struct of the order keys is combined map-side, so copies
    inside one partition never cross the network and a hot text costs one row per
    partition, not one task holding all copies.

    ``narrow=True`` (order keys unique, as those of ``load_corpus`` are): aggregate only ``(hash, order keys)``
    and keep the winners with a semi join on the order keys. Integer order keys are packed into one number, so the aggregate
    is a hash aggregate and rows are neither sorted nor carried through it: they are shuffled once. The input is
    evaluated twice; rows that share an order key and a text would both stay."""
    if narrow:
        whole = all(df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in order)
        place = _packed(order) if whole and len(order) <= 2 else F.struct(*[F.col(c) for c in order])
        keys = df.select(F.unhex(F.sha2(F.col(key), 256)).alias("_cf_key"), place.alias("_cf_at"))
        winners = keys.groupBy("_cf_key").agg(F.min("_cf_at").alias("_cf_at")).select("_cf_at").hint("shuffle_hash")
        return df.withColumn("_cf_at", place).join(winners, "_cf_at", "left_semi").drop("_cf_at")
    cols = df.columns
    k = "_cf_key"
    keyed = df.withColumn(k, F.unhex(F.sha2(F.col(key), 256)))
    best = keyed.groupBy(k).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order])).alias("_cf_row"))
    return best.select("_cf_row.*")


def _packed(order):
    """One or two integer columns as one number in the same order; nulls come last."""
    top = F.lit(str(1 << 63)).cast("decimal(38,0)")
    parts = [F.coalesce(F.col(c).cast("decimal(38,0)"), top) for c in order]
    return (parts[0] if len(parts) == 1 else parts[0] * F.lit(str(1 << 64)).cast("decimal(20,0)") + parts[1]).cast("decimal(38,0)")


def distribution(df: DataFrame, cols=("label", "language", "dataset")) -> DataFrame:
    """A1: value counts of several columns in one pass -> (column, value, n)."""
    cols = list(cols)
    g = df.groupingSets([[c] for c in cols], *cols).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in cols])
    which = None
    for c in cols:
        cond = F.col(f"_g_{c}") == 0
        which = (F.when(cond, F.lit(c)) if which is None else which.when(cond, F.lit(c)))
    val = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.col(c).cast("string")) for c in cols])
    return g.select(which.alias("column"), val.alias("value"), F.col("n"))


def source_report(df: DataFrame) -> DataFrame:
    """A2: rows per source (before de-duplication)."""
    return (df.groupBy("dataset_rank", "dataset")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label") == 1).alias("n_fake")))


def dataset_info(df: DataFrame, languages=("en", "fr", "de", "es"), split_col: str | None = "split") -> DataFrame:
    """One wide row of totals, per-language, per-class and per-split counts; ``n_other``
    counts the rows of no listed language."""
    aggs = [F.count(F.lit(1)).alias("total")]
    for lang in languages:
        aggs.append(F.count_if(F.col("language") == lang).alias(f"n_{lang}"))
    aggs.append(F.count_if(~F.coalesce(F.col("language").isin(*languages), F.lit(False))).alias("n_other"))
    aggs += [F.count_if(F.col("label") == 1).alias("n_fake"),
             F.count_if(F.col("label") == 0).alias("n_true")]
    if split_col:
        for s in ("train", "val", "test"):
            aggs.append(F.count_if(F.col(split_col) == s).alias(f"n_{s}"))
    out = df.agg(*aggs)
    shares = [F.round(F.lit(100.0) * F.col(f"n_{x}") / F.col("total"), 1).alias(f"pct_{x}")
              for x in ["fake", "true"]]
    return out.select("*", *shares)
