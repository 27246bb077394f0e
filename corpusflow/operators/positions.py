"""Global row positions without a single-task window.

A plain ``row_number() OVER (ORDER BY k)`` moves every row into one task. Instead the
order key gets a coarse *bucket* that is monotone in the key and roughly uniform:

* hash order: the first hex digits of the md5 key (uniform by construction);
* numeric order (ids, sample counters, timestamps): ranges between approximate quantiles
  of the key (one partial aggregate).

Rows are numbered inside ``(group, bucket)`` windows (many parallel tasks), and a small
prefix sum over the per-bucket counts (at most ``groups x buckets`` rows, aggregated
map-side) gives each bucket its offset. Everything is a pure function of the data, so
re-running a lost task or changing the physical partitioning never changes a position.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import ensure_checkpoint_dir


def hash_key(seed, *cols) -> Column:
    """Deterministic shuffle key: ``md5('<seed>:<c1>:<c2>...')`` (hex, 32 chars)."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def position_by_hash(df: DataFrame, hash_col: str, tiebreak: list[str], name: str = "pos",
                     group_cols: list[str] | None = None, hex_digits: int = 4) -> DataFrame:
    """0-based position in order ``(hash_col, *tiebreak)``, restarting per ``group_cols``.

    ``hash_col`` must hold uniform hex strings (see :func:`hash_key`); its first
    ``hex_digits`` characters are the bucket (16**hex_digits buckets per group)."""
    group_cols = list(group_cols or [])
    b = "_cf_bucket"
    keyed = df.withColumn(b, F.substring(F.col(hash_col), 1, hex_digits))
    return _position_in_buckets(keyed, b, [hash_col] + list(tiebreak), name, group_cols)


def order_number(df: DataFrame, order_col: str) -> Column:
    """The order key as a double: numbers as they are, times as microseconds, dates as days."""
    kind = df.schema[order_col].dataType.typeName()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(order_col).cast("timestamp_ltz")).cast("double")
    return F.unix_date(order_col).cast("double") if kind == "date" else F.col(order_col).cast("double")


def value_bucket(df: DataFrame, order_col: str, buckets: int, name: str = "_cf_bucket") -> DataFrame:
    """Add a bucket of ``order_col`` in ``[0, buckets]`` that is monotone in the key.

    The bounds are approximate quantiles (one partial aggregate; a single row holding at most
    ``buckets`` numbers, broadcast), so an outlier does not collapse the buckets as equal widths
    would. A row finds its bucket in two steps of about sqrt(buckets) comparisons. Null keys go to
    bucket 0: they come first, as in an ascending sort."""
    key = order_number(df, order_col)
    step = max(1, int(buckets ** 0.5))
    shares = [(k + 1) / buckets for k in range(buckets - 1)]
    cuts = (df.agg(F.percentile_approx(key, shares, 10 * buckets).alias("_cf_q"))
            .select(F.coalesce(F.array_sort(F.array_distinct("_cf_q")), F.array().cast("array<double>")).alias("_cf_q"))
            .withColumn("_cf_top", F.expr(f"filter(_cf_q, (x, i) -> i % {step} = {step - 1})")))
    keyed = df.withColumn("_cf_k", key).crossJoin(F.broadcast(cuts))
    coarse = F.size(F.filter("_cf_top", lambda x: x < F.col("_cf_k"))) * step
    fine = F.size(F.filter(F.slice("_cf_q", coarse + 1, F.lit(step)), lambda x: x < F.col("_cf_k")))
    b = F.when(F.col("_cf_k").isNull(), F.lit(0)).otherwise(coarse + fine)
    return keyed.withColumn(name, b.cast("int")).drop("_cf_q", "_cf_top", "_cf_k")


def position_by_value(df: DataFrame, order_col: str, tiebreak: list[str], name: str = "pos",
                      group_cols: list[str] | None = None, buckets: int = 1024,
                      descending: bool = False) -> DataFrame:
    """0-based position in numeric order ``(order_col, *tiebreak)`` (quantile buckets)."""
    group_cols = list(group_cols or [])
    b = "_cf_bucket"
    keyed = value_bucket(df, order_col, buckets, b)
    if descending:
        keyed = keyed.withColumn(b, F.lit(buckets) - F.col(b))
    return _position_in_buckets(keyed, b, [order_col] + list(tiebreak), name, group_cols,
                                descending=descending)


def _position_in_buckets(keyed: DataFrame, b: str, order: list[str], name: str,
                         group_cols: list[str], descending: bool = False) -> DataFrame:
    counts = keyed.groupBy(*group_cols, b).agg(F.count(F.lit(1)).alias("_cf_n"))
    w_off = (Window.partitionBy(*group_cols).orderBy(b)
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*group_cols, b,
                            F.coalesce(F.sum("_cf_n").over(w_off), F.lit(0)).alias("_cf_off"))
    sort = [F.col(c).desc() for c in order] if descending else [F.col(c) for c in order]
    w_in = Window.partitionBy(*group_cols, b).orderBy(*sort)
    ranked = keyed.withColumn("_cf_rn", F.row_number().over(w_in))
    return (ranked.join(offsets, on=[*group_cols, b], how="inner")
            .withColumn(name, (F.col("_cf_off") + F.col("_cf_rn") - 1).cast("long"))
            .drop(b, "_cf_off", "_cf_rn"))


def position_by_sort(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """0-based position in the order of any columns: a sort over ranges of the whole key, so ties in its first
    column spread too; a row's place is that in its range plus the rows of the ranges before. The sorted rows are
    written to the checkpoint folder (pass narrow ones); the driver sees one number per range."""
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.orderBy(*order).withColumn("_cf_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_cf_at", 33)
    offsets, seen = [], 0
    for p, n in sorted(tuple(r) for r in ranged.groupBy(part.alias("p")).count().collect()):
        offsets.append((p, seen))
        seen += n
    first = df.sparkSession.createDataFrame(offsets, "_cf_p long, _cf_first long")
    return (ranged.withColumn("_cf_p", part).join(F.broadcast(first), "_cf_p")
            .withColumn(name, F.col("_cf_first") + F.col("_cf_at") - F.shiftleft("_cf_p", 33)).drop("_cf_p", "_cf_first", "_cf_at"))


PRIME = (1 << 31) - 1


def permutation_keys(n: int, seed: int, epoch: int = 0) -> list[tuple[int, int, int, int]]:
    """Keys of the rounds of :func:`permuted`: from md5, four numbers a round, three rounds per bit of ``n``."""
    out = []
    for r in range(max(8, 3 * max(1, n - 1).bit_length())):
        h = hashlib.md5(f"{seed}:{epoch}:{r}".encode()).hexdigest()
        out.append((int(h[:15], 16) % max(1, n), *(int(h[k:k + 7], 16) % (PRIME - 1) + 1 for k in (15, 19, 25))))
    return out


def permuted(pos: Column, n: int, seed: int, epoch: int = 0) -> Column:
    """A keyed permutation of 0 .. n-1 as an expression on one row: a shuffle without moving rows.

    Each round pairs x with k - x (mod n) and swaps the two or not, by a bit of a keyed hash of the larger one; so every round, and
    their sequence, is one to one on exactly n numbers. Null or a number outside the range gives null."""
    rounds = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("kabc", key, strict=True)]) for key in permutation_keys(n, seed, epoch)])

    def swap(x, key):
        y = F.pmod(key["k"] - x, F.lit(n).cast("long"))
        top = F.greatest(x, y)
        mixed = F.pmod(F.pmod(top, F.lit(PRIME)) * key["a"] + F.pmod(F.floor(top / F.lit(PRIME)), F.lit(PRIME)) * key["b"] + key["c"], F.lit(PRIME))
        bit = F.pmod(F.floor(F.pmod(mixed * mixed, F.lit(PRIME)) / F.lit(1 << 15)), F.lit(2))
        return F.when(bit == 1, y).otherwise(x)

    x = pos.cast("long")
    return F.when((x >= 0) & (x < n), F.aggregate(rounds, x, swap))


def running_agg(df: DataFrame, value_col: str, out: str, group_cols: list[str], order_col: str,
                tiebreak: list[str] = (), how: str = "max", exclusive: bool = True,
                buckets: int = 1024, first_out: str | None = None) -> DataFrame:
    """Running ``max``/``sum`` of ``value_col`` per group in ``(order_col, *tiebreak)`` order.

    ``exclusive`` -> over the rows strictly before the current one. Same bucket scheme as
    the positions: windows per ``(group, bucket)`` plus a prefix over bucket totals, so a
    group holding a third of the rows is still split over ``buckets`` tasks.

    ``df`` is evaluated twice: for the bounds of the buckets (its order column alone), and for the rows. The totals
    of the buckets are those of the rows inside their windows, so they share the rows' shuffle."""
    group_cols = list(group_cols)
    b = "_cf_bucket"
    keyed = value_bucket(df, order_col, buckets, b).repartition(*group_cols, b)     # rows, windows and totals lie by (group, bucket)
    agg = F.max if how == "max" else F.sum
    first_key = F.struct(*[F.col(c) for c in [order_col, *tiebreak]])
    per_bucket = keyed.groupBy(*group_cols, b).agg(agg(value_col).alias("_cf_bv"),
                                                   F.min_by(F.col(value_col), first_key).alias("_cf_bfirst"))
    w_prev = Window.partitionBy(*group_cols).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    extra = []
    if first_out:
        # value of the group's first row = first value of its lowest bucket
        w_all = Window.partitionBy(*group_cols).orderBy(b).rowsBetween(Window.unboundedPreceding,
                                                                       Window.unboundedFollowing)
        extra = [F.first("_cf_bfirst").over(w_all).alias(first_out)]
    prev = per_bucket.select(*group_cols, b, agg("_cf_bv").over(w_prev).alias("_cf_prev"), *extra)
    order = [F.col(order_col)] + [F.col(c) for c in tiebreak]
    hi = -1 if exclusive else 0
    w_in = Window.partitionBy(*group_cols, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, hi)
    inner = keyed.withColumn("_cf_in", agg(value_col).over(w_in))
    j = inner.join(prev, on=[*group_cols, b], how="inner")
    if how == "max":
        val = F.greatest(F.col("_cf_prev"), F.col("_cf_in"))  # greatest skips nulls
    else:
        val = F.coalesce(F.col("_cf_prev"), F.lit(0)) + F.coalesce(F.col("_cf_in"), F.lit(0))
    return j.withColumn(out, val).drop(b, "_cf_prev", "_cf_in")
