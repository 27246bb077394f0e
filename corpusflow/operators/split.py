"""Shuffles, exact stratified splits, batches and split reports.

Exact allocation follows the public behaviour of stratified shuffle splitting: the held-out
part gets ``ceil(frac * n)`` rows, the kept part ``n - that``; per-stratum quotas are the
floors of the proportional shares plus one for the largest remainders. Remainders are
compared as exact integers and ties go to the smaller stratum name (the public version
draws ties at random). The quota table has one row per stratum; rows are ordered inside a
stratum by a seeded md5 key, and a row's split follows from comparing its key with the
stratum's cut keys.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.operators.positions import hash_key, permuted, position_by_hash, position_by_sort
from corpusflow.session import broadcast_checked, ensure_checkpoint_dir

STRATA = 50_000   # rows of a strata table that one task ranks
HEX_DIGITS = 3    # hash buckets of a stratum: 16 ** 3; only the buckets that hold a cut are ranked


def stratum_key(*cols) -> Column:
    """Composite stratum ``a_b`` of the string forms."""
    return F.concat_ws("_", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


def _idiv(x: Column, d) -> Column:
    """Exact floor division of a non-negative integer column (decimal, no float)."""
    return F.floor(x.cast("decimal(38,0)") / (d if isinstance(d, Column) else F.lit(d))
                   .cast("decimal(38,0)")).cast("long")


def _ceil_frac(n: Column, frac, float_compat: bool) -> Column:
    if float_compat:
        return F.ceil(n.cast("double") * F.lit(float(frac))).cast("long")
    fr = Fraction(str(frac)) if not isinstance(frac, Fraction) else frac
    return _idiv(n.cast("decimal(24,0)") * F.lit(fr.numerator).cast("decimal(12,0)") + F.lit(fr.denominator - 1), fr.denominator)


def _with_totals(q: DataFrame, **sums: str) -> DataFrame:
    """``q`` with the total of a column each: one row, summed map-side and sent to every task."""
    return q.crossJoin(F.broadcast(q.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()])))


def _approx_mode(q: DataFrame, count_col: str, draws_col: str, out: str, one_task: bool) -> DataFrame:
    """Largest-remainder allocation of ``draws`` over strata proportional to counts.

    The strata are ranked by remainder: in one task when they are few, else by a sort over ranges of (remainder, name)."""
    share = F.col(count_col).cast("decimal(19,0)") * F.col(draws_col).cast("decimal(19,0)")   # exceeds a long
    q = _with_totals(q, _cf_tot=count_col)
    some = F.col("_cf_tot") > 0
    q = (q.withColumn("_cf_fl", F.when(some, _idiv(share, F.col("_cf_tot"))).otherwise(F.lit(0)).cast("long"))
         .withColumn("_cf_rem", F.when(some, F.pmod(share, F.col("_cf_tot").cast("decimal(38,0)"))).otherwise(F.lit(0)).cast("long")))
    if one_task:
        q = _with_totals(q, _cf_all=("_cf_fl")).withColumn("_cf_rk", F.row_number().over(Window.orderBy(F.col("_cf_rem").desc(), F.col("stratum"))) - 1)
    else:
        q = q.checkpoint()              # read for the ranges, the ranks and the total
        q = _with_totals(position_by_sort(q, [F.col("_cf_rem").desc(), F.col("stratum")], "_cf_rk"), _cf_all="_cf_fl")
    need = F.col(draws_col) - F.col("_cf_all")
    q = q.withColumn(out, (F.col("_cf_fl") + F.when(F.col("_cf_rk") < need, 1).otherwise(0)).cast("long"))
    return q.drop("_cf_tot", "_cf_fl", "_cf_rem", "_cf_all", "_cf_rk")


def allocate(counts: DataFrame, held_out: list, float_compat: bool = False,
             on_rare: str = "error", one_task: int = STRATA) -> DataFrame:
    """Quota table ``(stratum, n, q_0, q_1, ...)`` from ``(stratum, n)``.

    ``held_out`` are the held-out fractions of each successive two-way split, e.g.
    ``[0.3, 2/3]`` for 70/10/20 done as (train | rest) then (val | test). Up to ``one_task`` strata are ranked in
    one task, more of them in as many as their table takes; the quotas are the same."""
    q = counts.checkpoint()
    avail, few = "n", q.limit(one_task + 1).count() <= one_task
    if on_rare == "error":
        q = q.crossJoin(F.broadcast(q.agg(F.min("n").alias("_cf_min")))).withColumn(
            avail, F.when(F.col("_cf_min") < 2, F.raise_error(F.lit(
                "The least populated stratum has only 1 member; stratified split needs 2")).cast("long")).otherwise(F.col("n"))).drop("_cf_min")
    for i, frac in enumerate(held_out):
        q = _with_totals(q, _cf_sum=avail)
        q = q.withColumn("_cf_keep", F.col("_cf_sum") - _ceil_frac(F.col("_cf_sum"), frac, float_compat)).drop("_cf_sum")
        q = _approx_mode(q, avail, "_cf_keep", f"q_{i}", few)
        nxt = f"_cf_avail_{i}"
        q = q.withColumn(nxt, F.col(avail) - F.col(f"q_{i}")).drop("_cf_keep")
        avail = nxt
    q = q.withColumn(f"q_{len(held_out)}", F.col(avail))
    return q.drop(*[c for c in q.columns if c.startswith("_cf_avail_")])


def held_out_fractions(fracs: list, float_compat: bool = False) -> list:
    """Held-out fraction of each successive two-way split.

    Exact (``Fraction``) by default; ``float_compat`` reproduces the float sums
    (``0.2 + 0.1 = 0.30000000000000004``) that over-allocate when 0.3 n is whole."""
    held = []
    for i in range(len(fracs) - 1):
        if float_compat:
            rest = float(fracs[-1])
            for x in reversed(fracs[i + 1:-1]):
                rest = rest + float(x)
            held.append(rest if i == 0 else rest / (float(fracs[i]) + rest))
        else:
            fr = [Fraction(str(x)) for x in fracs]
            held.append(sum(fr[i + 1:], Fraction(0)) / sum(fr[i:], Fraction(0)))
    return held


def stratified_split(df: DataFrame, strata: list[str], splits: list[tuple[str, float]],
                     seed: int = 42, row_key: list[str] | None = None, float_compat: bool = False,
                     on_rare: str = "error", split_col: str = "split") -> DataFrame:
    """Exact stratified split into ``splits`` (name, fraction) in order.

    Done as successive two-way splits like the reference: first split keeps
    ``splits[0]`` and holds out the rest, the next splits the held-out part, etc.

    Rows are labelled by comparison with one cut key per stratum and split, so the rows
    themselves are never shuffled for it. Narrow keys (stratum, hash, ``row_key``) are written
    once to the checkpoint folder; a histogram of (stratum, hash bucket) finds the bucket of each
    cut, and only those buckets are ranked. ``row_key`` must be unique for exact sizes: rows
    that share a key stay together. An empty table gives an empty result."""
    row_key = list(row_key or ["dataset_rank", "row_idx"])
    ensure_checkpoint_dir(df.sparkSession)
    held = held_out_fractions([f for _, f in splits], float_compat)
    keyed = df.withColumn("stratum", stratum_key(*strata)).withColumn("_cf_h", hash_key(seed, *row_key))
    keys = keyed.select("stratum", F.col(strata[0]).cast("string").alias("_cf_p"),
                        F.struct("_cf_h", *row_key).alias("_cf_key"),
                        F.substring("_cf_h", 1, HEX_DIGITS).alias("_cf_b")).checkpoint()
    hist = keys.groupBy("stratum", "_cf_p", "_cf_b").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    mapping = _effective_strata(hist.groupBy("stratum", "_cf_p").agg(F.sum("n").alias("n")), on_rare).checkpoint()
    counts = mapping.groupBy(F.col("_cf_eff").alias("stratum")).agg(F.sum("n").alias("n"))
    quotas = allocate(counts, held, float_compat, "error")
    cuts = _cut_keys(keys, hist, mapping.select("stratum", "_cf_eff"), quotas, len(splits))
    return _by_cuts(keyed, cuts, row_key, [n for n, _ in splits], split_col).select(*df.columns, split_col)


def _by_cuts(keyed: DataFrame, cuts: DataFrame, row_key: list[str], names: list[str], split_col: str) -> DataFrame:
    out, expr = keyed.join(broadcast_checked(cuts), "stratum"), None
    for i, name in enumerate(names):
        cond = F.col(f"_cf_all_{i}") | (F.struct("_cf_h", *row_key) < F.col(f"_cf_cut_{i}"))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return out.withColumn(split_col, expr)


def cuts_of_quotas(keyed: DataFrame, quotas: DataFrame, row_key: list[str], names: list[str], split_col: str = "split") -> DataFrame:
    """``keyed`` (``stratum``, ``_cf_h``, ``row_key``, ...) with the split that given quotas ``(stratum, n, q_0, ...)`` deal to it:
    of a stratum's rows, by hash, the first q_0 get the first name, and so on."""
    keys = keyed.select("stratum", F.struct("_cf_h", *row_key).alias("_cf_key"), F.substring("_cf_h", 1, HEX_DIGITS).alias("_cf_b")).checkpoint()
    hist = keys.groupBy("stratum", "_cf_b").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    mapping = hist.select("stratum", F.col("stratum").alias("_cf_eff")).distinct().checkpoint()
    return _by_cuts(keyed, _cut_keys(keys, hist, mapping, quotas, len(names)), row_key, names, split_col)


def _effective_strata(counts: DataFrame, on_rare: str) -> DataFrame:
    """(stratum, n, _cf_eff) from (stratum, _cf_p, n), a row per stratum. ``pool``: strata with
    < 2 rows fold into ``<first key>_other``; a pooled group still below 2 folds into the largest
    stratum with the same first key (ties: smaller name)."""
    # a stratum's name may come from several first keys (or a null one): the smallest stands for it
    counts = counts.groupBy("stratum").agg(F.sum("n").alias("n"), F.coalesce(F.min("_cf_p"), F.lit("")).alias("_cf_p"))
    if on_rare != "pool":
        return counts.select("stratum", "n", F.col("stratum").alias("_cf_eff"))
    lvl1 = counts.withColumn("_cf_e1", F.when(F.col("n") < 2, F.concat(F.col("_cf_p"), F.lit("_other")))
                             .otherwise(F.col("stratum")))
    g1 = lvl1.groupBy("_cf_e1", "_cf_p").agg(F.sum("n").alias("n1"))
    big = (g1.where(F.col("n1") >= 2)
           .withColumn("_cf_rk", F.row_number().over(
               Window.partitionBy("_cf_p").orderBy(F.col("n1").desc(), F.col("_cf_e1"))))
           .where(F.col("_cf_rk") == 1).select("_cf_p", F.col("_cf_e1").alias("_cf_big")))
    g2 = (g1.join(big, "_cf_p", "left")
          .withColumn("_cf_eff", F.when((F.col("n1") < 2) & F.col("_cf_big").isNotNull(), F.col("_cf_big"))
                      .otherwise(F.col("_cf_e1"))))
    return lvl1.join(g2.select("_cf_e1", "_cf_p", "_cf_eff"), ["_cf_e1", "_cf_p"]).select("stratum", "n", "_cf_eff")


def _cut_keys(keys: DataFrame, hist: DataFrame, mapping: DataFrame, quotas: DataFrame, n_splits: int) -> DataFrame:
    """(stratum, _cf_all_i, _cf_cut_i ...): the first key beyond the i-th split, or that there is none."""
    ends, cum = [], F.lit(0)
    for i in range(n_splits):
        cum = cum + F.col(f"q_{i}")
        ends.append(cum.cast("long").alias(f"_cf_end_{i}"))
    ends = quotas.select(F.col("stratum").alias("_cf_eff"), "n", *ends).checkpoint()
    w = Window.partitionBy("_cf_eff").orderBy("_cf_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = (hist.join(mapping, "stratum").groupBy("_cf_eff", "_cf_b").agg(F.sum("n").alias("_cf_n"))
               .withColumn("_cf_to", F.sum("_cf_n").over(w)).withColumn("_cf_off", F.col("_cf_to") - F.col("_cf_n"))
               .join(ends.drop("n"), "_cf_eff"))
    inside = [(F.col(f"_cf_end_{i}") >= F.col("_cf_off")) & (F.col(f"_cf_end_{i}") < F.col("_cf_to")) for i in range(n_splits)]
    # at most a bucket per stratum and cut
    edge = buckets.where(F.greatest(*inside)).join(mapping, "_cf_eff").checkpoint()
    ranked = (keys.join(broadcast_checked(edge), ["stratum", "_cf_b"])
              .withColumn("_cf_r", F.row_number().over(Window.partitionBy("_cf_eff", "_cf_b").orderBy("_cf_key")) - 1 + F.col("_cf_off")))
    found = ranked.groupBy("_cf_eff").agg(*[F.min(F.when(F.col("_cf_r") == F.col(f"_cf_end_{i}"), F.col("_cf_key"))).alias(f"_cf_cut_{i}")
                                            for i in range(n_splits)])
    return (mapping.join(ends, "_cf_eff").join(found, "_cf_eff", "left")
            .select("stratum", *[(F.col(f"_cf_end_{i}") >= F.col("n")).alias(f"_cf_all_{i}") for i in range(n_splits)],
                    *[f"_cf_cut_{i}" for i in range(n_splits)]).checkpoint())


def shuffle_rows(df: DataFrame, seed: int = 42, row_key: list[str] | None = None,
                 name: str = "pos") -> DataFrame:
    """Seeded full shuffle; ``pos`` = 0-based position in md5 order."""
    row_key = list(row_key or ["dataset_rank", "row_idx"])
    keyed = df.withColumn("_cf_h", hash_key(seed, *row_key))
    return position_by_hash(keyed, "_cf_h", row_key, name=name).drop("_cf_h")


def sequential_split(df: DataFrame, frac=0.8, pos_col: str = "pos", split_col: str = "split",
                     names=("train", "val"), counted: DataFrame | None = None) -> DataFrame:
    """The first ``int(frac * n)`` positions are train, the rest val. ``counted``: a table
    of the same rows that is cheaper to count than ``df`` (what was shuffled)."""
    fr = Fraction(str(frac))
    n = (df if counted is None else counted).agg(F.count(F.lit(1)).alias("_cf_n"))
    cut = F.floor(F.col("_cf_n") * F.lit(fr.numerator) / F.lit(fr.denominator))
    return (df.crossJoin(F.broadcast(n))  # one row
            .withColumn(split_col, F.when(F.col(pos_col) < cut, F.lit(names[0])).otherwise(F.lit(names[1])))
            .drop("_cf_n"))


def assign_batches(df: DataFrame, size: int = 16, order: str = "row_idx", tiebreak=(),
                   seed: int | None = None, epoch: int = 0) -> DataFrame:
    """``batch_id = position div size``. ``seed`` given: shuffled order, reshuffled
    per epoch (seed + epoch); else the order of ``order`` (evaluation)."""
    if seed is not None:
        keyed = df.withColumn("_cf_h", hash_key(seed + epoch, order, *tiebreak))
        pos = position_by_hash(keyed, "_cf_h", [order, *tiebreak], name="_cf_pos").drop("_cf_h")
    else:
        from corpusflow.operators.positions import position_by_value
        pos = position_by_value(df, order, list(tiebreak), name="_cf_pos")
    return (pos.withColumn("epoch", F.lit(epoch))
            .withColumn("batch_id", F.floor(F.col("_cf_pos") / F.lit(size)).cast("long"))
            .withColumnRenamed("_cf_pos", "position"))


def permuted_batches(df: DataFrame, n: int, size: int = 16, pos_col: str = "position", seed: int = 42, epoch: int = 0) -> DataFrame:
    """X8 without moving a row: ``df`` with ``epoch``, ``position`` and ``batch_id`` of a shuffled epoch, from positions
    0 .. ``n`` - 1 numbered once in ``pos_col``. Every epoch is another permutation, and a projection of the same table."""
    place = permuted(F.col(pos_col), n, seed, epoch)
    return (df.withColumn("position", place).withColumn("epoch", F.lit(epoch))
            .withColumn("batch_id", F.floor(F.col("position") / F.lit(size)).cast("long")))


def split_report(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows and share per split."""
    g = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy())
    return g.select(F.col(split_col).alias("split"), "n", F.round(F.lit(100.0) * F.col("n") / tot, 1).alias("pct"))


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Last ``n`` rows in ``order`` (top-k, no global sort)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
