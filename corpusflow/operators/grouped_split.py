"""Leakage-safe stratified split: rows that are copies of each other stay together.

Rows that share any of several keys (texts under two cleaners, a headline, ...) form a component; a component goes
to one split as a whole. Per stratum, components are dealt largest first to the split that lacks most rows, which keeps every
split within one component of its exact size. The order of dealing depends on sizes only, so it is computed on the
table of (stratum, size, how many components) and each component then reads its split off its place among its like.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.positions import hash_key
from corpusflow.operators.split import _effective_strata, allocate, cuts_of_quotas, held_out_fractions, stratum_key
from corpusflow.session import ensure_checkpoint_dir


def copy_components(df: DataFrame, keys: list, row_key: list[str]) -> DataFrame:
    """(*row_key, component, component_size): rows that share the value of any of ``keys`` (columns), directly or over others.

    A null value links nothing. ``component`` is the smallest hash of a row's key in it. Every value of a key points its
    rows to its smallest one, found by a map-side aggregate, so a value that a third of all rows share gives as many links
    as rows, not pairs; the links are contracted to stars in rounds, each written to the checkpoint folder.
    Rows are told apart by ``row_key``; repeated rows are one row.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cols = [F.xxhash64(F.lit(k), F.sha2(c.cast("string").cast("binary"), 256)) for k, c in enumerate(map(_column, keys))]
    told = [F.when(_column(c).isNotNull(), h) for c, h in zip(keys, cols, strict=True)]
    rows = df.select(*row_key, F.conv(F.substring(hash_key("row", *row_key), 1, 15), 16, 10).cast("long").alias("_cf_r"), *[t.alias(f"_cf_k{i}") for i, t in enumerate(told)])
    rows = rows.dropDuplicates(row_key).checkpoint()
    links = None
    for i in range(len(keys)):
        part = rows.where(f"_cf_k{i} is not null").select(F.col(f"_cf_k{i}").alias("v"), "_cf_r")
        low = part.groupBy("v").agg(F.min("_cf_r").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
        found = part.join(low, "v").where("_cf_r <> m").select(F.col("_cf_r").alias("a"), F.col("m").alias("b"))
        links = found if links is None else links.unionByName(found)
    roots = stars(links)
    named = rows.select(*row_key, "_cf_r").join(roots, rows["_cf_r"] == roots["a"], "left").select(*row_key, F.coalesce("b", "_cf_r").alias("component")).checkpoint()
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("component_size"))
    return named.join(sizes, "component").select(*row_key, "component", "component_size")


def _column(c):
    return F.col(c) if isinstance(c, str) else c


def stars(links: DataFrame) -> DataFrame:
    """(a, b): each linked node but the smallest of its component, and that smallest one.

    Rounds of two steps: every node links its larger neighbours to the smallest of all it knows, then its smaller ones.
    The number of rounds grows with the logarithm of the longest chain; a round that changes nothing ends it.
    """
    def down(e):
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    e, was = down(links).checkpoint(), None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == was or not now[0]:
            return e.select("a", "b")
        was = now
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        e = down(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))).checkpoint()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        e = down(e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))).checkpoint()


def deal(quotas: list[int], classes: list[tuple[int, int]]) -> list[list[int]]:
    """How many components of each (size, count), largest size first, go to each split: one after another to the split
    that lacks most rows (the first of equals). Whole classes at a time: of the falling numbers ``lack - k * size`` of all
    splits, a class takes its ``count`` largest."""
    lack, out = list(quotas), []
    for size, count in classes:
        low, high = min(lack) - size * (count + 1), max(lack)

        def above(t, size=size):
            return [max(0, (x - t) // size + 1) for x in lack]
        while low < high:                       # the largest bound that still leaves ``count`` numbers at or above it
            mid = (low + high + 1) // 2
            low, high = (mid, high) if sum(above(mid)) >= count else (low, mid - 1)
        take = above(low + 1)
        for j, n in enumerate(above(low)):
            if n > take[j] and sum(take) < count:
                take[j] += 1
        out.append(take)
        lack = [x - size * k for x, k in zip(lack, take, strict=True)]
    return out


def grouped_split(df: DataFrame, strata: list[str], splits: list[tuple[str, float]], keys: list, row_key: list[str], seed: int = 42,
                  on_rare: str = "pool", split_col: str = "split") -> DataFrame:
    """``df`` with ``split_col``, ``component`` and ``component_size``: an exact stratified split over whole components of copies.

    A component counts in the stratum of its smallest row. Per stratum the sizes of the splits are within the largest
    component of it of what :func:`stratified_split` gives; with no copies they are equal to it. Which component of a size goes where
    follows from seeded hashes, not from how rows are partitioned. Rows with equal ``row_key`` are one row of one split.
    """
    ensure_checkpoint_dir(df.sparkSession)
    names = [n for n, _ in splits]
    held = held_out_fractions([f for _, f in splits])
    comp = copy_components(df, keys, row_key).checkpoint()
    keyed = df.withColumn("_cf_s", stratum_key(*strata)).withColumn("_cf_p", F.col(strata[0]).cast("string")).select(*row_key, "_cf_s", "_cf_p").dropDuplicates(row_key)
    groups = (keyed.join(comp, row_key).groupBy("component").agg(F.first("component_size").alias("size"), F.min(F.struct(F.struct(*row_key).alias("k"), "_cf_s", "_cf_p")).alias("m"))
              .select("component", "size", F.col("m._cf_s").alias("stratum"), F.col("m._cf_p").alias("_cf_p")).checkpoint())
    counts = groups.groupBy("stratum", "_cf_p").agg(F.sum("size").alias("n"))
    mapping = _effective_strata(counts, on_rare).checkpoint()
    quotas = allocate(mapping.groupBy(F.col("_cf_eff").alias("stratum")).agg(F.sum("n").alias("n")), held, False, "error")
    groups = groups.join(mapping.select("stratum", "_cf_eff"), "stratum").withColumn(
        "class", F.concat_ws(":", F.col("size").cast("string"), "_cf_eff")).checkpoint()
    classes = groups.groupBy("class", F.col("_cf_eff").alias("stratum"), "size").agg(F.count(F.lit(1)).alias("n"))
    wanted = [f"q_{i}" for i in range(len(splits))]

    def place(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("size", ascending=False)
        took = deal([int(x) for x in g.iloc[0][wanted]], [(int(s), int(n)) for s, n in zip(g["size"], g["n"], strict=True)])
        return pd.DataFrame({"stratum": g["class"].tolist(), "n": g["n"].tolist(), **{q: [t[i] for t in took] for i, q in enumerate(wanted)}})

    # one row per distinct size of a stratum: at most the root of twice its rows
    plan = (classes.join(quotas.select("stratum", *wanted), "stratum").groupBy("stratum")
            .applyInPandas(place, "stratum string, n long, " + ", ".join(f"{q} long" for q in wanted)))
    keyed = groups.select(F.col("class").alias("stratum"), "component").withColumn("_cf_h", hash_key(seed, "component"))
    dealt = cuts_of_quotas(keyed, plan, ["component"], names, split_col).select("component", split_col)
    return df.join(comp.join(dealt, "component"), row_key)


def cross_split_copies(df: DataFrame, keys: list, split_col: str = "split") -> DataFrame:
    """(key, n_values, n_rows): per key, values that stand in more than one split, and the rows that have them."""
    parts = None
    for k, c in enumerate(map(_column, keys)):
        v = (df.where(c.isNotNull()).groupBy(F.sha2(c.cast("string").cast("binary"), 256).alias("v"))
             .agg(F.min(split_col).alias("a"), F.max(split_col).alias("b"), F.count(F.lit(1)).alias("n"))
             .agg(F.count_if(F.expr("a <> b")).alias("n_values"), F.coalesce(F.sum(F.expr("if(a <> b, n, 0)")), F.lit(0)).alias("n_rows")))
        v = v.select(F.lit(k).alias("key"), "n_values", "n_rows")
        parts = v if parts is None else parts.unionByName(v)
    return parts
