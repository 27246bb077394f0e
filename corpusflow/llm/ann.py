"""Approximate nearest neighbours by a permutation index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIVOTS = 256         # bounded sample of vectors that order the space
PREFIX = 64          # nearest pivots that represent a vector
RERANK = 0.2         # share of a block that is reranked exactly
BLOCK = 8192         # vectors in a block of the index
QUERIES = 4096       # queries in a block of queries


def permutation(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each vector by angle, nearest first."""
    s = -(x @ pivots.T)
    part = np.argpartition(s, prefix - 1, axis=1)[:, :prefix] if prefix < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(x), 1))
    return np.take_along_axis(part, np.argsort(np.take_along_axis(s, part, 1), axis=1, kind="stable"), 1)


def lift(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with a coordinate that gives all of them the squared length ``most``: angles to a query
    lifted by zero then order them as inner products do."""
    return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))])


class Postings:
    """Inverted files of one block: for each pivot the rows that hold it and its place in them."""

    def __init__(self, perm: np.ndarray, n_pivots: int):
        n, self.prefix = perm.shape
        self.n = n
        order = np.argsort(perm.ravel(), kind="stable")
        self.rows, self.places = np.divmod(order, self.prefix)
        self.at = np.searchsorted(perm.ravel()[order], np.arange(n_pivots + 1))

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """Footrule distance of a query to all rows; a pivot outside a prefix has place ``prefix``."""
        gain = np.zeros(self.n, np.int32)
        for place, p in enumerate(perm.tolist()):
            lo, hi = self.at[p], self.at[p + 1]
            # against both missing the other's pivot: (prefix - place) + (prefix - its place)
            gain[self.rows[lo:hi]] += (2 * self.prefix - place - self.places[lo:hi] - np.abs(place - self.places[lo:hi])).astype(np.int32)
        return self.prefix * (self.prefix + 1) - gain


def nearest_neighbours(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id",
                       vec_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX,
                       rerank: float = RERANK, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query, itself left out.

    Each vector is represented by its nearest pivots in order (pivots: a bounded sample by id hash);
    a further coordinate makes vectors of any length equally long, so near means a large inner product.
    Vectors are dealt by hash to blocks of the index and queries to blocks of queries; where two
    blocks meet, the vectors' pivots are posted in inverted files, the queries accumulate footrule
    distances over the files of their own pivots, and the nearest ``rerank`` share (ties: smaller
    id; no fewer than ``12 * k``) is scored exactly in double precision. The best of each block meet
    in one grouped ranking. No vector is outside the index, and no task holds more than two blocks.

    Vectors that are null, zero, empty, of another dimension than the most common one, or that hold
    null or non-finite values take no part, nor do null ids. Of rows that share an id, one counts.
    Ties in score go to the smaller id; fewer than ``k`` candidates give fewer rows.
    """
    spark = df.sparkSession

    def clean(d: DataFrame) -> DataFrame:
        v = F.col("v")
        return (d.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v"))
                .where(F.col("i").isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0)
                       & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))))

    rows = clean(df)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_distinct("i").alias("u"),
                                                        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, most = sizes[0]["d"], sizes[0]["u"], sizes[0]["most"]
    one = one_per_id(rows.where(F.size("v") == dim))
    asked = one_per_id(clean(queries).where(F.size("v") == dim))
    n_asked = asked.count()
    sample = one.orderBy(F.xxhash64("i"), "i").limit(pivots).collect()          # bounded by its parameter
    unit = lift(np.array([r["v"] for r in sample]), most)
    unit = spark.sparkContext.broadcast(unit / np.linalg.norm(unit, axis=1, keepdims=True))
    width = min(prefix, len(sample))
    blocks, qblocks = max(1, -(-n // block)), max(1, -(-n_asked // query_block))

    def spread(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    base = one.select(F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int").alias("b"), spread(qblocks).alias("q"), "i", "v")
    ask = asked.select(spread(blocks).alias("b"), F.pmod(F.xxhash64("i"), F.lit(qblocks)).cast("int").alias("q"), "i", "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if left.empty or right.empty:
            return empty
        left, right = left.sort_values("i"), right.sort_values("i")
        ids, x = left["i"].to_numpy(), np.stack(left["v"].to_numpy())
        qid, y = right["i"].to_numpy(), np.stack(right["v"].to_numpy())
        posts = Postings(permutation(lift(x, most), unit.value, width), len(unit.value))
        near = permutation(np.column_stack([y, np.zeros(len(y))]), unit.value, width)
        m = min(len(ids), max(12 * k, int(np.ceil(rerank * len(ids)))) + 1)      # one more: the query itself
        out = []
        for j in range(len(qid)):
            d = posts.footrule(near[j])
            # rows are in id order, so a stable pick prefers the smaller id among equals
            cut = np.partition(d, m - 1)[m - 1]
            sure = np.flatnonzero(d < cut)
            cand = np.concatenate([sure, np.flatnonzero(d == cut)[:m - len(sure)]])
            cand = cand[ids[cand] != qid[j]]
            s = exact(x[cand], y[j])
            top = np.lexsort((ids[cand], -s))[:k]
            out.append(pd.DataFrame({"query_id": qid[j], "vec_id": ids[cand][top], "score": s[top]}))
        return pd.concat(out) if out else empty

    found = base.groupBy("b", "q").cogroup(ask.groupBy("b", "q")).applyInPandas(search, "query_id long, vec_id long, score double")
    best = (found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("t"))
            .select("query_id", F.posexplode("t").alias("p", "t")))
    return best.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in component order (the same for any batch)."""
    s = np.zeros(len(x))
    for column, value in zip(np.ascontiguousarray(x.T), y, strict=True):
        s += column * value
    return s


def one_per_id(d: DataFrame) -> DataFrame:
    """One row for each id (of rows that share an id, the smallest vector)."""
    return d.groupBy("i").agg(F.min("v").alias("v"))
