"""SimHash near-dedup: BK-trees over shards of fingerprints, then connected components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SLICE = 8192     # queries of one shard tree that a task answers


def fingerprint(text: bytes, k: int = 3) -> int:
    """64-bit SimHash of the word shingles (repeats count), XXH64 with seed 42."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    flat = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words])
    starts, ends = [0, *end[:-k].tolist()], (end[k - 1:] - 1).tolist()
    h = np.array([xxhash.xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts, ends, strict=True)], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo:lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str, text_col: str, k: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long, for each row."""
    common.bound_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, k) for t in common.texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long")


# ---- one shard ---------------------------------------------------------------------------------
def _distance(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def bk_tree(fps: np.ndarray):
    """A BK-tree as arrays: node k is a fingerprint; its children are keyed by distance to it.

    Returns (order, children): ``order`` has the index into ``fps`` of each node, ``children[k]``
    is a list of (distance, node). Built a node at a time on whole arrays.
    """
    order, children, todo = [], [], [(np.arange(len(fps)), None, 0)]
    while todo:
        rows, parent, d = todo.pop()
        node = len(order)
        order.append(rows[0])
        children.append([])
        if parent is not None:
            children[parent].append((d, node))
        if len(rows) > 1:
            dist = _distance(fps[rows[1:]], fps[rows[0]])
            for x in np.unique(dist).tolist():
                todo.append((rows[1:][dist == x], node, x))
    return order, children


def tree_links(fps: np.ndarray, queries: np.ndarray, radius: int):
    """Yield (node's index, indices of queries within ``radius``): all queries go down the tree together."""
    order, children = bk_tree(fps)
    todo = [(0, queries)]
    while todo:
        node, q = todo.pop()
        d = _distance(fps[q], fps[order[node]])
        hit = q[d <= radius]
        if len(hit):
            yield order[node], hit
        for x, child in children[node]:
            near = q[(d >= x - radius) & (d <= x + radius)]
            if len(near):
                todo.append((child, near))


def _roots(label: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := label[label], label):
        label = up
    return label


def shard_stars(fps: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Smallest index linked to each fingerprint of a shard through links of the queries."""
    label = np.arange(len(fps))
    pend: list = []
    size = 0

    def merge():
        nonlocal label, size
        a = np.concatenate([np.full(len(h), n) for n, h in pend]) if pend else np.zeros(0, int)
        b = np.concatenate([h for _, h in pend]) if pend else np.zeros(0, int)
        while True:
            la, lb = label[a], label[b]
            if np.array_equal(la, lb):
                break
            low = np.minimum(la, lb)
            np.minimum.at(label, la, low)
            np.minimum.at(label, lb, low)
            label = _roots(label)
        pend.clear()
        size = 0

    for n, hit in tree_links(fps, queries, radius):
        if len(hit) > 1 or hit[0] != n:
            pend.append((n, hit))
            size += len(hit)
            if size > 1 << 18:
                merge()
    merge()
    return label


def _links(fps: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within ``radius`` bits: stars, not all pairs.

    The 64 bits are cut in ``radius + 2`` blocks. Two fingerprints within the radius agree on at
    least two whole blocks, so a shard is a pair of blocks and its value, and linked fingerprints
    meet in a shard. Shards of one fingerprint end here. A shard's tree is sent to as many tasks as
    its queries fill slices, so that a large shard is spread.
    """
    n = radius + 2
    cut = [round(64 * i / n) for i in range(n + 1)]

    def block(i: int):
        width = cut[i + 1] - cut[i]
        return F.shiftrightunsigned("fp", cut[i]).bitwiseAND(F.lit((1 << width) - 1))

    keys = F.array(*[F.struct(F.lit(j).alias("s"), F.xxhash64(F.lit(j), block(a), block(b)).alias("v"))
                     for j, (a, b) in enumerate(combinations(range(n), 2))])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.s", "k.v")
    # written apart from the joins that follow, as are the tables of minima below: a hot key is then split there
    shared = keyed.groupBy("s", "v").agg(F.count("*").alias("n")).where("n > 1").checkpoint()
    rows = (keyed.join(shared, ["s", "v"])
            .withColumn("slices", F.ceil(F.col("n") / SLICE).cast("int"))
            .select("s", "v", "fp", "slices", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
            .select("s", "v", "slice", "fp", (F.pmod(F.xxhash64("fp"), F.col("slices")) == F.col("slice")).alias("q"))
            .repartition("s", "v", "slice").sortWithinPartitions("s", "v", "slice", "fp"))

    def run(batches):
        held: list = []

        def close():
            fp, q = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            held.clear()
            label = shard_stars(fp.view(np.uint64), np.flatnonzero(q), radius)
            at = np.flatnonzero(label != np.arange(len(label)))
            return fp[at], fp[label[at]]

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            s, v, sl, fp, q = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            new = np.flatnonzero((np.diff(s) != 0) | (np.diff(v) != 0) | (np.diff(sl) != 0)) + 1
            out = []
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(s)], strict=True):
                key = s[lo], v[lo], sl[lo]
                if held and key != last:
                    out.append(close())
                last = key
                held.append((fp[lo:hi], q[lo:hi]))
            if out:
                yield _edges(out)
        if held:
            yield _edges([close()])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _edges(parts):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[0] for p in parts])),
                                       pa.array(np.concatenate([p[1] for p in parts]))], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node connected to each node of the undirected ``edges`` (a, b).

    Alternating large-star and small-star steps, each a minimum per node and a join, until the edges
    are stars; the edges are written to the checkpoint folder once a round.
    """
    def step(e: DataFrame) -> DataFrame:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")).checkpoint()
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m")).checkpoint()
        near = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return near.unionAll(least.select("a", F.col("m").alias("b"))).distinct()

    def sign(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    was = sign(e)
    while was[0]:
        e = step(e).checkpoint()
        now = sign(e)
        if now == was:
            break
        was = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       radius: int = 2) -> DataFrame:
    """(``id_col``, fp, component_id) for each row of ``df``.

    Texts are lower-cased (A-Z) and cut in words at ASCII white space; shingles of ``shingle`` words
    (a shorter text is one shingle) vote for the bits. No words: fingerprint zero, linked like any
    other. ``component_id`` is the smallest id reachable through links of ``radius`` differing bits
    or fewer. Null text is empty; null ids take part but are no component's id unless it has no
    other; repeated rows stay; an empty table gives an empty result; other columns are not read.
    """
    rows = fingerprints(df, id_col, text_col, shingle).checkpoint()
    distinct = rows.groupBy("fp").agg(F.min("id").alias("low")).checkpoint()
    roots = components(_links(distinct.select("fp"), radius))
    label = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    best = label.groupBy("root").agg(F.min("low").alias("component_id")).checkpoint()
    named = label.join(best, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of ``df`` per component: that of the smallest id, and of the smallest fingerprint where rows share that id.

    A row goes only if a row that it is linked to stays: rows that share an id but are linked to nothing alike are
    different documents and both stay; equal fingerprints are copies, whatever their ids. Rows without an id
    come last in their component and stay if it has no other. Null texts are empty texts; columns pass untouched.

    Texts of ids that stand once are only joined with the ids that stay; fingerprints of texts are computed
    a second time just for ids that stand more than once, and for null ids.
    """
    ident, fp, many = common.fresh(df, "id", "fp", "many")
    rows = fingerprints(df, id_col, text_col, shingle).checkpoint()
    roots = components(_links(rows.select("fp").distinct().checkpoint(), radius))
    best = (rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "fp")).alias("low"))
            .join(roots.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
            .agg(F.min("low").alias("low")).select(F.col("low.id").alias(ident), F.col("low.fp").alias(fp)))
    often = rows.where("id is not null").groupBy(F.col("id").alias(ident)).count().where("count > 1").select(ident, F.lit(True).alias(many))
    keep = best.join(often, ident, "left").select(ident, fp, F.coalesce(F.col(many) | F.col(ident).isNull(), F.col(ident).isNull()).alias(many)).checkpoint()
    docs = df.withColumn(ident, F.col(id_col).cast("long"))
    once = docs.join(keep.where(~F.col(many)).select(ident), ident, "left_semi").select(*df.columns)
    again = docs.join(keep.where(F.col(many)).select(ident), ident, "left_semi").select(*df.columns)
    some = _with_fingerprint(again.unionAll(df.where(F.col(id_col).cast("long").isNull())), text_col, shingle, fp).withColumn(ident, F.col(id_col).cast("long"))
    left = keep.where(F.col(many)).select(F.col(ident).alias("id"), F.col(fp).alias("fp"))
    chosen = some.join(left, some[ident].eqNullSafe(left["id"]) & (some[fp] == left["fp"]), "left_semi").dropDuplicates([ident, fp])
    return once.unionAll(chosen.select(*df.columns))


def _with_fingerprint(df: DataFrame, text_col: str, k: int, name: str) -> DataFrame:
    def start():
        def step(b):
            fp = np.array([fingerprint(t, k) for t in common.texts(b.column(b.schema.get_field_index(text_col)))], np.uint64)
            return [pa.array(fp.view(np.int64))]
        return step

    return common.arrow_columns(df, start, f"{name} long")
