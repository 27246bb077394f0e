"""Importance resampling towards a target distribution, over hashed word n-grams.

A batch's n-grams are interned in an open-addressed NumPy table: XXH64 keys, byte verification, one
bucket and one count per slot; every occurrence knows its slot, so gains are gathered by slot id.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpusflow.session import ensure_checkpoint_dir

from . import common

#: A-Z become a-z, other bytes up to 0x7F that are neither digit nor letter part words.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in SEPARATORS else b for b in range(256))
OCCURRENCES = 1 << 17       # n-grams of one table
PIECE = 1 << 22             # bytes of a text whose words are held at once
BINS = 256                  # score bins per power of two


def intern(grams: list[bytes], hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each occurrence, occurrence that owns each slot or -1) of an open-addressed table.

    All open occurrences probe at once: free slots are claimed (of several claims the last stands), then
    an occurrence stays where key and bytes equal the owner's and else goes one slot on.
    """
    h = np.fromiter(map(xxh64_intdigest, grams), np.uint64, len(grams)) if hashes is None else hashes
    size = 1 << max(4, (2 * len(grams)).bit_length())
    g = np.empty(len(grams), object)
    g[:] = grams
    owner, slot = np.full(size, -1, np.int64), np.empty(len(grams), np.int64)
    at, todo = (h & np.uint64(size - 1)).astype(np.int64), np.arange(len(grams))
    while todo.size:
        here = at[todo]
        free = owner[here] < 0
        owner[here[free]] = todo[free]
        own = owner[here]
        same = h[own] == h[todo]
        same[same] = (g[own[same]] == g[todo[same]]).astype(bool)
        slot[todo[same]] = here[same]
        todo = todo[~same]
        at[todo] = (at[todo] + 1) & (size - 1)
    return slot, owner


def pieces(text: bytes, most: int):
    """``text`` cut at separators into pieces of about ``most`` bytes."""
    at = 0
    while len(text) - at > most:
        cut = text.find(b" ", at + most)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def occurrences(texts: list[bytes], least: int, most: int, block: int = OCCURRENCES, piece: int = PIECE):
    """(n-grams, their texts' numbers, words seen per text number) in blocks of about ``block`` n-grams."""
    grams, doc, words = [], [], {}
    for k, t in enumerate(texts):
        tail = []
        words[k] = 0
        for part in pieces(t.translate(_FOLD), piece):
            w = part.split()
            words[k] += len(w)
            before = len(grams)
            for n in range(least, most + 1):
                if n == 1:
                    grams += w
                else:
                    run = tail[max(0, len(tail) - n + 1):] + w
                    grams += [b" ".join(run[i:i + n]) for i in range(len(run) - n + 1)]
            tail = (tail + w)[-(most - 1):] if most > 1 else []
            doc += [k] * (len(grams) - before)
            if len(grams) >= block:
                yield grams, doc, words
                grams, doc, words = [], [], {}
                words[k] = 0
    yield grams, doc, words


def _slot_buckets(grams, owner, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Taken slots and the bucket slot of every one of them."""
    taken = np.flatnonzero(owner >= 0)
    bucket = np.zeros(len(owner), np.int64)
    bucket[taken] = [crc32(grams[i]) % buckets for i in owner[taken]]
    return taken, bucket


def bucket_counts(df: DataFrame, text_col: str = "text", least: int = 1, most: int = 1, buckets: int = 10000) -> np.ndarray:
    """Occurrences of n-grams per bucket over all rows: ``buckets`` numbers, summed by Spark."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for grams, _, _ in occurrences(common.texts(b.column(0)), least, most):
                slot, owner = intern(grams)
                taken, bucket = _slot_buckets(grams, owner, buckets)
                np.add.at(total, bucket[taken], np.bincount(slot, minlength=len(owner))[taken])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    out = np.zeros(buckets, np.int64)
    for r in df.select(text_col).mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():   # at most ``buckets`` rows
        out[r["b"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) per bucket, in doubles."""
    width = float(len(source))
    up, down = float(source.sum()) + width, float(target.sum()) + width
    return np.array([math.floor(1000 * math.log((t + 1.0) * up / ((s + 1.0) * down))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(df: DataFrame, gains: np.ndarray, text_col: str = "text", least: int = 1, most: int = 1) -> DataFrame:
    """``df`` with ``n_words``, ``n_features`` and ``weight``, the sum of the gains of the features' buckets."""
    spark = df.sparkSession
    common.bound_batches(spark)
    held = spark.sparkContext.broadcast(gains)      # one number per bucket

    def start():
        gain = held.value

        def step(b):
            t = common.texts(b.column(b.schema.get_field_index(text_col)))
            n, f, w = (np.zeros(len(t), np.int64) for _ in range(3))
            for grams, doc, words in occurrences(t, least, most):
                for k, c in words.items():
                    n[k] += c
                if grams:
                    slot, owner = intern(grams)
                    _, bucket = _slot_buckets(grams, owner, len(gain))
                    np.add.at(w, doc, gain[bucket[slot]])
                    f += np.bincount(doc, minlength=len(t))
            return [pa.array(n), pa.array(f), pa.array(w)]
        return step

    return common.arrow_columns(df, start, "n_words long, n_features long, weight long")


def resampling_scores(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
                      least: int = 1, most: int = 1, buckets: int = 10000, seed: int = 2024, min_words: int = 20, percent: int = 10) -> DataFrame:
    """Per row of ``df``: its id, n_features, weight, score and rank (1, 2, ... for rows that are drawn, else null).

    Words are what separators leave of the text with A-Z lower-cased; features are runs of ``least`` to ``most``
    words. Drawn are floor(``percent`` * N / 100) rows of the N with at least ``min_words`` words: the
    highest scores (weight plus Gumbel noise of the id), ties to the smaller id, null ids last, equal rows in any order.
    Null or empty texts have no features and weigh 0; without rows there are none; without target texts every
    bucket's gain falls with its share in ``df``. Other columns of ``df`` take no part, whatever their names.

    Two scans of the texts: one for the counts of all rows, one for the weights. What follows moves ids and numbers
    only: a histogram over at most 33,000 score bins bounds the draw from below, and just the rows above that
    bound are sorted, by ranges of (score, id); a place is the row's place in its partition plus the partition's offset.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    common.bound_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    gains = bucket_gains(bucket_counts(docs, "text", least, most, buckets),
                         bucket_counts(target.select(F.col(target_text).alias("text")), "text", least, most, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    size = F.log2(F.abs("score").cast("double") + 1.0) * BINS
    bins = F.when(F.col("score") < 0, -F.ceil(size)).otherwise(F.floor(size))
    rows = (weigh(docs, gains, "text", least, most).drop("text").withColumn("score", F.col("weight") + noise)
            .withColumn("bin", F.when(F.col("n_words") >= min_words, bins)).checkpoint())     # numbers of each row, no texts
    count = {r["bin"]: r["count"] for r in rows.where("bin is not null").groupBy("bin").count().collect()}
    draw, cut = percent * sum(count.values()) // 100, None
    left = draw
    for b in sorted(count, reverse=True):
        if left <= 0:
            break
        cut, left = b, left - count[b]
    out = ["id", "n_features", "weight", "score"]
    if cut is None:
        return rows.select(*out, F.lit(None).cast("long").alias("rank")).withColumnRenamed("id", id_col)
    above = F.coalesce(F.col("bin") >= cut, F.lit(False))
    ordered = (rows.where(above).select(*out).orderBy(F.desc("score"), F.asc_nulls_last("id"), "weight", "n_features")
               .withColumn("at", F.monotonically_increasing_id()).checkpoint())
    part = F.shiftright("at", 33)
    counts = sorted((r["p"], r["count"]) for r in ordered.groupBy(part.alias("p")).count().collect())   # one row per partition
    offsets, seen = [], 0
    for p, n in counts:
        offsets.append((p, seen))
        seen += n
    first = F.broadcast(spark.createDataFrame(offsets, "p long, first long"))
    place = F.col("first") + F.col("at") - F.shiftleft(F.col("p"), 33) + 1
    drawn = (ordered.withColumn("p", part).join(first, "p").withColumn("rank", F.when(place <= draw, place)).select(*out, "rank"))
    return drawn.unionByName(rows.where(~above).select(*out, F.lit(None).cast("long").alias("rank"))).withColumnRenamed("id", id_col)
