"""Line dedup: once/twice Bloom filters screen the line keys, suspected repeats alone are confirmed exactly."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SLICES = 64          # least number of filter slices; a task builds one or more, each on its own
SLICE_BITS = 1 << 25                    # largest slice of the once-seen filter: 4 MB in a task
PROBES = 4
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28   # bits of the twice-seen filter: at most 32 MB are broadcast
BITS_PER_LINE = 16


def _key(line: bytes) -> bytes:
    """Strip ASCII white space at both ends, lower-case A-Z (both are what bytes methods do)."""
    return line.strip().lower()


def _long(key: bytes, n: int) -> bool:
    return len(key) >= n and (key.isascii() or len(key.decode("utf-8", "replace")) >= n)


def _keys(text: bytes, n: int) -> set[bytes]:
    return {k for k in map(_key, text.split(b"\n")) if len(k) >= n and _long(k, n)}


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), dtype=np.uint64)


def _probes(h: np.ndarray, bits: int):
    """Bit positions inside a filter slice of ``bits`` bits (a power of two), double hashing on 64 bits."""
    a = h & np.uint64(0xFFFFFFFF)
    b = (h >> np.uint64(26)) | np.uint64(1)
    for i in range(PROBES):
        yield (a + np.uint64(i) * b) & np.uint64(bits - 1)


def _slice(h: np.ndarray, slices: int) -> np.ndarray:
    return (h >> np.uint64(65 - slices.bit_length())).astype(np.int64)      # the top bits; a power of two of slices


def _has(flat: np.ndarray, h: np.ndarray, bits: int, base=0) -> np.ndarray:
    hit = np.ones(len(h), dtype=bool)
    for p in _probes(h, bits):
        q = p.astype(np.int64) + base
        hit &= (flat[q >> 3] >> (q & 7).astype(np.uint8)) & 1 == 1
    return hit


def _set(flat: np.ndarray, h: np.ndarray, bits: int) -> None:
    for p in _probes(h, bits):
        q = p.astype(np.int64)
        np.bitwise_or.at(flat, q >> 3, np.left_shift(1, q & 7).astype(np.uint8))


def _sizes(n: int) -> tuple[int, int, int]:
    """(slices, bits of the once-seen filter, bits of the twice-seen filter) for ``n`` hashes.

    The once-seen filter stays in the tasks, a slice each, and grows with the corpus; the twice-seen
    one holds repeated hashes only and is bounded, as it is broadcast.
    """
    once = MIN_BITS
    while once < n * BITS_PER_LINE:
        once <<= 1
    return max(SLICES, once // SLICE_BITS), once, min(once, MAX_BITS)


def _twice_filter(lines: DataFrame, slices: int, once_bits: int, twice_bits: int) -> np.ndarray:
    """The filter of hashes seen at least twice: ``slices`` pieces of equal size, as bytes.

    Each hash goes to the task that owns its slice. The task streams its hashes through a once-seen
    filter; a hash that it already holds enters the twice-seen filter. Memory is a task's slices.
    """
    own, out_own = once_bits // slices, twice_bits // slices

    def build(batches):
        once, twice = {}, {}
        for b in batches:
            h = np.asarray(b.column(0)).view(np.uint64)
            s = _slice(h, slices)
            for k in np.unique(s).tolist():
                if k not in once:
                    once[k], twice[k] = np.zeros(own // 8, np.uint8), np.zeros(out_own // 8, np.uint8)
                u, n = np.unique(h[s == k], return_counts=True)
                again = (n > 1) | _has(once[k], u, own)
                _set(twice[k], u[again], out_own)
                _set(once[k], u[~again], own)
        if once:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(twice), pa.int32()), pa.array([t.tobytes() for t in twice.values()], pa.binary())],
                names=["s", "bits"])

    top = F.shiftrightunsigned(F.col("h"), 65 - slices.bit_length())
    out = np.zeros((slices, out_own // 8), np.uint8)
    for row in lines.repartition(slices, top).mapInArrow(build, "s int, bits binary").collect():     # the bounded filter
        out[row["s"]] |= np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
               min_docs: int = 5) -> DataFrame:
    """Drop boilerplate lines from whole texts.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of at
    least ``min_chars`` code points found in at least ``min_docs`` documents keeps its lines in the
    largest id that holds it and loses them everywhere else. Returns ``df`` with ``text_col``
    replaced by the kept lines, ``n_lines`` (before) and ``n_dropped``.

    Two filters decide what moves. Hashes of long keys (8 bytes, once a document) are dealt to filter
    slices and streamed through a once-seen and a twice-seen filter. The once-seen one grows with the
    corpus, a slice in each task; the twice-seen one (repeated hashes only, at most 32 MB) is
    broadcast, and only keys that it holds shuffle, as SHA-256 digests, to be counted
    exactly. A false positive costs one extra digest and never changes the result. With more repeated
    keys than the broadcast bound holds, the filter fills up and more digests move; the result stays.

    Null or empty text is one empty line; a null id counts as one document below all others, rows
    that share an id are one document; an empty table gives an empty result; a column named
    ``n_lines`` or ``n_dropped`` is replaced.
    """
    spark = df.sparkSession
    common.bound_batches(spark)
    cid, cdrop = common.fresh(df, "id", "drop")
    low = -(1 << 63)
    slim = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("id"), F.col(text_col).alias("text"))

    def hashes(batches):
        for b in batches:
            parts = [_hashes(_keys(t, min_chars)) for t in common.texts(b.column(0))]
            h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    lines = slim.select("text").mapInArrow(hashes, "h long").checkpoint()      # 8 bytes a line, counted and dealt
    # the filters are sized from a count of the hashes
    slices, once_bits, twice_bits = _sizes(lines.count())
    own = twice_bits // slices
    twice = spark.sparkContext.broadcast(_twice_filter(lines, slices, once_bits, twice_bits).tobytes())

    def suspects(batches):
        flat = np.frombuffer(twice.value, np.uint8)
        for b in batches:
            ids, digests = [], []
            for i, t in zip(b.column(0).to_pylist(), common.texts(b.column(1)), strict=True):
                if keys := list(_keys(t, min_chars)):
                    h = _hashes(keys)
                    for k in np.flatnonzero(_has(flat, h, own, _slice(h, slices) * own)).tolist():
                        ids.append(i)
                        digests.append(hashlib.sha256(keys[k]).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())],
                                             names=["id", "key"])

    found = slim.mapInArrow(suspects, "id long, key binary").checkpoint()
    repeated = (found.groupBy("key").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keep"))
                .where(F.col("n") >= min_docs).select("key", "keep").checkpoint())   # apart from the join, so that a hot key is split there
    drops = (found.join(repeated, "key").where(F.col("id") != F.col("keep"))
             .groupBy(F.col("id").alias(cid)).agg(F.collect_set("key").alias(cdrop)))
    joined = (df.withColumn(cid, F.coalesce(F.col(id_col).cast("long"), F.lit(low)))
              .join(drops, cid, "left"))

    def strip():
        def step(b):
            out, n_lines, n_drop = [], [], []
            drop = b.column(b.schema.get_field_index(cdrop)).to_pylist()
            for t, d in zip(common.texts(b.column(b.schema.get_field_index(text_col))), drop, strict=True):
                ls = t.split(b"\n")
                n_lines.append(len(ls))
                if d:
                    gone = set(d)
                    ls = [x for x in ls if not (len(k := _key(x)) >= min_chars
                                                and hashlib.sha256(k).digest() in gone)]
                    t = b"\n".join(ls)
                n_drop.append(n_lines[-1] - len(ls))
                out.append(t)
            return pa.array(out, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_drop, pa.int64())
        return step

    out = common.arrow_columns(joined, strip, f"`{text_col}` string, n_lines long, n_dropped long", drop=(cid, cdrop))
    order = [c for c in df.columns if c.lower() not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    return out.select(*[F.col(f"`{c}`") for c in order])
