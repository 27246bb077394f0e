"""Quality rules: base text statistics and a calibrated hashed n-gram logistic regression."""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 16                       # buckets of each of the feature groups
GROUPS = 3                      # words, word pairs, character triples
SAMPLE = 2400                   # labelled rows the classifier is fitted on (a bounded sample)
THRESHOLD = 0.25            # calibrated probability of good quality below which a document goes: clean ones stay
SYMBOLS = b"[#*$%&|<>]"         # the contract's class: # * $ % & | < >
_SYM = b"#*$%&|<>"
_WS = bytes(range(9, 14)) + b" "


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 5-word window found twice or more."""
    if len(words) < 6:
        return 0
    win = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(win)) == len(win):
        return 0
    n = Counter(win)
    total, covered = 0, 0           # covered: words before this index are counted or passed
    for i, w in enumerate(win):
        if n[w] > 1:
            total += i + 5 - max(covered, i)
            covered = i + 5
    return total


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    solid = text.translate(None, _WS)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
    symbols = len(solid) - len(solid.translate(None, _SYM))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


class Features:
    """Means of hashed n-grams: each group of a document sums to one, so length does not matter."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.width = GROUPS << bits

    def index(self, texts: list[bytes], words: list[list[bytes]]):
        """For the three groups: (bucket of each n-gram, its document)."""
        bits = self.bits
        n = np.array([len(w) for w in words])
        doc = np.repeat(np.arange(len(words)), n)
        flat = np.fromiter((crc32(x) for w in words for x in w), np.uint64, count=int(n.sum()))
        mix = np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            one = (flat * mix) >> np.uint64(64 - bits)
            pair = ((flat[:-1] * np.uint64(31) + flat[1:]) * mix) >> np.uint64(64 - bits)
            inside = doc[:-1] == doc[1:]
            yield one.astype(np.int64), doc
            yield pair[inside].astype(np.int64) + (1 << bits), doc[:-1][inside]
            raw = np.frombuffer(b"".join(texts), np.uint8)
            size = np.array([len(t) for t in texts])
            owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
            c = raw.astype(np.uint32)
            tri = ((c[:-2] | c[1:-1] << np.uint32(8) | c[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
            inside = owner[:-2] == owner[2:]
            yield tri[inside].astype(np.int64) + (2 << bits), owner[:-2][inside]

    def score(self, texts, words, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts))
        for at, doc in self.index(texts, words):
            n = np.bincount(doc, minlength=len(texts))
            out += np.bincount(doc, weights=weights[at], minlength=len(texts)) / np.maximum(n, 1)
        return out

    def sparse(self, texts, words):
        """Per document (sorted buckets, means)."""
        parts = list(self.index(texts, words))
        for k in range(len(texts)):
            idx, val = [], []
            for at, doc in parts:
                lo, hi = np.searchsorted(doc, [k, k + 1])
                u, n = np.unique(at[lo:hi], return_counts=True)
                idx.append(u)
                val.append(n / max(1, hi - lo))
            yield np.concatenate(idx).astype(np.int32), np.concatenate(val).astype(np.float32)


def _fit(rows: list, width: int, rounds: int = 100, l2: float = 1e-6):
    """Logistic regression by full-batch Adam on sparse rows; Platt scaling on the held-out fifth."""
    y = np.array([r[2] for r in rows], float)
    n = np.array([len(r[0]) for r in rows])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), n)
    idx, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    rows = range(len(rows))                          # the arrays hold all that is needed
    held = np.arange(len(rows)) % 5 == 4
    if held.sum() < 10 or len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(rows), bool)
    w, b = np.zeros(width), 0.0
    share = np.clip(y[~held].mean(), 1e-3, 1 - 1e-3)
    cost = np.where(held, 0, np.where(y == 1, 0.5 / share, 0.5 / (1 - share)))   # both classes weigh the same
    cost /= cost.sum()
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(doc, weights=val * w[idx], minlength=len(rows)) + b
        e = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append(np.bincount(idx, weights=val * e[doc], minlength=width) + l2 * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.5 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    z = np.bincount(doc, weights=val * w[idx], minlength=len(rows)) + b
    zs, ys = (z[held], y[held]) if held.any() else (z, y)
    target = np.where(ys == 1, (ys.sum() + 1) / (ys.sum() + 2), 1 / (len(ys) - ys.sum() + 2))
    p, q = 1.0, 0.0                                  # Platt: probability = sigmoid(p * z + q)
    for _ in range(500):
        r = 1 / (1 + np.exp(-np.clip(p * zs + q, -30, 30))) - target
        p, q = max(1e-3, p - 0.05 * np.mean(r * zs)), q - 0.05 * np.mean(r)
    return w * p, b * p + q


def fit_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", sample: int = SAMPLE, bits: int = BITS):
    """(weights, bias) of the calibrated classifier, fitted on at most ``sample`` labelled rows.

    The sample is the rows of smallest id hash, half of it for each label. Null labels and ids take
    no part. Without rows of both labels there is no classifier (None): the base rules decide alone.
    """
    lab = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    key = F.xxhash64("i")
    picked = (lab.where("y = 0").orderBy(key, "i").limit(sample // 2)
              .unionAll(lab.where("y = 1").orderBy(key, "i").limit(sample - sample // 2)).dropDuplicates(["i"]))
    feats = Features(bits)

    def rows(batches):
        for b in batches:
            t = common.texts(b.column(2))
            s = list(feats.sparse(t, [x.split() for x in t]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0].tobytes() for x in s], pa.binary()),
                                              pa.array([x[1].tobytes() for x in s], pa.binary())], names=["i", "y", "a", "v"])

    common.bound_batches(df.sparkSession)
    # the sample side is bounded by its parameter, so it may be broadcast
    got = (df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
           .join(F.broadcast(picked), "i").select("i", "y", "t")
           .mapInArrow(rows, "i long, y int, a binary, v binary")
           .groupBy("i").agg(F.first("y").alias("y"), F.first("a").alias("a"), F.first("v").alias("v"))
           .orderBy(F.xxhash64("i"), "i").limit(sample).toLocalIterator())
    data = [(np.frombuffer(bytes(r["a"]), np.int32), np.frombuffer(bytes(r["v"]), np.float32), r["y"])
            for r in got if len(r["a"])]
    if len({d[2] for d in data}) < 2:
        return None
    return _fit(data, feats.width)


FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, quality_p double, kept boolean")


def quality_rules(df: DataFrame, model, text_col: str = "text", threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """``df`` with base counts, ``base_failed``, the probability ``quality_p`` and ``kept``.

    ``model`` is what :func:`fit_quality` returns; its weights have a fixed width (3 * 2**bits), so
    they are broadcast. Scored in Arrow batches bounded by bytes, no shuffle. Null is the empty text:
    no words, so it fails the base rules. Repeated rows give repeated results; columns named like a
    result are replaced; without a model ``quality_p`` is null and the base rules decide.
    """
    common.bound_batches(df.sparkSession, 4 << 20)
    held = df.sparkSession.sparkContext.broadcast(model)

    def start():
        feats = Features(bits)

        def step(b):
            t = common.texts(b.column(b.schema.get_field_index(text_col)))
            w = [x.split() for x in t]
            base = np.array([base_counts(x, y) for x, y in zip(t, w, strict=True)], np.int64).reshape(-1, 4)
            n = np.array([len(x) for x in w], np.int64)
            failed = (n < 10) | (100 * base[:, 3] > 20 * n)
            if held.value is None:
                p, good = pa.nulls(len(t), pa.float64()), np.ones(len(t), bool)
            else:
                z = feats.score(t, w, held.value[0]) + held.value[1]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                good = p >= threshold
                p = pa.array(p)
            return [pa.array(n), *(pa.array(base[:, k]) for k in range(4)), pa.array(failed), p, pa.array(~failed & good)]
        return step

    return common.arrow_columns(df, start, FIELDS)
