"""Array math on logits (``ARRAY<DOUBLE>``) as higher-order column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def logsumexp(logits) -> Column:
    z = _c(logits)
    m = F.array_max(z)
    return F.log(F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))) + m


def log_softmax(logits) -> Column:
    z = _c(logits)
    lse = logsumexp(z)
    return F.transform(z, lambda x: x - lse)


def softmax(logits) -> Column:
    z = _c(logits)
    m = F.array_max(z)
    s = F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))
    return F.transform(z, lambda x: F.exp(x - m) / s)


def cross_entropy(logits, label) -> Column:
    """L1: ``logsumexp(z) - z[label]`` (label is a 0-based class id)."""
    z = _c(logits)
    return logsumexp(z) - F.element_at(z, _c(label).cast("int") + 1)


def argmax(arr) -> Column:
    """0-based index of the maximum; the first one wins on ties (as numpy)."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def kl_div(p_logits, q_logits) -> Column:
    """KL(softmax(p) || softmax(q)) per row."""
    lp, lq = log_softmax(p_logits), log_softmax(q_logits)
    pairs = F.arrays_zip(lp.alias("a"), lq.alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, e: acc + F.exp(e["a"]) * (e["a"] - e["b"]))


def blend(a, b, lam) -> Column:
    """Elementwise ``lam * a + (1 - lam) * b``."""
    return F.zip_with(_c(a), _c(b), lambda x, y: _c(lam) * x + (F.lit(1.0) - _c(lam)) * y)


PIECE_ROWS = 512
PIECE_BYTES = 1 << 20


def pieces(batches, rows: int = PIECE_ROWS, n_bytes: int = PIECE_BYTES):
    """Arrow batches in slices (no copy) of at most ``rows`` rows and about ``n_bytes``: what a Python worker makes of its
    input at a time does not grow with the batches that Spark sends."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * n_bytes // max(1, b.nbytes)))
        for at in range(0, max(1, b.num_rows), step):
            yield b.slice(at, step)
