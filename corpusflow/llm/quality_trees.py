"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import repeat_words

SAMPLE = 12000              # labelled rows the trees are fitted on (a bounded sample), half of each label where there are enough
BINS = 64
DEPTH = 4
TREES = 60
RATE = 0.2
L2 = 1.0

_UPPER, _LOWER, _DIGIT = (slice(a, b + 1) for a, b in ((65, 90), (97, 122), (48, 57)))
_MARKS = np.frombuffer(b".,;:!?'\"()", np.uint8)
_SIGNS = np.frombuffer(b"#*$%&|<>@^~_=+/\\[]{}", np.uint8)
_BARE = bytes(b for b in range(128) if not chr(b).isalnum())
_END = tuple(bytes([c]) for c in b".!?")

FEATURES = ("log_words", "log_bytes", "word_bytes", "longest_word", "upper", "digit", "mark", "sign", "space", "newline", "wide",
            "exclaim", "bar", "byte_entropy", "distinct_words", "top_word", "word_entropy", "twin_words", "repeat_words",
            "upper_words", "bare_words", "odd_ends", "stops", "capital_after_stop", "log_lines", "same_lines", "worst_line", "best_line", "word_spread")


def statistics(text: bytes) -> list[float]:
    """The numbers of one text (UTF-8); all zero for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(c[_UPPER].sum() + c[_LOWER].sum() + c[128:].sum()))
    p = c[c > 0] / size
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    q = np.fromiter(seen.values(), float, len(seen)) / n
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = [w.endswith(_END) for w in words]
    stops = sum(ends)
    last = b"".join([w[-1:] for w in words])
    tail = np.bincount(np.frombuffer(last, np.uint8), minlength=256)
    alnum = tail[_UPPER].sum() + tail[_LOWER].sum() + tail[_DIGIT].sum() + tail[128:].sum() + tail[[44, 46, 59, 58, 33, 63]].sum()
    after = sum(1 for k in range(1, n) if ends[k - 1] and words[k][:1].isupper())
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = [_line(x) for x in lines]
    return [np.log1p(n), np.log1p(size), lens.mean(), float(lens.max()), c[_UPPER].sum() / letters, c[_DIGIT].sum() / size, c[_MARKS].sum() / n,
            c[_SIGNS].sum() / n, (c[32] + c[9]) / size, c[10] / n, c[128:].sum() / size, c[33] / n, c[124] / n, float(-(p * np.log2(p)).sum()),
            len(seen) / n, float(q.max()), float(-(q * np.log2(q)).sum() / np.log2(n + 1)), sum(map(bytes.__eq__, words, words[1:])) / n,
            repeat_words(words) / n, sum(map(bytes.isupper, words)) / n, sum(1 for w in seen if not w.strip(_BARE)) / len(seen), (n - alnum) / n,
            stops / n, after / max(1, stops), np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), max(share), min(share), float(lens.std())]


def _line(x: bytes) -> float:
    """Share of a line's bytes that are capitals or signs."""
    c = np.bincount(np.frombuffer(x, np.uint8), minlength=128)
    return float(c[_UPPER].sum() + c[_SIGNS].sum() + c[33]) / len(x)


class Trees:
    """Complete binary trees in arrays: inner node j of a tree has children 2j+1 and 2j+2; a row goes right where its
    feature is above the threshold. A node that was not split has the threshold infinity."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, bias: float):
        self.feature, self.threshold, self.leaf, self.bias = feature, threshold, leaf, bias

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the rows of ``x``: all rows go down one level of one tree at a time."""
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS,
              rate: float = RATE, l2: float = L2, least: float = 1e-3) -> Trees:
    """Gradient boosting of the logistic loss with second-order gains on histograms.

    Columns are cut at ``bins`` quantiles once; a level's gradient and curvature histograms are one ``bincount``
    each over (node, feature, bin); the cut of largest gain wins, ties to the lower feature, then the lower cut. A side keeps at least the
    share ``least`` of the curvature.
    """
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)      # x <= cuts[k]: code <= k
    flat = code + np.arange(width) * bins
    weight = weight / weight.sum() * n
    share = np.clip((weight * y).sum() / n, 1e-6, 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    margin, inner = np.full(n, bias), (1 << depth) - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    floor = least * (weight * share * (1 - share)).sum()
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (width * bins) + flat).ravel()
            hist = [np.bincount(at, np.repeat(v, width), wide * width * bins).reshape(wide, width, bins).cumsum(2) for v in (g, h)]
            (gl, hl), (gt, ht) = hist, [v[:, :1, -1:] for v in hist]
            gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
            gain[(hl < floor) | (ht - hl < floor)] = 0
            best = gain.reshape(wide, -1).argmax(1)
            f, b = best // bins, best % bins
            for j in range(wide):
                if gain[j, f[j], b[j]] > 1e-9 and b[j] < len(cuts[f[j]]):
                    feature[t, first + j], threshold[t, first + j] = f[j], cuts[f[j]][b[j]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        num, den = (np.bincount(node - inner, v, inner + 1) for v in (g, h))
        leaf[t] = -rate * num / (den + l2)
        margin += leaf[t, node - inner]
    return Trees(feature, threshold, leaf, bias)


def _table(batch, col: int) -> np.ndarray:
    return np.array([statistics(t) for t in common.texts(batch.column(col))], float).reshape(-1, len(FEATURES))


def fit_quality_trees(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                      sample: int = SAMPLE) -> Trees | None:
    """Trees fitted on at most ``sample`` rows of ``df`` that ``labels`` marks 0 or 1.

    The sample is the ids of smallest hash, half of them of each label (one label's spare places go to the other); rows
    weigh by their label's share among all labels, so scores are probabilities of the corpus. Null ids and labels take no part; an id
    with both labels counts as 0; of an id's rows one counts (that of the smallest statistics). Without rows of both labels the result is None.
    """
    common.bound_batches(df.sparkSession)
    lab = (labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
           .groupBy("i").agg(F.min("y").alias("y")))
    total = {r["y"]: r["count"] for r in lab.groupBy("y").count().collect()}
    if len(total) < 2:
        return None
    few = min(total, key=total.get)
    part = {few: min(total[few], sample // 2)}
    part[1 - few] = min(total[1 - few], sample - part[few])
    picked = lab.where("y = 0").orderBy(F.xxhash64("i"), "i").limit(part[0]).unionAll(lab.where("y = 1").orderBy(F.xxhash64("i"), "i").limit(part[1]))

    def rows(batches):
        for b in batches:
            x = _table(b, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["i", "y", "x"])

    got = (df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
           .join(F.broadcast(picked), "i").select("i", "y", "t")        # the sample's ids: bounded by the parameter
           .mapInArrow(rows, "i long, y int, x array<double>").groupBy("i").agg(F.min("y").alias("y"), F.min("x").alias("x"))
           .orderBy("i").collect())
    y = np.array([r["y"] for r in got], float)
    if len(set(y)) < 2:
        return None
    seen = {k: max(1, (y == k).sum()) for k in (0, 1)}
    weight = np.where(y == 1, total[1] / seen[1], total[0] / seen[0])
    return fit_trees(np.array([r["x"] for r in got], float), y, weight)


def score_quality(df: DataFrame, model: Trees | None, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` (probability of label 1) and ``predicted`` (1 where score >= 0.5), from the text alone.

    One pass of Arrow batches bounded by bytes, no shuffle; the model is a few arrays of fixed size and is broadcast. Null is the
    empty text, all of whose statistics are 0. Without a model every score is 0.5. Repeated rows give equal results;
    columns named like a result are replaced.
    """
    common.bound_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    def start():
        def step(b):
            x = _table(b, b.schema.get_field_index(text_col))
            p = np.full(len(x), 0.5) if held.value is None else held.value.score(x)
            return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
        return step

    return common.arrow_columns(df, start, "score double, predicted int")

