"""Quality trees, conversation prefix tries and importance resampling against plain twins."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from corpusflow.llm import importance, prefix_trie, quality_trees
from corpusflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


# --- op11 -------------------------------------------------------------------------------------------------------

def test_trees_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_quality_trees"](spark, SF).collect()}
    docs = [r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(got) == sorted(docs)
    assert all(r["held_out"] == (crc32(str(i).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in got.items())
    lab = [(got[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held = [(r["predicted"], y) for r, y in lab if r["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.97 and np.mean([p for p, y in held if y == 1]) > 0.98


def test_flat_trees_equal_a_walk_row_by_row():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_trees.fit_trees(x, y, np.ones(600), trees=12, depth=3)
    assert np.mean((model.score(x) >= 0.5) == (y == 1)) > 0.97
    for row in x[:50]:
        z = model.bias
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            z += leaf[node - len(f)]
        assert abs(model.margin(row[None])[0] - z) < 1e-12
    assert model.margin(np.zeros((0, 5))).shape == (0,)


def test_first_split_has_the_largest_gain():
    rng = np.random.default_rng(5)
    x, w = rng.integers(0, 9, size=(200, 4)).astype(float), rng.uniform(0.5, 2, 200)
    y = (rng.uniform(size=200) < x[:, 2] / 9).astype(float)
    model = quality_trees.fit_trees(x, y, w, trees=1, depth=1, least=0.0)
    w = w / w.sum() * 200
    p = (w * y).sum() / 200
    g, h = w * (p - y), w * p * (1 - p)

    def gain(m):
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (m, ~m))
    best = max((gain(x[:, f] <= t), -f, -t) for f in range(4) for t in sorted(set(x[:, f]))[:-1])
    assert (model.feature[0, 0], model.threshold[0, 0]) == (-best[1], -best[2])
    left = x[:, -best[1]] <= -best[2]
    want = [-quality_trees.RATE * g[s].sum() / (h[s].sum() + 1) for s in (left, ~left)]
    assert np.allclose(model.leaf[0], want)


def test_trees_on_odd_rows(spark):
    text = "A plain sentence of some words stands here. Another one follows it."
    rows = [(k, f"{text} {k}", 1.0) for k in range(40)] + [(100 + k, f"$$$ ### !!! {k} ||| &&& ***", 1.0) for k in range(40)]
    rows += [(200, None, 1.0), (201, "", 1.0), (202, " \n\t", 1.0), (203, "word " * 60000, 1.0), (None, text, 1.0), (1, rows[1][1], 1.0), (204, "é" * 5, 1.0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score double")
    lab = spark.createDataFrame([(k, 1, "x") for k in range(40)] + [(100 + k, 0, "x") for k in range(40)] + [(None, 1, "x"), (0, None, "x"), (1, 1, "x"), (3, 5, "x")], "doc_id long, quality int, text string")
    model = quality_trees.fit_quality_trees(d, lab)
    out = quality_trees.score_quality(d, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[k]["predicted"] == 1 and got[100 + k]["predicted"] == 0 for k in range(40)) and got[None]["predicted"] == 1
    assert got[200]["score"] == got[201]["score"] == got[202]["score"]
    small = quality_trees.fit_quality_trees(d, lab, sample=20)
    assert small is not None and quality_trees.fit_quality_trees(d, lab.where("quality = 1")) is None
    assert quality_trees.fit_quality_trees(d.limit(0), lab) is None and quality_trees.fit_quality_trees(d, lab.limit(0)) is None
    assert quality_trees.score_quality(d.limit(0), model).count() == 0
    assert {r["score"] for r in quality_trees.score_quality(d, None).collect()} == {0.5}


def test_scores_do_not_depend_on_ids_or_labels_of_scored_rows(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lab = spark.read.parquet(f"{SF}/labels.parquet").where("crc32(cast(doc_id as string)) % 3 <> 1")
    model = quality_trees.fit_quality_trees(d, lab)
    a = {r["text"]: r["score"] for r in quality_trees.score_quality(d, model).collect()}
    b = {r["text"]: r["score"] for r in quality_trees.score_quality(d.selectExpr("-doc_id as doc_id", "text").repartition(7), model).collect()}
    assert a == b


# --- op12 -------------------------------------------------------------------------------------------------------

def rebuilt(rows, every=5, most=8):
    conv = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, hashlib.sha256(
            f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).digest())):
        conv.setdefault(c, []).append((r or "", x or ""))
    out = {}
    for c, own in conv.items():
        h = crc32(str(c).encode()) % (most + 1)
        out[c] = conv.get(c - int(math.fmod(c, every)), [])[:h] + own[h:]
    return out


def trie(convs):
    """Sorted rows of the contract, by plain prefixes."""
    at = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            at.setdefault(tuple(t[:d]), []).append(c)
    kids = Counter(p[:-1] for p in at if p)
    saved, leaves = Counter(), Counter()
    for p, m in at.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
            leaves[p[:d]] += kids[p] == 0
    rows = []
    for p, m in at.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        rows.append((min(m), len(p), min(at[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


COLS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("ids,turns", [(2048, 1 << 15), (3, 1 << 15), (50, 7)])
def test_trie_of_random_conversations(spark, ids, turns):
    rng = random.Random(ids)
    rows = [(c, t, rng.choice(["user", "system", None]), rng.choice(["a", "b", "", None, "é long text"]))
            for c in [*range(-9, 160, 2), 7, 22, 10 ** 12, 10 ** 12 + 3] for t in range(rng.randint(1, 5))]
    rows += [(c, t, "user", f"hello {t}") for c in range(500, 560) for t in range(6)]                       # one conversation many times
    rows += [(600, t, "user", f"t{t}" * 30) for t in range(400)] + [(None, 0, "user", "x"), (601, None, "u", "z"), (601, 0, "u", "y"), (601, 0, "u", "y"), (601, 0, "u", "b")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, n int, k string").repartition(5)
    seq = prefix_trie.share_starts(prefix_trie.sequences(df))
    want = rebuilt(rows)
    got = {r["conv_id"]: [bytes(x["d"]) for x in r["steps"]] for r in seq.collect()}
    assert {c: len(t) for c, t in got.items()} == {c: len(t) for c, t in want.items()} and any(not t for t in want.values())
    assert nodes(prefix_trie.prefix_trie(seq, ids, turns)) == trie(want)


def test_trie_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(QUERIES["op12_prefix_trie"](spark, SF)) == trie(rebuilt(rows))


def test_trie_of_nothing_and_of_one(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.share_starts(prefix_trie.sequences(none))).count() == 0
    one = spark.createDataFrame([(5, 0, None, None)], none.schema)
    assert nodes(prefix_trie.prefix_trie(prefix_trie.sequences(one))) == trie({5: [("", "")]})


def test_role_and_text_do_not_run_together(spark):
    df = spark.createDataFrame([(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, None, "abc"), (4, 0, "", "abc")], "conv_id long, turn long, role string, text string")
    assert nodes(prefix_trie.prefix_trie(prefix_trie.sequences(df))) == trie({1: [("a", "bc")], 2: [("ab", "c")], 3: [("", "abc")], 4: [("", "abc")]})


# --- op13 -------------------------------------------------------------------------------------------------------

def resampled(docs, target, least=1, most=1, buckets=10000, seed=2024, min_words=20, percent=10):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(up))
        return len(w), [crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(w) - n + 1)]
    d = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(b for _, _, g in d for b in g), Counter(b for x in target for b in grams(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + float(buckets)) / ((s[b] + 1.0) * (n_t + float(buckets))))) for b in s}
    rows = []
    for i, n, g in d:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def scores(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


DOCS = [(None, "null id " * 12), (None, "null id " * 12), (1, None), (2, ""), (3, "\n \x00"), (4, "ONE Two-three_4 été ÉTÉ a b " * 9), (5, "x" * 9000),
        (6, "long text of many words " * 9000), (7, "short"), *[(100 + k, "same copies of one text " * 6) for k in range(60)], (100, "same copies of one text " * 6)]


@pytest.mark.parametrize("least,most,percent", [(1, 1, 10), (1, 3, 50), (2, 2, 100), (1, 1, 0)])
def test_resampling_equals_its_definition(spark, monkeypatch, least, most, percent):
    monkeypatch.setattr(importance, "BINS", 4)
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in DOCS], "doc_id long, text string, score int, id string").repartition(6)
    goal = [None, "", "same copies of a target text", "été"]
    out = importance.resampling_scores(df, spark.createDataFrame([(x,) for x in goal], "text string"), least=least, most=most, percent=percent, buckets=500)
    assert scores(out) == resampled(DOCS, goal, least, most, 500, percent=percent)


def test_resampling_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    goal = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert scores(QUERIES["op13_importance"](spark, SF)) == resampled(docs, goal)


def test_resampling_of_empty_tables(spark):
    df, goal = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")
    assert importance.resampling_scores(df.limit(0), goal).count() == 0
    assert scores(importance.resampling_scores(df, goal.limit(0))) == resampled(DOCS, [])
    assert scores(importance.resampling_scores(df.where("doc_id = 7"), goal)) == resampled([(7, "short")], ["a"])


def test_interning_verifies_bytes():
    grams = [b"a", b"b", b"a", b"c", b"b", b"d"] * 50
    for h in (None, np.zeros(len(grams), np.uint64), np.full(len(grams), 2 ** 64 - 1, np.uint64)):      # all keys equal: bytes decide
        slot, owner = importance.intern(grams, h)
        assert [grams[owner[s]] for s in slot] == grams and (owner >= 0).sum() == 4
    slot, owner = importance.intern([])
    assert len(slot) == 0 and (owner < 0).all()


def test_words_across_pieces():
    text = b" ".join(str(k).encode() for k in range(300))
    for n in (1, 2, 3):
        whole = next(importance.occurrences([text], 1, n))
        parts = list(importance.occurrences([text], 1, n, block=50, piece=17))
        assert Counter(g for p in parts for g in p[0]) == Counter(whole[0]) and sum(w for p in parts for w in p[2].values()) == 300
        assert all(len(p[0]) == len(p[1]) for p in parts)
