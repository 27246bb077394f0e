"""Leakage-safe splits, largest remainders in many tasks, permutations without a shuffle."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import split as X
from corpusflow.operators.grouped_split import copy_components, cross_split_copies, deal, grouped_split
from corpusflow.operators.positions import PRIME, permutation_keys, permuted, position_by_sort

SPLITS = [("train", 0.7), ("val", 0.1), ("test", 0.2)]


def one_by_one(quotas, classes):
    lack, out = list(quotas), []
    for size, count in classes:
        took = [0] * len(lack)
        for _ in range(count):
            j = max(range(len(lack)), key=lambda i: (lack[i], -i))
            lack[j] -= size
            took[j] += 1
        out.append(took)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_dealing_whole_classes_equals_one_by_one(seed):
    rng = random.Random(seed)
    for _ in range(200):
        classes = sorted({rng.randint(1, 30): rng.randint(1, 40) for _ in range(rng.randint(1, 6))}.items(), reverse=True)
        total = sum(s * n for s, n in classes)
        cut = sorted(rng.randint(0, total) for _ in range(2))
        quotas = [cut[0], cut[1] - cut[0], total - cut[1]]
        assert deal(quotas, classes) == one_by_one(quotas, classes)


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, f"a{rng.randrange(220)}", "hot" if rng.random() < 0.4 else f"u{k}"]), f"b{rng.randrange(900)}" if rng.random() < 0.5 else None,
             rng.randrange(2), rng.choice("xyz")) for k in range(700)]
    return rows, spark.createDataFrame(rows, "id long, a string, b string, label int, domain string").repartition(6)


def plain_components(rows):
    up = {r[0]: r[0] for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for j in (1, 2):
        first = {}
        for r in rows:
            if r[j] is not None:
                up[find(r[0])] = find(first.setdefault(r[j], r[0]))
    return {i: find(i) for i in up}


def test_components_of_copies(copies):
    rows, df = copies
    got = {r["id"]: (r["component"], r["component_size"]) for r in copy_components(df, ["a", "b"], ["id"]).collect()}
    want = plain_components(rows)
    size = Counter(want.values())
    pair = {(want[i], got[i][0]) for i in want}
    assert len(pair) == len(set(want.values())) == len({c for c, _ in got.values()}) and all(got[i][1] == size[want[i]] for i in want)


def test_no_component_crosses_a_split(copies):
    rows, df = copies
    out = grouped_split(df, ["label"], SPLITS, ["a", "b"], ["id"]).collect()
    assert sorted(r["id"] for r in out) == list(range(700))
    comp, by = plain_components(rows), defaultdict(set)
    for r in out:
        by[comp[r["id"]]].add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    # a component counts in the stratum of its smallest id; each split is within the largest component of its exact size
    first = {}
    for i, c in sorted(comp.items()):
        first.setdefault(c, rows[i][3])
    size, got = Counter(comp.values()), Counter()
    for r in out:
        got[first[comp[r["id"]]], r["split"]] += 1
    for label in (0, 1):
        n = sum(size[c] for c in size if first[c] == label)
        top = max(size[c] for c in size if first[c] == label)
        for name, share in SPLITS:
            assert abs(got[label, name] - share * n) <= top + 1
    assert [tuple(r) for r in cross_split_copies(df.join(df.sparkSession.createDataFrame([(r["id"], r["split"]) for r in out], "id long, split string"), "id"), ["a", "b"]).collect()] == [(0, 0, 0), (1, 0, 0)]


def test_without_copies_sizes_are_exact(spark):
    df = spark.range(1003).select("id", (F.col("id") % 3).alias("label"), F.col("id").cast("string").alias("t"))
    sizes = {r["split"]: r["count"] for r in grouped_split(df, ["label"], SPLITS, ["t"], ["id"]).groupBy("split").count().collect()}
    want = {r["split"]: r["count"] for r in X.stratified_split(df, ["label"], SPLITS, row_key=["id"]).groupBy("split").count().collect()}
    assert sizes == want
    again = {r["id"]: r["split"] for r in grouped_split(df.repartition(7), ["label"], SPLITS, ["t"], ["id"]).collect()}
    assert again == {r["id"]: r["split"] for r in grouped_split(df.coalesce(1), ["label"], SPLITS, ["t"], ["id"]).collect()}


def test_cross_split_report_and_empty_table(spark):
    df = spark.createDataFrame([("x", "train"), ("x", "val"), ("x", "val"), ("y", "val"), (None, "train"), (None, "val")], "a string, split string")
    assert [tuple(r) for r in cross_split_copies(df, ["a"]).collect()] == [(0, 1, 3)]
    none = spark.createDataFrame([], "id long, a string, label int")
    assert grouped_split(none, ["label"], SPLITS, ["a"], ["id"]).count() == 0 and cross_split_copies(df.limit(0), ["a"]).first()["n_rows"] == 0


def test_quotas_by_ranges_equal_those_of_one_task(spark):
    rng = random.Random(1)
    counts = spark.createDataFrame([(f"s{k:05d}", rng.choice([2, 2, 3, 7, 100, 12345])) for k in range(3000)], "stratum string, n long").repartition(8)
    held = X.held_out_fractions([0.7, 0.1, 0.2])
    one = sorted(map(tuple, X.allocate(counts, held).collect()))
    many = sorted(map(tuple, X.allocate(counts, held, one_task=10).collect()))
    assert one == many and sum(r[2] for r in one) == sum(r[1] for r in one) - -(-3 * sum(r[1] for r in one) // 10)


def test_place_by_sort(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).repartition(7)
    got = sorted((r["p"], r["k"], r["v"]) for r in position_by_sort(df, [F.desc("k"), "v"], "p").collect())
    assert got == [(p, k, v) for p, (k, v) in enumerate(sorted(((i % 3, i) for i in range(5000)), key=lambda t: (-t[0], t[1])))]
    assert position_by_sort(df.limit(0), ["k"], "p").count() == 0


def plain_permuted(x, n, seed, epoch):
    for k, a, b, c in permutation_keys(n, seed, epoch):
        y = (k - x) % n
        top = max(x, y)
        m = (top % PRIME * a + top // PRIME % PRIME * b + c) % PRIME
        if (m * m % PRIME >> 15) & 1:
            x = y
    return x


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4096])
def test_permutation_is_one_to_one(spark, n):
    got = {r["id"]: (r["a"], r["b"]) for r in spark.range(-2, n + 2).select("id", permuted(F.col("id"), n, 42, 0).alias("a"), permuted(F.col("id"), n, 42, 1).alias("b")).collect()}
    assert all(got[x] == (None, None) for x in (-2, -1, n, n + 1))
    assert sorted(got[x][0] for x in range(n)) == sorted(got[x][1] for x in range(n)) == list(range(n))
    assert all(got[x] == (plain_permuted(x, n, 42, 0), plain_permuted(x, n, 42, 1)) for x in range(min(n, 200)))
    if n >= 1000:           # neither epoch keeps order or places
        a = [got[x][0] for x in range(n)]
        assert sum(x == y for x, y in enumerate(a)) < 12 and 0.45 < sum(p < q for p, q in zip(a, a[1:], strict=False)) / n < 0.55
        assert abs(sum(x * y for x, y in enumerate(a)) / sum(x * x for x in range(n)) - 0.75) < 0.05 and a != [got[x][1] for x in range(n)]


def test_second_epoch_is_a_projection(spark):
    df = spark.range(100).withColumnRenamed("id", "position").withColumn("text", F.lit("t"))
    out = X.permuted_batches(df, 100, 16, epoch=3)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert sorted(r["position"] for r in rows) == list(range(100)) and Counter(r["batch_id"] for r in rows) == {**{k: 16 for k in range(6)}, 6: 4}
    big = spark.createDataFrame([(10 ** 12 - 1,), (5,)], "x long").select("x", permuted(F.col("x"), 10 ** 12, 1).alias("y")).collect()
    assert all(r["y"] == plain_permuted(r["x"], 10 ** 12, 1, 0) for r in big)
