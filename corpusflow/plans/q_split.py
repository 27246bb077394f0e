"""Checked queries: shuffles, exact stratified splits, batches, split profiles (§2.5-§2.6)."""

from __future__ import annotations


from corpusflow.operators import curate as C
from corpusflow.operators import split as X
from corpusflow.plans.fixtures import CORPUS_SQL, corpus
from corpusflow.plans.q_corpus import _CLEAN_A_SQL, _DEDUP_SQL, _sql_clean_b, deduped
from corpusflow.plans.registry import query, with_ctes

KEYS = ["dataset_rank", "row_idx"]


def _h(seed, *cols):
    inner = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5(concat_ws(':', '{seed}', {inner}))"


def _alloc_sql(src: str, held: list[tuple[int, int]], out: str) -> str:
    """DuckDB CTE chain for the exact largest-remainder allocation over ``src(stratum, n)``.

    ``held`` = (numerator, denominator) of each successive held-out fraction."""
    parts = [f"{out}_a0 AS (SELECT stratum, n, n AS avail0 FROM {src})"]
    prev = f"{out}_a0"
    for i, (num, den) in enumerate(held):
        parts.append(f"""{out}_k{i} AS (
  SELECT *, sum(avail{i}) OVER () AS tot{i},
         sum(avail{i}) OVER () - (sum(avail{i}) OVER () * {num} + {den - 1}) // {den} AS keep{i}
  FROM {prev})""")
        parts.append(f"""{out}_f{i} AS (
  SELECT *, CASE WHEN tot{i} > 0 THEN (avail{i} * keep{i}) // tot{i} ELSE 0 END AS fl{i},
            CASE WHEN tot{i} > 0 THEN (avail{i} * keep{i}) % tot{i} ELSE 0 END AS rem{i}
  FROM {out}_k{i})""")
        parts.append(f"""{out}_q{i} AS (
  SELECT *, fl{i} + CASE WHEN row_number() OVER (ORDER BY rem{i} DESC, stratum)
                        <= keep{i} - sum(fl{i}) OVER () THEN 1 ELSE 0 END AS q{i},
         avail{i} - (fl{i} + CASE WHEN row_number() OVER (ORDER BY rem{i} DESC, stratum)
                        <= keep{i} - sum(fl{i}) OVER () THEN 1 ELSE 0 END) AS avail{i + 1}
  FROM {out}_f{i})""")
        prev = f"{out}_q{i}"
    parts.append(f"{out} AS (SELECT * FROM {prev})")
    return ",\n".join(parts)


def _split_sql(base: str, strata: list[str], names: list[str], held: list[tuple[int, int]], seed=42,
               pool: bool = False) -> str:
    skey = "concat_ws('_', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in strata) + ")"
    cases = []
    cum = []
    for i, n in enumerate(names):
        cum.append(f"q{i}" if i < len(names) - 1 else f"avail{len(names) - 1}")
        cases.append(f"WHEN r < {' + '.join(cum)} THEN '{n}'")
    if pool:
        pre = f"""
skeyed0 AS (SELECT *, {skey} AS stratum0, {_h(seed, *KEYS)} AS h FROM {base}),
scounts0 AS (SELECT stratum0, CAST({strata[0]} AS VARCHAR) AS p, count(*) AS n FROM skeyed0 GROUP BY ALL),
smap1 AS (SELECT stratum0, p, n, CASE WHEN n < 2 THEN p || '_other' ELSE stratum0 END AS e1 FROM scounts0),
sg1 AS (SELECT e1, p, sum(n) AS n1 FROM smap1 GROUP BY e1, p),
sbig AS (SELECT p, e1 AS big FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n1 DESC, e1) AS rk
                                   FROM sg1 WHERE n1 >= 2) WHERE rk = 1),
sg2 AS (SELECT g.e1, CASE WHEN g.n1 < 2 AND b.big IS NOT NULL THEN b.big ELSE g.e1 END AS eff
        FROM sg1 g LEFT JOIN sbig b ON g.p = b.p),
smap AS (SELECT m.stratum0, m.n, g.eff AS stratum FROM smap1 m JOIN sg2 g ON m.e1 = g.e1),
skeyed AS (SELECT k.* EXCLUDE (stratum0), m.stratum FROM skeyed0 k JOIN smap m ON k.stratum0 = m.stratum0),
scounts AS (SELECT stratum, sum(n) AS n FROM smap GROUP BY stratum),"""
    else:
        pre = f"""
skeyed AS (SELECT *, {skey} AS stratum, {_h(seed, *KEYS)} AS h FROM {base}),
scounts AS (SELECT stratum, count(*) AS n FROM skeyed GROUP BY stratum),"""
    return pre + f"""
{_alloc_sql('scounts', held, 'quota')},
sranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, dataset_rank, row_idx) - 1 AS r FROM skeyed),
splitted AS (
  SELECT s.* EXCLUDE (stratum, h, r), CASE {' '.join(cases)} END AS split
  FROM sranked s JOIN quota q ON s.stratum = q.stratum
)"""


# 70/10/20 by label x domain after cleaner A + keep-first dedupe
# outlet-level strata include single-row strata: pooled into '<label>_other' (V12)
_X4 = _split_sql("deduped", ["label", "domain"], ["train", "val", "test"], [(3, 10), (2, 3)], pool=True)


def split3(spark, sf):
    return X.stratified_split(deduped(spark, sf, materialize=True), ["label", "domain"],
                              [("train", 0.7), ("val", 0.1), ("test", 0.2)], seed=42, on_rare="pool")


@query("split_by_label_domain", with_ctes(CORPUS_SQL, _CLEAN_A_SQL, _DEDUP_SQL, _X4)
       + "SELECT dataset_rank, row_idx, label, domain, split FROM splitted")
def q_split_by_label_domain(spark, sf):
    return split3(spark, sf).select(*KEYS, "label", "domain", "split")


@query("split_report", with_ctes(CORPUS_SQL, _CLEAN_A_SQL, _DEDUP_SQL, _X4) + """
SELECT split, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct
FROM splitted GROUP BY split""")
def q_split_report(spark, sf):
    return X.split_report(split3(spark, sf))


@query("dataset_info", with_ctes(CORPUS_SQL, _CLEAN_A_SQL, _DEDUP_SQL, _X4) + """
SELECT count(*) AS total,
  count(*) FILTER (WHERE language = 'en') AS n_en, count(*) FILTER (WHERE language = 'fr') AS n_fr,
  count(*) FILTER (WHERE language = 'de') AS n_de, count(*) FILTER (WHERE language = 'es') AS n_es,
  count(*) FILTER (WHERE language IS NULL OR language NOT IN ('en', 'fr', 'de', 'es')) AS n_other,
  count(*) FILTER (WHERE label = 1) AS n_fake, count(*) FILTER (WHERE label = 0) AS n_true,
  count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val,
  count(*) FILTER (WHERE split = 'test') AS n_test,
  round(100.0 * count(*) FILTER (WHERE label = 1) / count(*), 1)::DOUBLE AS pct_fake,
  round(100.0 * count(*) FILTER (WHERE label = 0) / count(*), 1)::DOUBLE AS pct_true
FROM splitted""")
def q_dataset_info(spark, sf):
    return C.dataset_info(split3(spark, sf))


# 80/20 by label after cleaner B, > 10 chars, dedupe
_CLEAN_B_SQL = f"""
cleanedb AS (
  SELECT * FROM (SELECT {_sql_clean_b('text')} AS text, label, domain, language, dataset, dataset_rank, row_idx
                 FROM corpus) WHERE length(text) > 10
)"""
_DEDUP_B_SQL = """
dedupedb AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY dataset_rank, row_idx) AS rn FROM cleanedb)
  WHERE rn = 1
)"""


@query("split_by_label", with_ctes(CORPUS_SQL, _CLEAN_B_SQL, _DEDUP_B_SQL,
                                   _split_sql("dedupedb", ["label"], ["train", "val"], [(1, 5)]))
       + "SELECT dataset_rank, row_idx, label, split FROM splitted")
def q_split_by_label(spark, sf):
    d = deduped(spark, sf, cleaner="b", min_len=10, materialize=True)
    return X.stratified_split(d, ["label"], [("train", 0.8), ("val", 0.2)]).select(*KEYS, "label", "split")


# 70/10/20 by label x dataset after cleaner A, > 10 chars, dedupe
_CLEAN_A10_SQL = """
cleaneda10 AS (SELECT * FROM cleaned WHERE length(text) > 10)"""
_DEDUP_A10_SQL = """
dedupeda10 AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY dataset_rank, row_idx) AS rn FROM cleaneda10)
  WHERE rn = 1
)"""


@query("split_by_label_dataset", with_ctes(CORPUS_SQL, _CLEAN_A_SQL, _CLEAN_A10_SQL, _DEDUP_A10_SQL,
                                           _split_sql("dedupeda10", ["label", "dataset"], ["train", "val", "test"],
                                                      [(3, 10), (2, 3)]))
       + "SELECT dataset_rank, row_idx, label, dataset, split FROM splitted")
def q_split_by_label_dataset(spark, sf):
    d = deduped(spark, sf, cleaner="a", min_len=10, materialize=True)
    out = X.stratified_split(d, ["label", "dataset"], [("train", 0.7), ("val", 0.1), ("test", 0.2)])
    return out.select(*KEYS, "label", "dataset", "split")


# Seeded shuffle, then sequential 80/20 (two-language flow, no cleaning)
@query("shuffle_rows", with_ctes(CORPUS_SQL) + f"""
SELECT dataset_rank, row_idx, row_number() OVER (ORDER BY {_h(42, *KEYS)}, dataset_rank, row_idx) - 1 AS pos
FROM corpus""")
def q_shuffle_rows(spark, sf):
    return X.shuffle_rows(corpus(spark, sf).select(*KEYS), seed=42)


@query("sequential_split", with_ctes(CORPUS_SQL) + f"""
SELECT dataset_rank, row_idx, pos, CASE WHEN pos < (count(*) OVER ()) * 4 // 5 THEN 'train' ELSE 'val' END AS split
FROM (SELECT dataset_rank, row_idx,
             row_number() OVER (ORDER BY {_h(42, *KEYS)}, dataset_rank, row_idx) - 1 AS pos FROM corpus)""")
def q_sequential_split(spark, sf):
    rows = corpus(spark, sf).select(*KEYS)
    return X.sequential_split(X.shuffle_rows(rows, seed=42), 0.8, counted=rows)


# Shuffled training batches of 16 for epoch 1 over the labelled documents
@query("assign_batches", f"""
SELECT doc_id, 1 AS epoch,
       row_number() OVER (ORDER BY {_h(43, 'doc_id')}, doc_id) - 1 AS position,
       (row_number() OVER (ORDER BY {_h(43, 'doc_id')}, doc_id) - 1) // 16 AS batch_id
FROM labels""")
def q_assign_batches(spark, sf):
    from corpusflow.plans.fixtures import table
    lab = table(spark, sf, "labels").select("doc_id")
    return X.assign_batches(lab, 16, order="doc_id", seed=42, epoch=1)


@query("eval_batches", """
SELECT doc_id, 0 AS epoch, row_number() OVER (ORDER BY doc_id) - 1 AS position,
       (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM labels""")
def q_eval_batches(spark, sf):
    from corpusflow.plans.fixtures import table
    lab = table(spark, sf, "labels").select("doc_id")
    return X.assign_batches(lab, 16, order="doc_id")


# How many texts a sequential split without de-duplication lets cross, and a split over whole components of copies
_SEQ_SQL = f"""
seq AS (SELECT text, CASE WHEN pos < (count(*) OVER ()) * 4 // 5 THEN 'train' ELSE 'val' END AS split
        FROM (SELECT text, row_number() OVER (ORDER BY {_h(42, *KEYS)}, dataset_rank, row_idx) - 1 AS pos FROM corpus)),
seqc AS (SELECT split, {_sql_clean_b('text')} AS ctext, text FROM seq)"""


def _leak_sql(key: int, col: str) -> str:
    return f"""SELECT {key} AS "key", count(*) FILTER (WHERE a <> b) AS n_values, coalesce(sum(n) FILTER (WHERE a <> b), 0)::BIGINT AS n_rows
FROM (SELECT {col}, min(split) AS a, max(split) AS b, count(*) AS n FROM seqc WHERE {col} IS NOT NULL GROUP BY {col})"""


@query("split_leakage", with_ctes(CORPUS_SQL, _SEQ_SQL) + _leak_sql(0, "text") + "\nUNION ALL\n" + _leak_sql(1, "ctext"))
def q_split_leakage(spark, sf):
    """Texts, as they are and cleaned, that the two-language flow's split has on both sides."""
    from corpusflow.functions.text import clean_text_b
    from corpusflow.operators.grouped_split import cross_split_copies
    rows = corpus(spark, sf)
    split = X.sequential_split(X.shuffle_rows(rows.select(*KEYS), seed=42), 0.8, counted=rows.select(*KEYS))
    return cross_split_copies(rows.join(split, KEYS), ["text", clean_text_b("text")])


@query("leakage_safe_split")
def q_leakage_safe_split(spark, sf):
    """70/10/20 by label over whole components of rows that share a text under either cleaner."""
    from corpusflow.functions.text import clean_text_a, clean_text_b
    from corpusflow.operators.grouped_split import grouped_split
    out = grouped_split(corpus(spark, sf), ["label"], [("train", 0.7), ("val", 0.1), ("test", 0.2)],
                        [clean_text_a("text"), clean_text_b("text")], KEYS)
    return out.select(*KEYS, "label", "split", "component_size")


_ROUNDS_SQL = f"""
n AS (SELECT count(*) AS n, greatest(8, 3 * length(bin(greatest(1, count(*) - 1)))) AS rounds FROM labels),
keys AS (SELECT r, md5('42:1:' || r) AS h FROM (SELECT unnest(range((SELECT rounds FROM n))) AS r)),
k AS (SELECT r, ('0x' || substr(h, 1, 15))::BIGINT % (SELECT n FROM n) AS k, ('0x' || substr(h, 16, 7))::BIGINT % {2**31 - 2} + 1 AS a,
             ('0x' || substr(h, 20, 7))::BIGINT % {2**31 - 2} + 1 AS b, ('0x' || substr(h, 26, 7))::BIGINT % {2**31 - 2} + 1 AS c FROM keys),
p AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS x, 0 AS r FROM labels
  UNION ALL
  SELECT doc_id, CASE WHEN (((m * m) % {2**31 - 1}) // 32768) % 2 = 1 THEN y ELSE x END, r + 1 FROM (
    SELECT doc_id, x, y, r, ((greatest(x, y) % {2**31 - 1}) * a + ((greatest(x, y) // {2**31 - 1}) % {2**31 - 1}) * b + c) % {2**31 - 1} AS m FROM (
      SELECT p.doc_id, p.x, p.r, (k.k - p.x + n.n) % n.n AS y, k.a, k.b, k.c FROM p JOIN k ON p.r = k.r, n)))"""


@query("permuted_batches", "WITH RECURSIVE " + _ROUNDS_SQL.strip() + """
SELECT doc_id, 1 AS epoch, x AS position, x // 16 AS batch_id FROM p WHERE r = (SELECT rounds FROM n)""")
def q_permuted_batches(spark, sf):
    """Positions are numbered once; an epoch's order is a projection of them."""
    from corpusflow.plans.fixtures import table
    lab = table(spark, sf, "labels").select("doc_id")
    base = X.assign_batches(lab, 16, order="doc_id").select("doc_id", "position")
    return X.permuted_batches(base, lab.count(), 16, seed=42, epoch=1).select("doc_id", "epoch", "position", "batch_id")
