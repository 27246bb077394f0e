"""Checked queries: vocabulary, token ids, truncation and padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import features as T
from corpusflow.operators.split import assign_batches
from corpusflow.plans.fixtures import table
from corpusflow.plans.q_corpus import _sql_clean_a
from corpusflow.plans.registry import query, with_ctes

VOCAB_SIZE = 1000
MAX_LEN = 512
BATCH_MAX_LEN = 256

_TOK_SQL = f"""
toks AS (SELECT doc_id, list_filter(string_split({_sql_clean_a('text')}, ' '), lambda t: t <> '') AS tokens FROM documents),
vocab AS (
  SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS id FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM toks) GROUP BY token
    ORDER BY n DESC, token LIMIT {VOCAB_SIZE})
),
upos AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS pos FROM toks),
ids AS (SELECT u.doc_id, u.pos, coalesce(v.id, 1) AS id FROM upos u LEFT JOIN vocab v ON u.token = v.token),
enc AS (
  SELECT t.doc_id, CAST(len(t.tokens) AS INTEGER) AS n_tokens,
         coalesce(a.ids, []) AS ids
  FROM toks t LEFT JOIN (SELECT doc_id, list(id ORDER BY pos) AS ids FROM ids GROUP BY doc_id) a USING (doc_id)
)"""


def _encoded(spark, sf, max_length=MAX_LEN):
    # tokens are read twice (vocabulary, then encoding): materialise them once
    d = table(spark, sf, "documents").select("doc_id", T.tokens("text").alias("tokens")).checkpoint()
    vocab = T.build_vocab(d, VOCAB_SIZE)
    return T.encode(d.withColumn("n_tokens", F.size("tokens")), vocab, max_length=max_length)


def _ids_str(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


@query("vocab_topk", with_ctes(_TOK_SQL) + "SELECT token, id, n FROM vocab")
def q_vocab_topk(spark, sf):
    d = table(spark, sf, "documents").select(T.tokens("text").alias("tokens"))
    return T.build_vocab(d, VOCAB_SIZE).select("token", "id", "n")


@query("encode_tokens", with_ctes(_TOK_SQL) + f"""
SELECT doc_id, n_tokens, array_to_string(ids[1:{MAX_LEN}], ',') AS input_ids,
       CAST(len(list_filter(ids[1:{MAX_LEN}], lambda x: x = 1)) AS INTEGER) AS n_unk FROM enc""")
def q_encode_tokens(spark, sf):
    e = _encoded(spark, sf)
    return e.select("doc_id", "n_tokens", _ids_str("input_ids").alias("input_ids"),
                    F.size(F.filter("input_ids", lambda x: x == 1)).alias("n_unk"))


@query("pad_fixed", with_ctes(_TOK_SQL) + f"""
SELECT doc_id, array_to_string(list_concat(ids[1:{MAX_LEN}], list_transform(range(0, {MAX_LEN} - len(ids[1:{MAX_LEN}])), lambda x: 0)), ',') AS input_ids,
       CAST(len(ids[1:{MAX_LEN}]) AS INTEGER) AS mask_sum, {MAX_LEN} AS padded_len FROM enc""")
def q_pad_fixed(spark, sf):
    p = T.pad_fixed(_encoded(spark, sf), MAX_LEN)
    return p.select("doc_id", _ids_str("input_ids").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
                    F.size("input_ids").alias("padded_len"))


@query("pad_batch", with_ctes(_TOK_SQL) + f"""
, b AS (SELECT doc_id, ids[1:{BATCH_MAX_LEN}] AS ids, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM enc)
SELECT doc_id, batch_id, CAST(max(len(ids)) OVER (PARTITION BY batch_id) AS INTEGER) AS padded_len,
       CAST(len(ids) AS INTEGER) AS mask_sum FROM b""")
def q_pad_batch(spark, sf):
    e = assign_batches(_encoded(spark, sf, BATCH_MAX_LEN), 16, order="doc_id")
    p = T.pad_batch(e)
    return p.select("doc_id", "batch_id", "padded_len",
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))


@query("pad_batch_ids", with_ctes(_TOK_SQL) + f"""
, b AS (SELECT doc_id, ids[1:{BATCH_MAX_LEN}] AS ids, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM enc),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS w FROM b)
SELECT doc_id, batch_id, array_to_string(list_concat(ids, list_transform(range(0, w - len(ids)), lambda x: 0)), ',') AS input_ids,
       array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(0, w - len(ids)), lambda x: 0)), ',') AS mask FROM w""")
def q_pad_batch_ids(spark, sf):
    """T4: the padded ids and masks themselves."""
    p = T.pad_batch(assign_batches(_encoded(spark, sf, BATCH_MAX_LEN), 16, order="doc_id"))
    return p.select("doc_id", "batch_id", _ids_str("input_ids").alias("input_ids"), _ids_str("attention_mask").alias("mask"))


COVERAGE = (100, 1000, 10000)


@query("vocab_coverage", with_ctes(_TOK_SQL) + """
, c AS (SELECT n, row_number() OVER (ORDER BY n DESC, token) AS r FROM (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM toks) GROUP BY token))
SELECT size, (SELECT count(*) FROM c) AS n_types, (SELECT sum(n) FROM c)::BIGINT AS n_tokens, (SELECT sum(n) FROM c WHERE r <= size)::BIGINT AS n_covered
FROM (SELECT unnest([100, 1000, 10000])::INTEGER AS size)""")
def q_vocab_coverage(spark, sf):
    """The share of running words that vocabularies of several sizes know."""
    return T.vocab_coverage(table(spark, sf, "documents").select(T.tokens("text").alias("tokens")), COVERAGE)
