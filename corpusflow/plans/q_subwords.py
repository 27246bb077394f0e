"""Registered queries on sub-word ids of a public vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import features as T
from corpusflow.operators import gradient as G
from corpusflow.operators import subwords as S
from corpusflow.operators.split import assign_batches
from corpusflow.plans.fixtures import table
from corpusflow.plans.q_train import labelled_split
from corpusflow.plans.registry import query

MAX_LEN = 512
BATCH_MAX_LEN = 256


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _words(col: str = "text"):
    return F.size(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))


@query("subword_roundtrip", """
SELECT doc_id, sha256(replace(coalesce(text, ''), '▁', ' ')) AS text_sha FROM documents""")
def q_subword_roundtrip(spark, sf):
    """Whole texts to ids and back; the vocabulary spells what it does not know in bytes, so nothing but its word mark changes."""
    path = vocabulary()
    e = S.encode_subwords(table(spark, sf, "documents").select("doc_id", "text"), path, max_length=None)
    return S.decode_subwords(e, path).select("doc_id", F.sha2("decoded", 256).alias("text_sha"))


@query("subword_ids")
def q_subword_ids(spark, sf):
    """Ids between the marks, truncated and padded to a fixed length, with the mask."""
    e = S.encode_subwords(table(spark, sf, "documents").select("doc_id", "text"), vocabulary(), max_length=MAX_LEN)
    p = T.pad_fixed(e, MAX_LEN)
    return p.select("doc_id", "n_subwords", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))


@query("subword_batches")
def q_subword_batches(spark, sf):
    """T4: batches of 16 by id, padded to the longest row of each."""
    e = S.encode_subwords(table(spark, sf, "documents").select("doc_id", "text"), vocabulary(), max_length=BATCH_MAX_LEN).drop("n_spelt")
    # encoded once: positions and rows both read it, and ids of bounded length are smaller than the texts
    p = T.pad_batch(assign_batches(e.checkpoint(), 16, order="doc_id"))
    return p.select("doc_id", "batch_id", "padded_len", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
                    F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"))


@query("subword_coverage")
def q_subword_coverage(spark, sf):
    """What the vocabulary costs each language."""
    d = table(spark, sf, "documents").select("lang", "text", _words().alias("words"))
    return S.subword_coverage(S.encode_subwords(d, vocabulary(), max_length=0, special=False), "lang", F.col("words"), MAX_LEN)


@query("train_subwords")
def q_train_subwords(spark, sf):
    """Sub-word ids, truncated, to weighted counts; epochs of gradient steps; test rows scored by the best epoch."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, Normalizer
    path = vocabulary()
    width = S.vocabulary_size(path)
    rows = S.encode_subwords(labelled_split(spark, sf, (("train", 0.7), ("val", 0.1), ("test", 0.2))), path, max_length=MAX_LEN)
    counts = S.subword_counts(rows, width).drop("input_ids").checkpoint()           # read by the weights' fit and by the vectors
    weights = Pipeline(stages=[IDF(inputCol="_cf_tf", outputCol="_cf_idf"), Normalizer(inputCol="_cf_idf", outputCol="features")]).fit(
        counts.where("split = 'train'"))
    v = weights.transform(counts).drop("_cf_tf", "_cf_idf").checkpoint()
    batches = G.write_batches(v.where("split = 'train'"), 4, "row_idx", group="domain")
    cfg = G.GradientConfig(width, lr=0.1, warmup=2, total_steps=12)
    states, history, _ = G.train_epochs(spark, batches, cfg, 3, v.where("split = 'val'"))
    best = history.orderBy(F.desc("val_f1"), "epoch").first()["epoch"]
    return G.score(v.where("split = 'test'"), states[best]).select("row_idx", "label", "pred", F.round("confidence", 9).alias("confidence"))
