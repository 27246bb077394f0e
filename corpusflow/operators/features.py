"""Token ids, truncation, padding, feature vectors.

The pretrained sub-word tokenizer is re-aimed as a corpus vocabulary: tokens are
whitespace words of cleaned text; ids 0 = pad, 1 = unknown, then by frequency.
Encoding never shuffles the documents: the vocabulary (``size`` entries, a proven bound)
is folded into one map row and broadcast; each row is looked up in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.arrays import pieces
from corpusflow.functions.text import clean_text_a
from corpusflow.session import bound_batches, ensure_checkpoint_dir

PAD, UNK = 0, 1


def tokens(col, clean: bool = True) -> Column:
    """Whitespace words (after cleaner A when ``clean``)."""
    c = F.col(col) if isinstance(col, str) else col
    x = clean_text_a(c) if clean else c
    return F.filter(F.split(x, " "), lambda t: t != "")


def build_vocab(df: DataFrame, size: int, tokens_col: str = "tokens") -> DataFrame:
    """Top-``size`` tokens by (count desc, token asc) -> ``(token, id, n)``; the word
    count is a partial aggregate, the top-k a bounded TakeOrdered."""
    counts = df.select(F.explode(tokens_col).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), F.col("token")).limit(size)
    return top.withColumn("id", (F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("token"))) + 1).cast("int"))


def vocab_coverage(df: DataFrame, sizes, tokens_col: str = "tokens") -> DataFrame:
    """How much of the running text vocabularies of several ``sizes`` know: (size, n_types, n_tokens, n_covered). One word count,
    written once; tokens past the largest size are only summed, and each size is a bounded top-k of the counts."""
    ensure_checkpoint_dir(df.sparkSession)
    counts = df.select(F.explode(tokens_col).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    total = counts.agg(F.count(F.lit(1)).alias("n_types"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))     # one row
    top = counts.orderBy(F.col("n").desc(), F.col("token")).limit(max(sizes)).withColumn(
        "id", F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("token"))))
    known = top.agg(*[F.coalesce(F.sum(F.when(F.col("id") <= k, F.col("n"))), F.lit(0)).alias(f"k{k}") for k in sizes])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("size"), F.col(f"k{k}").alias("n_covered")) for k in sizes]))
    return known.select(rows.alias("r")).select("r.*").crossJoin(F.broadcast(total)).select("size", "n_types", "n_tokens", "n_covered")


def encode(df: DataFrame, vocab: DataFrame, tokens_col: str = "tokens", out: str = "input_ids",
           max_length: int | None = 512, drop_tokens: bool = True) -> DataFrame:
    """Token ids (unknown -> 1), truncated to ``max_length``.

    Rows are encoded where they are (no shuffle): the vocabulary - at most ``size`` tokens,
    a bound fixed by :func:`build_vocab` - is broadcast, and a slice of each Arrow batch at a time
    is looked up with one vectorised hash probe (``pyarrow.compute.index_in``)."""
    from pyspark.sql import types as T
    bound_batches(df.sparkSession)
    vocab_tokens = [r[0] for r in vocab.orderBy("id").select("token").collect()]  # <= size rows
    bc = df.sparkSession.sparkContext.broadcast(vocab_tokens)
    keep = [f for f in df.schema.fields if not (drop_tokens and f.name == tokens_col)]
    schema = T.StructType(keep + [T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in keep]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        value_set = pa.array(bc.value, pa.string())
        for batch in pieces(batches):
            toks = batch.column(tokens_col)
            flat = toks.flatten()
            ids = pc.fill_null(pc.add(pc.index_in(flat, value_set=value_set), 2), UNK).cast(pa.int32())
            offsets = pc.subtract(toks.offsets, toks.offsets[0])
            lists = pa.ListArray.from_arrays(offsets, ids, mask=toks.is_null() if toks.null_count else None)
            if max_length:
                lists = pc.list_slice(lists, 0, max_length)
            cols = [batch.column(n) for n in names] + [lists.cast(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=names + [out])
    return df.mapInArrow(run, schema)


def truncate(col, n: int) -> Column:
    """T2."""
    return F.slice(F.col(col) if isinstance(col, str) else col, 1, n)


def pad_fixed(df: DataFrame, n: int, ids: str = "input_ids") -> DataFrame:
    """Pad with 0 to exactly ``n`` (truncating longer rows); mask 1 real, 0 pad."""
    t = F.slice(ids, 1, n)
    k = F.size(t)
    return df.select(
        *[c for c in df.columns if c != ids],
        F.concat(t, F.array_repeat(F.lit(PAD), F.lit(n) - k)).alias(ids),
        F.concat(F.array_repeat(F.lit(1), k), F.array_repeat(F.lit(0), F.lit(n) - k)).alias("attention_mask"))


def pad_batch(df: DataFrame, ids: str = "input_ids", batch: str = "batch_id") -> DataFrame:
    """T4: pad to the longest row of the batch (batches are small; the max is a grouped
    aggregate joined back)."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_cf_len"))
    j = df.join(longest, batch)
    k = F.size(ids)
    return (j.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), k), F.array_repeat(F.lit(0), F.col("_cf_len") - k)))
            .withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(PAD), F.col("_cf_len") - k)))
            .withColumnRenamed("_cf_len", "padded_len"))


def text_features(num_features: int = 1 << 18, min_doc_freq: int = 1, input_col: str = "text"):
    """Pipeline stages text -> TF-IDF vector (``features``)."""
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
    tok = RegexTokenizer(inputCol=input_col, outputCol="_cf_words", pattern="(?U)\\W+", toLowercase=True)
    tf = HashingTF(inputCol="_cf_words", outputCol="_cf_tf", numFeatures=num_features)
    idf = IDF(inputCol="_cf_tf", outputCol="features", minDocFreq=min_doc_freq)
    return [tok, tf, idf]


def array_features(df: DataFrame, col: str = "embedding", out: str = "features") -> DataFrame:
    """T7 for ready-made embeddings: ``ARRAY<FLOAT>`` -> ML vector."""
    from pyspark.ml.functions import array_to_vector
    return df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))
