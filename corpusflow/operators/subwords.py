"""Sub-word token ids by a given vocabulary file, their inverse and their coverage.

Vocabularies are never learnt here: the file of a public tokenizer is a parameter. Its bytes are broadcast
within a checked size, so executors need no copy of the file.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.arrays import pieces
from corpusflow.session import bound_batches

VOCAB_BYTES = 64 << 20      # the largest vocabulary file that is broadcast


class Vocabulary:
    """One vocabulary file in a Python worker: ``.model`` (sentencepiece) or ``.json`` (tokenizers)."""

    def __init__(self, data: bytes, kind: str):
        self.kind = kind
        if kind == "model":
            from sentencepiece import SentencePieceProcessor
            self.sp = SentencePieceProcessor(model_proto=data)
            self.size, self.start, self.end = len(self.sp), self.sp.bos_id(), self.sp.eos_id()
            self.spelt = [self.sp.is_byte(i) or self.sp.is_unknown(i) for i in range(self.size)]
        else:
            from tokenizers import Tokenizer
            self.tk = Tokenizer.from_str(data.decode("utf-8"))
            self.tk.no_truncation()
            self.tk.no_padding()
            self.tk.encode_special_tokens = True        # their strings in a text are ordinary text
            self.size = self.tk.get_vocab_size()
            marks = sorted(i for i, t in self.tk.get_added_tokens_decoder().items() if t.special)
            self.start, self.end = (marks[0], marks[-1]) if marks else (-1, -1)
            unknown = self.tk.token_to_id(getattr(self.tk.model, "unk_token", None) or "")
            self.spelt = [i == unknown and i not in (self.start, self.end) for i in range(self.size)]

    def encode(self, text: str) -> list[int]:
        return self.sp.encode(text) if self.kind == "model" else self.tk.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids) if self.kind == "model" else self.tk.decode(ids, skip_special_tokens=False)


def _shipped(df: DataFrame, path: str):
    """(broadcast bytes, kind) of a vocabulary file, and smaller batches for the workers that will use it."""
    bound_batches(df.sparkSession)
    size = os.path.getsize(path)
    if size > VOCAB_BYTES:
        raise ValueError(f"vocabulary file of {size} bytes, at most {VOCAB_BYTES}")
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read()), "model" if path.endswith(".model") else "json"


def encode_subwords(df: DataFrame, path: str, text_col: str = "text", out: str = "input_ids", max_length: int | None = 512,
                    special: bool = True, drop_text: bool = True) -> DataFrame:
    """``df`` with ``out`` (sub-word ids), ``n_subwords`` and ``n_spelt`` of the whole text.

    With ``special`` the vocabulary's first and last mark (``<s> ... </s>``) enclose the ids, and truncation to ``max_length``
    keeps both: the text gives way. ``n_subwords`` counts the text's pieces before truncation and without marks, ``n_spelt``
    those that are a single byte or unknown. A null text is empty. Columns named like a result are replaced.

    No shuffle: rows are encoded where they are, whole, a few hundred at a time; of a long text only the ids that stay are kept.
    """
    data, kind = _shipped(df, path)
    gone = {out.lower(), "n_subwords", "n_spelt"} | ({text_col.lower()} if drop_text else set())
    keep = [f for f in df.schema.fields if f.name.lower() not in gone]
    schema = T.StructType([*keep, T.StructField("n_subwords", T.LongType()), T.StructField("n_spelt", T.LongType()),
                           T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in keep]

    def run(batches):
        import pyarrow as pa
        v = Vocabulary(data.value, kind)
        marks = special and v.start >= 0 and v.end >= 0
        room = None if max_length is None else max(0, max_length - 2 * marks)
        for b in pieces(batches):
            n, spelt, ids = [], [], []
            for t in b.column(text_col):
                x = v.encode(t.as_py() or "")
                n.append(len(x))
                spelt.append(sum(map(v.spelt.__getitem__, x)))
                x = x if room is None else x[:room]
                ids.append([v.start, *x, v.end] if marks else x)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n, pa.int64()), pa.array(spelt, pa.int64()),
                                              pa.array(ids, pa.list_(pa.int32()))], names=[*names, "n_subwords", "n_spelt", out])

    return df.mapInArrow(run, schema)


def decode_subwords(df: DataFrame, path: str, ids_col: str = "input_ids", out: str = "decoded", special: bool = True) -> DataFrame:
    """The text of ``ids_col``; with ``special`` the enclosing marks are left out. Null ids give the empty text."""
    data, kind = _shipped(df, path)
    keep = [f for f in df.schema.fields if f.name.lower() != out.lower()]
    names = [f.name for f in keep]

    def run(batches):
        import pyarrow as pa
        v = Vocabulary(data.value, kind)
        marks = (v.start, v.end) if special else ()
        for b in pieces(batches):
            got = [v.decode([i for i in x.as_py() or [] if i not in marks]) for x in b.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(got, pa.string())], names=[*names, out])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField(out, T.StringType())]))


def subword_coverage(encoded: DataFrame, group: str, words: Column, max_length: int = 512) -> DataFrame:
    """Per ``group``: how well a vocabulary serves it. Texts, words, sub-words, single bytes, texts that truncation cuts and the
    sub-words it drops (two places are the marks'). One partial aggregate over numbers; ``words`` counts a row's words."""
    over = F.greatest(F.col("n_subwords") - (max_length - 2), F.lit(0))
    return encoded.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_texts"), F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("n_words"), F.sum("n_subwords").alias("n_subwords"),
        F.sum("n_spelt").alias("n_spelt"), F.sum((over > 0).cast("long")).alias("n_cut"), F.sum(over).cast("long").alias("n_dropped"))


def subword_counts(df: DataFrame, size: int, ids: str = "input_ids", out: str = "_cf_tf") -> DataFrame:
    """Sparse counts of sub-word ids, one place for each id of the vocabulary (JVM-side)."""
    from pyspark.ml.feature import CountVectorizerModel
    model = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], inputCol="_cf_pieces", outputCol=out)
    return model.transform(df.withColumn("_cf_pieces", F.col(ids).cast("array<string>"))).drop("_cf_pieces")


def vocabulary_size(path: str) -> int:
    """Ids of a vocabulary file."""
    with open(path, "rb") as f:
        return Vocabulary(f.read(), "model" if path.endswith(".model") else "json").size
