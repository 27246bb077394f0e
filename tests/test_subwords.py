"""Sub-word ids against the tokenizer libraries themselves."""

import hashlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import subwords as S
from corpusflow.plans import q_subwords as Q

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a  b\t\n c  ", "日本語 テ", "<s>a</s> <unk>", "ﬁ ½ é 　x\x00y", "😀 " * 300, "word " * 4000, "a" * 5000, "x", "x"]


@pytest.fixture(scope="module")
def sp():
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=Q.vocabulary())


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, k, "old") for k, t in enumerate(ODD)], "id long, text string, n_subwords int, input_ids string")


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


@pytest.mark.parametrize("most,special", [(None, True), (None, False), (16, True), (16, False), (2, True), (0, False)])
def test_ids_of_odd_texts(odd, sp, most, special):
    got = {r["id"]: r for r in S.encode_subwords(odd, Q.vocabulary(), max_length=most, special=special).collect()}
    assert len(got) == len(ODD)
    for k, t in enumerate(ODD):
        ids = sp.encode(t or "")
        kept = ids if most is None else ids[:max(0, most - 2 * special)]
        assert got[k]["input_ids"] == ([1, *kept, 2] if special else kept), t
        assert got[k]["n_subwords"] == len(ids) and got[k]["n_spelt"] == sum(sp.is_byte(i) or sp.is_unknown(i) for i in ids)


def test_ids_of_the_other_kind_of_file(odd):
    from tokenizers import Tokenizer
    path = Q.vocabulary("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    tk.no_truncation()
    tk.no_padding()
    tk.encode_special_tokens = True
    e = S.encode_subwords(odd, path, max_length=None, special=False, drop_text=False)
    for r in S.decode_subwords(e, path, special=False).collect():
        assert r["input_ids"] == tk.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")
    assert S.vocabulary_size(path) == tk.get_vocab_size()


def test_empty_table_and_columns(spark, odd):
    none = S.encode_subwords(odd.where("id < 0"), Q.vocabulary())
    assert none.columns == ["id", "n_subwords", "n_spelt", "input_ids"] and none.count() == 0
    assert S.decode_subwords(none, Q.vocabulary()).count() == 0
    assert S.subword_coverage(none.withColumn("g", F.lit("x")), "g", F.lit(1)).count() == 0


def test_a_vocabulary_too_large_is_refused(odd, monkeypatch):
    monkeypatch.setattr(S, "VOCAB_BYTES", 1000)
    with pytest.raises(ValueError, match="vocabulary"):
        S.encode_subwords(odd, Q.vocabulary())


def test_roundtrip(spark, documents):
    got = {r["doc_id"]: r["text_sha"] for r in Q.q_subword_roundtrip(spark, SF).collect()}
    assert got == {i: hashlib.sha256(t.replace("▁", " ").encode()).hexdigest() for i, t in documents.items()}


def test_padded_ids_of_the_documents(spark, sp, documents):
    got = Q.q_subword_ids(spark, SF).collect()
    assert len(got) == len(documents)
    for r in got:
        ids = sp.encode(documents[r["doc_id"]])
        want = [1, *ids[:Q.MAX_LEN - 2], 2]
        assert r["n_subwords"] == len(ids) and r["mask_sum"] == len(want)
        assert r["input_ids"] == ",".join(map(str, want + [0] * (Q.MAX_LEN - len(want))))


def test_batches_are_padded_to_their_longest(spark, sp, documents):
    got = {r["doc_id"]: r for r in Q.q_subword_batches(spark, SF).collect()}
    order = sorted(documents)
    for at in range(0, len(order), 16):
        part = {i: [1, *sp.encode(documents[i])[:Q.BATCH_MAX_LEN - 2], 2] for i in order[at:at + 16]}
        width = max(map(len, part.values()))
        for i, ids in part.items():
            r = got[i]
            assert (r["batch_id"], r["padded_len"], r["mask_sum"]) == (at // 16, width, len(ids))
            assert r["input_ids"] == ",".join(map(str, ids + [0] * (width - len(ids))))


def test_coverage(spark, sp):
    want = {}
    for r in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        ids, w = sp.encode(r["text"] or ""), want.setdefault(r["lang"], [0] * 6)
        over = max(0, len(ids) - Q.MAX_LEN + 2)
        for k, x in enumerate((1, len((r["text"] or "").encode().split()), len(ids), sum(map(sp.is_byte, ids)), over > 0, over)):
            w[k] += x
    assert {r[0]: list(r[1:]) for r in Q.q_subword_coverage(spark, SF).collect()} == want


def test_counts_have_a_place_for_each_id(spark):
    df = spark.createDataFrame([(1, [5, 5, 0, 9]), (2, [])], "id long, input_ids array<int>")
    got = {r["id"]: r["_cf_tf"] for r in S.subword_counts(df, 10).collect()}
    assert got[1].toArray().tolist() == [1, 0, 0, 0, 0, 2, 0, 0, 0, 1] and got[2].numNonzeros() == 0


def test_training_on_subwords_learns(spark):
    got = Q.q_train_subwords(spark, "/root/testdata/sf0.01").collect()
    ones = sum(r["label"] for r in got)
    right = sum(r["label"] == r["pred"] for r in got)
    assert len(got) > 50 and right > max(ones, len(got) - ones)
