"""The registered queries op1 .. op13 and, where SQL can express one, its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, html_crf, importance, language, line_dedup, packing, pii, prefix_trie, quality, quality_trees, simhash,
               token_counts, tree_bpe)
from .common import read, sha256

WORDS = r"regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"     # length of a text in words


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = tree_bpe.bpe_encode_decode(docs, tokenizer("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
                      sha256(F.col("decoded")).alias("decoded_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(read(spark, sf_dir, "documents").select("doc_id", "text"), WORDS)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_crf.extract_text(pages, html_crf.fit_extractor(pages)).select("page_id", "url", "text", "n_chars")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def of_kind(k: int):
        return lambda x: x["k"] == k

    count = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *count, sha256(pii.spans_text(F.col("base"))).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit_languages(read(spark, sf_dir, "documents").select("lang", "text"))
    return language.language_id(read(spark, sf_dir, "pages").select("page_id", "url", "html"), model)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, tokenizer("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"))
    return quality.quality_rules(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                      "n_repeat_words", "base_failed", "kept", "quality_p")


def op11_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    model = quality_trees.fit_quality_trees(docs, read(spark, sf_dir, "labels").where(~held))
    return quality_trees.score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = prefix_trie.sequences(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_trie.prefix_trie(prefix_trie.share_starts(seq)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resampling_scores(docs, read(spark, sf_dir, "benchmark").select("text"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_bpe, op3_packing, op4_html_extraction, op5_pii, op6_language_id,
                                   op7_simhash, op8_token_counts, op9_ann, op10_quality, op11_quality_trees, op12_prefix_trie,
                                   op13_importance)}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: CRC-32 of a string in DuckDB SQL: its table by the rule of the polynomial, then a fold over the UTF-8 bytes.
_CRC_TABLE = ("SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, x: "
              "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc")


def _words(text: str) -> str:
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _crc32(s: str) -> str:
    codes = f"list_transform(range(octet_length(encode({s}))), lambda i: ('0x' || substr(hex(encode({s})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295] || {codes}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


SQL = {
    "op1_line_dedup": f"""
WITH l AS (SELECT d.rowid AS r, d.doc_id, u.i, u.line,
                  translate(trim(u.line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT row_number() OVER () AS rowid, doc_id, coalesce(text, '') AS text FROM documents) d,
                LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line,
                                generate_subscripts(string_split(d.text, chr(10)), 1) AS i) u),
     f AS (SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
     m AS (SELECT l.*, f.k IS NOT NULL AND l.doc_id <> f.keep AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id""",
    "op12_prefix_trie": f"""
WITH tab AS ({_CRC_TABLE}),
     o AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS s
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
     h AS (SELECT o.*, ({_crc32("conv_id::VARCHAR")}) % 9 AS h FROM o, tab),
     b AS (SELECT h.conv_id, list_concat(coalesce(base.s[1:h.h], []), h.s[h.h + 1:]) AS s
           FROM h LEFT JOIN o base ON base.conv_id = h.conv_id - h.conv_id % 5),
     p AS (SELECT b.conv_id, d, len(b.s) AS len, to_json(b.s[1:d]) AS k, CASE WHEN d > 0 THEN to_json(b.s[1:d - 1]) END AS pk,
                  CASE WHEN d > 0 THEN octet_length(encode(b.s[d].t)) ELSE 0 END AS size,
                  list_transform(range(d + 1), lambda j: to_json(b.s[1:j])) AS above
           FROM b, LATERAL (SELECT unnest(range(len(b.s) + 1)) AS d)),
     n AS (SELECT d, k, min(pk) AS pk, min(conv_id) AS c, count(*) AS n, bool_and(len = d) AS leaf, min(size) AS size, min(above) AS above,
                  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len = d), '')) AS ends
           FROM p GROUP BY d, k),
     u AS (SELECT a.k, count(*) FILTER (WHERE leaf) AS leaves, sum((n - 1) * size) AS saved
           FROM (SELECT unnest(above) AS k, leaf, n, size FROM n) a GROUP BY a.k),
     ch AS (SELECT pk, count(*) AS children FROM n GROUP BY pk)
SELECT n.c::BIGINT AS conv_id, n.d::BIGINT AS depth, par.c::BIGINT AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(ch.children, 0)::BIGINT AS n_children,
       u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN u ON u.k = n.k LEFT JOIN ch ON ch.pk = n.k LEFT JOIN n par ON par.k = n.pk""",
    "op13_importance": f"""
WITH tab AS ({_CRC_TABLE}),
     w AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents),
     dw AS (SELECT r, unnest(w) AS f FROM w),
     tw AS (SELECT unnest({_words("text")}) AS f FROM benchmark),
     fs AS (SELECT f, ({_crc32("f")}) % 10000 AS b FROM (SELECT f FROM dw UNION SELECT f FROM tw), tab),
     s AS (SELECT b, count(*) AS s FROM dw JOIN fs USING (f) GROUP BY b),
     t AS (SELECT b, count(*) AS t FROM tw JOIN fs USING (f) GROUP BY b),
     g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
                  / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (b)),
     dg AS (SELECT r, sum(gain) AS weight FROM dw JOIN fs USING (f) JOIN g USING (b) GROUP BY r),
     sc AS (SELECT w.r, w.doc_id, len(w.w) AS n, coalesce(dg.weight, 0)::BIGINT AS weight,
                   (coalesce(dg.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
            FROM w LEFT JOIN dg USING (r)),
     rk AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n >= 20)
SELECT sc.doc_id, sc.n::BIGINT AS n_features, sc.weight, sc.score, CASE WHEN rk.rank <= 10 * (SELECT count(*) FROM rk) // 100 THEN rk.rank END::BIGINT AS rank
FROM sc LEFT JOIN rk USING (r)""",
}
