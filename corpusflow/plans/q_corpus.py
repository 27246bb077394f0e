"""Checked queries: sources, text scalars, curation, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import curate as C
from corpusflow.operators import split as X
from corpusflow.plans.fixtures import CORPUS_SQL, corpus, table
from corpusflow.plans.registry import query, with_ctes

KEYS = ["dataset_rank", "row_idx"]

# DuckDB (RE2) spellings of Python's whitespace class and its complement.
_WS = r"[\t-\r \x{1c}-\x{1f}\x{85}\p{Z}]"
_NWS = r"[^\t-\r \x{1c}-\x{1f}\x{85}\p{Z}]"


def _sql_clean_a(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower({x}), '(?:http|www){_NWS}+', '', 'g'), "
            f"'{_WS}+', ' ', 'g'))")


def _sql_clean_b(x: str) -> str:
    inner = f"regexp_replace(coalesce({x}, ''), 'http{_NWS}+|www\\.{_NWS}+', '', 'g')"
    inner = f"regexp_replace({inner}, '{_NWS}+@{_NWS}+', '', 'g')"
    return f"trim(regexp_replace({inner}, '{_WS}+', ' ', 'g'))"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


# ---------------------------------------------------------------- string labels

def _string_labels(spark, sf):
    lab = table(spark, sf, "labels")
    m = F.pmod(F.col("doc_id"), F.lit(5))
    s = (F.when(m == 1, " FAKE ").when(m == 2, "1.0").when(m == 3, "0").when(m == 4, F.lit(None))
         .otherwise(F.when(F.col("quality") == 1, "Fake").otherwise("Real")))
    return lab.select("doc_id", "quality", s.alias("label_str"))


_STRING_LABELS_SQL = """
slabels AS (
  SELECT doc_id, quality,
         CASE doc_id % 5 WHEN 1 THEN ' FAKE ' WHEN 2 THEN '1.0' WHEN 3 THEN '0' WHEN 4 THEN NULL
              ELSE CASE WHEN quality = 1 THEN 'Fake' ELSE 'Real' END END AS label_str
  FROM labels
)"""


@query("map_label", with_ctes(_STRING_LABELS_SQL) + """
SELECT doc_id, label_str, CASE label_str WHEN 'Real' THEN 0 WHEN 'Fake' THEN 1 END AS label FROM slabels""")
def q_map_label(spark, sf):
    return _string_labels(spark, sf).select(
        "doc_id", "label_str", T.map_label("label_str", {"Real": 0, "Fake": 1}).alias("label"))


@query("normalise_label", with_ctes(_STRING_LABELS_SQL) + f"""
SELECT doc_id, label_str,
  CASE WHEN lower({_sql_strip('label_str')}) IN ('real', '0', '0.0') THEN 0
       WHEN lower({_sql_strip('label_str')}) IN ('fake', '1', '1.0') THEN 1
       ELSE TRY_CAST(trunc(TRY_CAST(lower({_sql_strip('label_str')}) AS DOUBLE)) AS INTEGER) END AS label
FROM slabels""")
def q_normalise_label(spark, sf):
    return _string_labels(spark, sf).select(
        "doc_id", "label_str", T.normalise_label("label_str", mode="lenient", on_invalid="null").alias("label"))


@query("binarise_label", """
SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE quality END AS raw,
       CASE WHEN (CASE WHEN doc_id % 5 = 4 THEN NULL ELSE quality END) = 0 THEN 0 ELSE 1 END AS label
FROM labels""")
def q_binarise_label(spark, sf):
    lab = table(spark, sf, "labels")
    raw = F.when(F.pmod("doc_id", F.lit(5)) == 4, F.lit(None)).otherwise(F.col("quality"))
    return lab.select("doc_id", raw.alias("raw")).select("doc_id", "raw", T.binarise_label("raw").alias("label"))


@query("flip_polarity", "SELECT doc_id, quality, CAST(1 - quality AS INTEGER) AS label FROM labels")
def q_flip_polarity(spark, sf):
    return table(spark, sf, "labels").select("doc_id", "quality", T.flip_polarity("quality").alias("label"))


# ---------------------------------------------------------------- text scalars

@query("compose_text", """
SELECT page_id, concat_ws(' ', coalesce(CASE WHEN page_id % 10 = 0 THEN NULL ELSE url END, 'nan'),
                          coalesce(html, 'nan')) AS text
FROM pages""")
def q_compose_text(spark, sf):
    p = table(spark, sf, "pages")
    head = F.when(F.pmod("page_id", F.lit(10)) == 0, F.lit(None)).otherwise(F.col("url"))
    return p.select("page_id", T.compose_text(head, "html").alias("text"))


_SCRIPTS = {"hi": T.SCRIPT_RANGES["hi"], "kn": T.SCRIPT_RANGES["kn"], "ta": T.SCRIPT_RANGES["ta"],
            "ml": T.SCRIPT_RANGES["ml"], "latin1": "à-ÿ"}


@query("detect_script", """
SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') THEN 'hi'
                    WHEN regexp_matches(text, '[\\x{0C80}-\\x{0CFF}]') THEN 'kn'
                    WHEN regexp_matches(text, '[\\x{0B80}-\\x{0BFF}]') THEN 'ta'
                    WHEN regexp_matches(text, '[\\x{0D00}-\\x{0D7F}]') THEN 'ml'
                    WHEN regexp_matches(text, '[à-ÿ]') THEN 'latin1' ELSE 'en' END AS script
FROM documents""")
def q_detect_script(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.detect_script("text", _SCRIPTS).alias("script"))


_CLEAN_INPUT_SQL = """
rawtext AS (
  SELECT 'documents' AS src, doc_id AS id, text FROM documents
  UNION ALL SELECT 'pages', page_id, concat(url, ' see ', upper(url), ' ', html) FROM pages
)"""


def _clean_input(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), "text")
    p = table(spark, sf, "pages").select(
        F.lit("pages").alias("src"), F.col("page_id").alias("id"),
        F.concat(F.col("url"), F.lit(" see "), F.upper("url"), F.lit(" "), F.col("html")).alias("text"))
    return d.unionByName(p)


@query("clean_text_a", with_ctes(_CLEAN_INPUT_SQL) + f"SELECT src, id, {_sql_clean_a('text')} AS text FROM rawtext")
def q_clean_text_a(spark, sf):
    return _clean_input(spark, sf).select("src", "id", T.clean_text_a("text").alias("text"))


@query("clean_text_b", with_ctes(_CLEAN_INPUT_SQL) + f"SELECT src, id, {_sql_clean_b('text')} AS text FROM rawtext")
def q_clean_text_b(spark, sf):
    return _clean_input(spark, sf).select("src", "id", T.clean_text_b("text").alias("text"))


@query("augment_lowercase", with_ctes(CORPUS_SQL) + """
SELECT dataset_rank, row_idx, 'none' AS aug, text FROM corpus
UNION ALL SELECT dataset_rank, row_idx, 'lowercase', lower(text) FROM corpus""")
def q_augment_lowercase(spark, sf):
    c = corpus(spark, sf).select(*KEYS, "text")
    orig = c.select(*KEYS, F.lit("none").alias("aug"), "text")
    aug = c.select(*KEYS, F.lit("lowercase").alias("aug"), T.augment_text("text", "lowercase").alias("text"))
    return orig.unionByName(aug)


# ---------------------------------------------------------------- corpus

@query("canonical_corpus", with_ctes(CORPUS_SQL) + "SELECT * FROM corpus")
def q_canonical_corpus(spark, sf):
    return corpus(spark, sf)


@query("union_sources", with_ctes(CORPUS_SQL) + "SELECT dataset, dataset_rank, row_idx, label FROM corpus")
def q_union_sources(spark, sf):
    return corpus(spark, sf).select("dataset", *KEYS, "label")


@query("paired_source_label", """
SELECT doc_id AS row_idx, 0 AS label, 'documents' AS domain, lang AS language FROM documents WHERE doc_id % 2 = 0
UNION ALL
SELECT doc_id, 1, 'documents', lang FROM documents WHERE doc_id % 2 = 1""")
def q_paired_source_label(spark, sf):
    from corpusflow.sources.files import labelled_pair
    d = table(spark, sf, "documents")
    even = d.where(F.pmod("doc_id", F.lit(2)) == 0)   # "true" file
    odd = d.where(F.pmod("doc_id", F.lit(2)) == 1)    # "fake" file
    out = labelled_pair([(even, 0), (odd, 1)], domain="documents")
    return out.select(F.col("doc_id").alias("row_idx"), "label", "domain", F.col("lang").alias("language"))


@query("single_class_source", """
SELECT item_id AS row_idx, text, 0 AS label, 'authentic' AS domain, 'en' AS language FROM benchmark""")
def q_single_class_source(spark, sf):
    from corpusflow.sources.files import tag_source
    b = table(spark, sf, "benchmark")
    return tag_source(b, label=0, domain="authentic", language="en").select(
        F.col("item_id").alias("row_idx"), "text", "label", "domain", "language")


@query("source_report", with_ctes(CORPUS_SQL) + """
SELECT dataset_rank, dataset, count(*) AS n_rows, count(*) FILTER (WHERE label = 1) AS n_fake
FROM corpus GROUP BY dataset_rank, dataset""")
def q_source_report(spark, sf):
    return C.source_report(corpus(spark, sf))


@query("drop_blank", with_ctes(CORPUS_SQL) + f"""
SELECT dataset_rank, row_idx, text FROM (SELECT dataset_rank, row_idx, {_sql_clean_b('text')} AS text FROM corpus)
WHERE text IS NOT NULL AND length({_sql_strip('text')}) > 0""")
def q_drop_blank(spark, sf):
    c = C.clean(corpus(spark, sf), "b").select(*KEYS, "text")
    return C.drop_blank(c)


@query("min_length", with_ctes(CORPUS_SQL) + f"""
SELECT dataset_rank, row_idx, CAST(length(text) AS INTEGER) AS n_chars FROM
  (SELECT dataset_rank, row_idx, {_sql_clean_a('text')} AS text FROM corpus) WHERE length(text) > 10""")
def q_min_length(spark, sf):
    c = C.min_length(C.clean(corpus(spark, sf), "a"), 10)
    return c.select(*KEYS, F.length("text").alias("n_chars"))


_CLEAN_A_SQL = f"""
cleaned AS (
  SELECT {_sql_clean_a('text')} AS text, label, domain, language, dataset, dataset_rank, row_idx FROM corpus
)"""
_DEDUP_SQL = """
deduped AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY dataset_rank, row_idx) AS rn FROM cleaned)
  WHERE rn = 1
)"""


def deduped(spark, sf, cleaner="a", min_len=None, materialize=False):
    """Clean -> (min length) -> keep-first dedupe. ``materialize`` writes the result
    once to the shared checkpoint folder for flows that read it several times (split quotas,
    offsets and ranks); it survives lost executors and leaves nothing cached."""
    c = C.clean(corpus(spark, sf), cleaner)
    if min_len is not None:
        c = C.min_length(c, min_len)
    d = C.dedupe_first(c, narrow=True)
    return d.checkpoint() if materialize else d


@query("dedupe_first", with_ctes(CORPUS_SQL, _CLEAN_A_SQL, _DEDUP_SQL) + "SELECT * FROM deduped")
def q_dedupe_first(spark, sf):
    return deduped(spark, sf)


@query("corpus_distribution", with_ctes(CORPUS_SQL, _CLEAN_A_SQL, _DEDUP_SQL) + """
SELECT 'label' AS "column", CAST(label AS VARCHAR) AS value, count(*) AS n FROM deduped GROUP BY label
UNION ALL SELECT 'language', language, count(*) FROM deduped GROUP BY language
UNION ALL SELECT 'dataset', dataset, count(*) FROM deduped GROUP BY dataset""")
def q_corpus_distribution(spark, sf):
    return C.distribution(deduped(spark, sf), ["label", "language", "dataset"])


@query("stratum_counts", with_ctes(CORPUS_SQL) + """
SELECT concat_ws('_', CAST(label AS VARCHAR), domain) AS stratum, count(*) AS n FROM corpus GROUP BY 1""")
def q_stratum_counts(spark, sf):
    return corpus(spark, sf).groupBy(X.stratum_key("label", "domain").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
