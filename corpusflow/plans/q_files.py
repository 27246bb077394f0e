"""Checked queries that go through files: CSV sources, JSONL telemetry, saved splits, history.

Each writes what it derives from the given tables to a fresh folder under the shared checkpoint
folder and reads it back with the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import curate as C
from corpusflow.operators import telemetry as R
from corpusflow.plans.fixtures import (CORPUS_SQL, HISTORY_SQL, TELEMETRY_SQL, TSERIES_SQL, entries_from_series, history, table,
                                       telemetry_series)
from corpusflow.plans.q_corpus import _CLEAN_A_SQL, _DEDUP_SQL
from corpusflow.plans.q_split import _X4, split3
from corpusflow.plans.registry import query, with_ctes
from corpusflow.session import scratch_path
from corpusflow.sources import files as S
from corpusflow.sources import sinks as K

# CSV options under which any text survives the round trip.
_CSV = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False, "emptyValue": ""}


def _write_csv(df, path: str, key: str) -> str:
    """Part files in key order, so that the order of files and rows is the order of the key."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.options(**_CSV).csv(path)
    return path


@query("csv_corpus", """
WITH docs AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'shared ' || (doc_id % 70)::VARCHAR ELSE text END AS text, lang FROM documents),
src AS (
  SELECT text, (doc_id % 2)::INTEGER AS label, 'paired' AS domain, lang AS language, 'pair' AS dataset, 0 AS rk, doc_id % 2 AS part, doc_id AS k FROM docs
  UNION ALL
  SELECT 'labelled ' || (d.doc_id % 90)::VARCHAR, l.quality, d.source, d.lang, 'labels', 1, 0, d.doc_id FROM labels l JOIN documents d USING (doc_id)
  UNION ALL
  SELECT text, 0, 'authentic', 'en', 'benchmark', 2, 0, item_id FROM benchmark)
SELECT dataset, rk AS dataset_rank, label, domain, language, sha256(text) AS text_sha FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY rk, part, k) AS rn FROM src WHERE text IS NOT NULL AND label IS NOT NULL)
WHERE rn = 1""")
def q_csv_corpus(spark, sf):
    """S1, S3-S6, P5, U2 from files: a pair of files that share texts (the first one wins), labels written
    as ``1.0``, a single-class source, a missing optional source; then keep-first dedupe."""
    base = scratch_path(spark, "csv")
    docs = table(spark, sf, "documents").select("doc_id", F.when(
        F.col("doc_id") % 5 == 0, F.concat(F.lit("shared "), F.col("doc_id") % 70)).otherwise(F.col("text")).alias("text"), "lang")
    true = _write_csv(docs.where("doc_id % 2 = 0"), f"{base}/true", "doc_id")
    fake = _write_csv(docs.where("doc_id % 2 = 1"), f"{base}/fake", "doc_id")
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        "doc_id", F.concat(F.lit("labelled "), F.col("doc_id") % 90).alias("headline"),
        F.col("quality").cast("double").cast("string").alias("label"), "source", "lang")
    labels = _write_csv(lab, f"{base}/labels", "doc_id")
    bench = _write_csv(table(spark, sf, "benchmark").select("item_id", "text"), f"{base}/benchmark", "item_id")
    specs = [
        S.SourceSpec("pair", lambda s: S.read_labelled_pair(s, {true: 0, fake: 1}, domain="paired"),
                     text=F.col("text"), label=F.col("label"), domain=F.col("domain"), language=F.col("lang")),
        S.SourceSpec("labels", lambda s: S.read_csv_source(s, labels), text=lambda d: S.resolve_text_column(d), label=F.col("label"),
                     domain=F.col("source"), language=F.col("lang"), strict_label=True),
        S.SourceSpec("benchmark", lambda s: S.read_csv_source(s, bench), text=F.col("text"), label=0, domain="authentic", language="en"),
        S.SourceSpec("absent", lambda s: S.read_csv_source(s, f"{base}/absent"), text=F.col("text"), label=0, optional=True),
    ]
    df, _ = S.load_corpus(spark, specs)
    return C.dedupe_first(df, narrow=True).select("dataset", "dataset_rank", "label", "domain", "language", F.sha2("text", 256).alias("text_sha"))


_FILE_LINES = 500_000     # lines of a telemetry file
_PLAIN_LINES = 1_000_000  # a log of more lines is compressed


@query("jsonl_telemetry", with_ctes(TELEMETRY_SQL, TSERIES_SQL) + """
SELECT seq, host, mem_percent, has_process, vm_restarted, array_to_string(alerts, ' | ') AS alerts FROM tseries""")
def q_jsonl_telemetry(spark, sf):
    """S8, R1, R8, R11, R14 from files (long logs compressed): each host's samples in two files or more, between malformed
    lines (single quotes, trailing junk, cut off, blank) that the strict reader drops."""
    src = scratch_path(spark, "jsonl")
    # files of bounded size: their number grows with the samples (a count from the table's footers)
    n_lines = 5 * table(spark, sf, "events").count()
    n_files = max(2, -(-n_lines // _FILE_LINES))
    # events are dealt to the files, not their lines, which take many times their bytes; the lines of a sample lie side by side,
    # so they compress well
    lines = entries_from_series(telemetry_series(spark, sf, restarts=False, alerts=False, parts=n_files))
    bad = F.array(F.col("value"), F.translate("value", '"', "'"), F.concat("value", F.lit(" junk")),
                  F.expr("substring(value, 1, length(value) div 2)"), F.lit(""))
    K.append_jsonl(lines.select(F.explode(bad).alias("value")), src, "gzip" if n_lines > _PLAIN_LINES else None)
    # the restarts read their input three times; what they and the alerts need is written once, so a line is parsed once
    samples = scratch_path(spark, "samples")
    R.flatten(S.read_telemetry(spark, src)).select("host", "seq", "mem_percent", "cpu_percent", "disk_percent", "swap_percent", "has_process",
                                                   "process_status", "boot_time").write.parquet(samples)
    flat = R.detect_restarts(spark.read.parquet(samples))
    return R.alerts(flat).select("seq", F.col("host").cast("long").alias("host"), "mem_percent", "has_process", "vm_restarted",
                                 F.array_join("alerts", " | ").alias("alerts"))


@query("saved_splits", with_ctes(CORPUS_SQL, _CLEAN_A_SQL, _DEDUP_SQL, _X4) + """
SELECT split, domain, CAST(label AS INTEGER) AS label, count(*) AS n FROM splitted GROUP BY split, domain, label""")
def q_saved_splits(spark, sf):
    """Splits written once, found by the next run, labels normalised."""
    path = scratch_path(spark, "splits")
    K.write_splits(split3(spark, sf).withColumn("label", F.concat(F.col("label"), F.lit(".0"))), path)
    got = S.load_or_make_splits(spark, path, lambda: None)
    return got.groupBy("split", "domain", "label").agg(F.count("*").alias("n"))


@query("history_appended", with_ctes(HISTORY_SQL) + "SELECT run_id, epoch, val_f1 FROM history")
def q_history_appended(spark, sf):
    """H3: epochs appended to one table as they end."""
    path, h = scratch_path(spark, "history"), history(spark, sf)
    for part in ("epoch <= 10", "epoch > 10 AND epoch <= 20", "epoch > 20"):
        K.append_history(h.where(part), path)
    return spark.read.parquet(path).select("run_id", "epoch", "val_f1")


# What a cell may hold that reads as missing.
_MISSING = ["", "NA", "None", "n/a", "null", "nan", "#N/A", "-NaN"]


@query("csv_semicolon", f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 < 8 THEN {_MISSING}[doc_id % 9 + 1] ELSE 'title; of "' || doc_id || '"' END AS title,
                  CASE WHEN doc_id % 11 = 0 THEN 'NULL' ELSE text END AS text, CASE doc_id % 4 WHEN 0 THEN ' Real' WHEN 1 THEN 'FAKE ' WHEN 2 THEN '0' ELSE '1' END AS label FROM documents)
SELECT doc_id, doc_id % 9 < 8 AS no_title, CASE WHEN doc_id % 9 = 8 THEN title END AS title,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE sha256(text) END AS text_sha, (doc_id % 4 % 2)::INTEGER AS label, 'unknown' AS domain FROM d""")
def q_csv_semicolon(spark, sf):
    """S2, P1, P6, P11, P17, P18 from `;` files: missing-value words, quoted separators and line ends, strict labels, a column
    added, a text found by rules and by name."""
    from corpusflow.functions.text import normalise_label
    i = F.col("doc_id")
    docs = table(spark, sf, "documents").select(
        "doc_id", F.when(i % 9 < 8, F.element_at(F.array(*map(F.lit, _MISSING)), (i % 9 + 1).cast("int"))).otherwise(F.concat(F.lit('title; of "'), i, F.lit('"'))).alias("title"),
        F.when(i % 11 == 0, F.lit("NULL")).otherwise(F.col("text")).alias("news_content"),
        F.element_at(F.array(*map(F.lit, (" Real", "FAKE ", "0", "1"))), (i % 4 + 1).cast("int")).alias("label"))
    path = scratch_path(spark, "semicolon")
    docs.write.options(**_CSV, sep=";").csv(path)           # a file per task, each read by as many tasks as it is cut into
    df = S.ensure_column(S.read_csv_source(spark, path, sep=";"), "domain", "unknown")
    text = S.resolve_text(df.drop("doc_id", "title"), [("headline", "content"), "text"], exclude=("label", "domain", "source_file", "row_idx"))
    by_name = S.resolve_text_column(df, priority=(), contains=("content",))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("title").isNull().alias("no_title"), "title",
                     F.when(text.eqNullSafe(by_name), F.sha2(text, 256)).alias("text_sha"), normalise_label("label").alias("label"), "domain")


@query("run_logs", """
SELECT lang AS model, (floor(10000.0 * sum(quality) / count(*)) / 100.0 / 100.0)::DOUBLE AS accuracy
FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def q_run_logs(spark, sf):
    """A log per language whose first accuracy line counts; lines that look alike do not."""
    acc = (table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").groupBy("lang")
           .agg(F.floor(F.lit(10000) * F.sum("quality") / F.count(F.lit(1))).alias("p")))
    pct = F.concat(F.floor(F.col("p") / 100).cast("string"), F.lit("."), F.lpad((F.col("p") % 100).cast("string"), 2, "0"))
    lines = F.array(F.lit("epoch 1: loss 0.5"), F.lit("Accuracy: 0.1 (10.00%)"), F.concat(F.lit("Final Accuracy: 0."), F.col("p"), F.lit(" ("), pct, F.lit("%)")),
                    F.lit("Final Accuracy: 0.01 (1.00%)"))
    path = scratch_path(spark, "logs")
    acc.select(F.col("lang").alias("model"), F.array_join(lines, "\n").alias("value")).write.partitionBy("model").text(path)
    return S.parse_run_logs(spark, path, model_from="folder")


@query("results_record", """
WITH s AS (SELECT quality AS label, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS pred FROM labels JOIN documents USING (doc_id)),
h AS (SELECT max(v) AS v FROM (SELECT round(avg(value) / 100, 6) AS v FROM events GROUP BY event_type, extract(day FROM ts)))
SELECT avg((label = pred)::INTEGER)::DOUBLE AS accuracy, count(*) AS n, any_value(h.v) AS best_val_f1 FROM s, h""")
def q_results_record(spark, sf):
    """K2: the nested result record, written as JSON and read back."""
    s = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        F.col("quality").alias("label"), F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("pred"))
    m = s.agg(F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "results")
    K.write_results(K.results_record(m, history(spark, sf).agg(F.max("val_f1").alias("best"))), path)
    return spark.read.json(path).select("test_metrics.accuracy", "test_metrics.n", "best_val_f1")


@query("missing_log", "SELECT true AS missing_raises, 0::BIGINT AS n_entries, 2 * count(*) AS malformed, count(*) AS blank FROM labels")
def q_missing_log(spark, sf):
    """A missing log raises, a log without one valid line gives an empty table and is counted."""
    from pyspark.errors import AnalysisException
    lines = table(spark, sf, "labels").select(F.explode(F.array(F.concat(F.lit("{bad "), "doc_id"), F.lit(" "), F.lit("[1]"))).alias("value"))
    path = scratch_path(spark, "badlog")
    K.append_jsonl(lines, path)
    try:
        S.read_telemetry(spark, path + "-absent").schema
        raised = False
    except AnalysisException:
        raised = True
    n = S.read_telemetry(spark, path).agg(F.count(F.lit(1)).alias("n_entries"))
    return S.count_malformed(spark, path).crossJoin(n).select(F.lit(raised).alias("missing_raises"), "n_entries", "malformed", "blank")
