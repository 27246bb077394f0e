"""Inputs of the reference re-derived from the driver tables (FIXTURES.md §2).

Every derivation is a projection/join of the given tables, so its work grows with them.
The ``*_SQL`` strings are the same derivations for the DuckDB oracle (used as CTEs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.curate import drop_incomplete, union_sources


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan a driver table; ``spark.sql.files.maxPartitionBytes`` decides its splits."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TURNS = 1 << 32    # turns of a conversation stay below it, so (conv_id, turn) is one unique order key


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical tagged corpus (D3) from three sources, nulls dropped (F1)."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = docs.join(labels, "doc_id", "left").select(
        F.col("text"), F.col("quality").cast("int").alias("label"), F.col("source").alias("domain"),
        F.col("lang").alias("language"), F.lit("documents").alias("dataset"),
        F.lit(0).alias("dataset_rank"), F.col("doc_id").alias("row_idx"))
    b = table(spark, sf_dir, "benchmark").select(
        F.col("text"), F.lit(0).alias("label"), F.lit("benchmark").alias("domain"),
        F.lit("en").alias("language"), F.lit("benchmark").alias("dataset"),
        F.lit(1).alias("dataset_rank"), F.col("item_id").alias("row_idx"))
    c = table(spark, sf_dir, "conversations").select(
        F.col("text"), F.when(F.col("role") == "assistant", 1).otherwise(0).alias("label"),
        F.col("role").alias("domain"), F.lit("unknown").alias("language"),
        F.lit("conversations").alias("dataset"), F.lit(2).alias("dataset_rank"),
        (F.col("conv_id") * TURNS + F.col("turn")).alias("row_idx"))
    return drop_incomplete(union_sources([d, b, c]))


CORPUS_SQL = """
corpus AS (
  SELECT * FROM (
    SELECT d.text, CAST(l.quality AS INTEGER) AS label, d.source AS domain, d.lang AS language,
           'documents' AS dataset, 0 AS dataset_rank, d.doc_id AS row_idx
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    UNION ALL
    SELECT text, 0, 'benchmark', 'en', 'benchmark', 1, item_id FROM benchmark
    UNION ALL
    SELECT text, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END, role, 'unknown', 'conversations', 2,
           conv_id * 4294967296 + turn FROM conversations
  ) WHERE text IS NOT NULL AND label IS NOT NULL AND domain IS NOT NULL AND language IS NOT NULL
)"""


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⋈ labels as a canonical corpus (rank 0 only; the other sources are not scanned)."""
    return corpus(spark, sf_dir).where(F.col("dataset_rank") == 0)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q_SCORED: labelled docs with logit z, second-pass z2 and batch ids of 16 in doc_id
    order; ``logits = [0, z]``, ``logits2 = [0, z2]``."""
    from corpusflow.operators.split import assign_batches
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = lab.join(docs, "doc_id").select(
        "doc_id", F.col("lang").alias("domain"), F.col("quality").alias("label"),
        ((F.col("n_chars") - 1500).cast("double") / 1000.0).alias("z"))
    j = j.withColumn("z2", F.col("z") + (F.pmod(F.col("doc_id"), F.lit(7)) - 3) / 10.0)
    j = j.withColumn("logits", F.array(F.lit(0.0), F.col("z"))).withColumn("logits2", F.array(F.lit(0.0), F.col("z2")))
    return assign_batches(j, 16, order="doc_id").drop("epoch", "position")


SCORED_SQL = """
scored AS (
  SELECT l.doc_id, d.lang AS domain, l.quality AS label,
         CAST(d.n_chars - 1500 AS DOUBLE) / CAST(1000 AS DOUBLE) AS z,
         CAST(d.n_chars - 1500 AS DOUBLE) / CAST(1000 AS DOUBLE) + CAST((l.doc_id % 7) - 3 AS DOUBLE) / 10.0 AS z2,
         CAST(floor((row_number() OVER (ORDER BY l.doc_id) - 1) / CAST(16 AS DOUBLE)) AS BIGINT) AS batch_id
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q_HISTORY: run = event_type, epoch = day of month, val_f1 = mean value / 100."""
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.col("event_type").alias("run_id"), F.dayofmonth("ts").cast("int").alias("epoch"))
            .agg(F.round(F.avg("value") / 100, 6).alias("val_f1")))


HISTORY_SQL = """
history AS (
  SELECT event_type AS run_id, CAST(extract(day FROM ts) AS INT) AS epoch,
         round(avg(value) / 100, 6) AS val_f1
  FROM events GROUP BY event_type, CAST(extract(day FROM ts) AS INT)
)"""


def telemetry_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q_TELEMETRY: flat telemetry series (host = user_id, seq = event_id)."""
    ev = table(spark, sf_dir, "events")
    v = F.col("value")
    return ev.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("host"), F.col("ts"),
        F.least(F.lit(100.0), v).alias("mem_percent"),
        F.least(F.lit(100.0), v / 2).alias("cpu_percent"),
        F.least(F.lit(100.0), v / 4).alias("disk_percent"),
        F.least(F.lit(100.0), v / 2).alias("swap_percent"),
        F.when(F.col("event_type") == "error", "not_found").when(F.col("event_type") == "click", "zombie")
        .otherwise("running").alias("process_status"),
        (F.floor(F.dayofmonth("ts") / 10.0).cast("long")
         + F.when(F.col("event_type") == "signup", 1).otherwise(0)).alias("boot_time"))


TELEMETRY_SQL = """
telemetry AS (
  SELECT event_id AS seq, user_id AS host, ts,
         least(CAST(100 AS DOUBLE), value) AS mem_percent,
         least(CAST(100 AS DOUBLE), value / 2) AS cpu_percent,
         least(CAST(100 AS DOUBLE), value / 4) AS disk_percent,
         least(CAST(100 AS DOUBLE), value / 2) AS swap_percent,
         CASE WHEN event_type = 'error' THEN 'not_found' WHEN event_type = 'click' THEN 'zombie' ELSE 'running' END AS process_status,
         CAST(floor(extract(day FROM ts) / CAST(10 AS DOUBLE)) AS BIGINT) + CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS boot_time
  FROM events
)"""


def telemetry_series(spark: SparkSession, sf_dir: str, restarts: bool = True, alerts: bool = True, parts: int | None = None) -> DataFrame:
    """Q_TELEMETRY widened to the flat telemetry form (one projection of ``events``):
    companion GB values, an absent process on some samples, an error key on some missing
    ones; then, on demand, R11 restarts and R8 alerts. ``parts`` deals the events to as many
    partitions before anything is derived from them."""
    from corpusflow.operators.telemetry import alerts as add_alerts
    from corpusflow.operators.telemetry import detect_restarts
    ev = table(spark, sf_dir, "events")
    if parts:
        ev = ev.repartition(parts, "event_id", "user_id", "ts")
    v, et = F.col("value"), F.col("event_type")
    mem, cpu = F.least(F.lit(100.0), v), F.least(F.lit(100.0), v / 2)
    disk, swap = F.least(F.lit(100.0), v / 4), F.least(F.lit(100.0), v / 2)
    status = F.when(et == "error", "not_found").when(et == "click", "zombie").otherwise("running")
    has_proc = ~((et == "view") & (v < 5))
    t = ev.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("host"), "ts",
        mem.alias("mem_percent"), (mem * 0.64).alias("mem_used_gb"), (F.lit(64.0) - mem * 0.64).alias("mem_available_gb"),
        cpu.alias("cpu_percent"), disk.alias("disk_percent"), ((F.lit(100.0) - disk) * 5.0).alias("disk_free_gb"),
        swap.alias("swap_percent"), (swap * 0.16).alias("swap_used_gb"), has_proc.alias("has_process"),
        F.when(has_proc, status).alias("process_status"),
        F.when(has_proc & (et == "error") & (F.pmod("event_id", F.lit(2)) == 0),
               F.lit("process no longer exists")).alias("process_error"),
        (F.floor(F.dayofmonth("ts") / 10.0).cast("long") + F.when(et == "signup", 1).otherwise(0)).alias("boot_time"))
    if restarts:
        t = detect_restarts(t)
    if alerts:
        t = add_alerts(t)
    return t


TSERIES_SQL = """
tseries0 AS (
  SELECT t.seq, t.host, t.ts, t.mem_percent, t.mem_percent * 0.64 AS mem_used_gb, 64.0 - t.mem_percent * 0.64 AS mem_available_gb,
         t.cpu_percent, t.disk_percent, (100.0 - t.disk_percent) * 5.0 AS disk_free_gb, t.swap_percent,
         t.swap_percent * 0.16 AS swap_used_gb, NOT (e.event_type = 'view' AND e.value < 5) AS has_process,
         CASE WHEN NOT (e.event_type = 'view' AND e.value < 5) THEN t.process_status END AS process_status,
         CASE WHEN NOT (e.event_type = 'view' AND e.value < 5) AND t.process_status = 'not_found' AND t.seq % 2 = 0
              THEN 'process no longer exists' END AS process_error,
         t.boot_time
  FROM telemetry t JOIN events e ON t.seq = e.event_id
),
tseries1 AS (
  SELECT *, max(boot_time) OVER (PARTITION BY host ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_boot,
            first(boot_time ORDER BY seq) OVER (PARTITION BY host) AS first_boot
  FROM tseries0
),
tseries AS (
  SELECT * EXCLUDE (prev_boot, first_boot),
         coalesce(first_boot IS NOT NULL AND boot_time IS NOT NULL AND prev_boot IS NOT NULL AND boot_time > prev_boot, false) AS vm_restarted,
         list_filter([
           CASE WHEN mem_percent > 90 THEN 'HIGH MEMORY: ' || printf('%.1f', mem_percent) || '% (threshold: 90%)' END,
           CASE WHEN cpu_percent > 95 THEN 'HIGH CPU: ' || printf('%.1f', cpu_percent) || '% (threshold: 95%)' END,
           CASE WHEN disk_percent > 90 THEN 'HIGH DISK: ' || printf('%.1f', disk_percent) || '% (threshold: 90%)' END,
           CASE WHEN swap_percent > 80 THEN 'HIGH SWAP: ' || printf('%.1f', swap_percent) || '% - System is using swap memory heavily!' END,
           CASE WHEN has_process AND process_status = 'zombie' THEN 'PROCESS ZOMBIE: Process is in zombie state!' END,
           CASE WHEN NOT has_process OR process_status = 'not_found' THEN 'PROCESS NOT FOUND: run.py process is not running!' END
         ], lambda x: x IS NOT NULL) AS alerts
  FROM tseries1
)"""


def entries_from_series(series: DataFrame) -> DataFrame:
    """Flat samples -> nested telemetry entries (one JSON object per line; absent
    fields are omitted, so an absent process stays absent)."""
    proc = F.when(F.col("has_process"), F.struct(
        F.lit(4242).alias("pid"), F.col("process_status").alias("status"),
        F.lit(1.5).alias("memory_rss_gb"), F.lit(3.0).alias("memory_vms_gb"), F.lit(99.0).alias("cpu_percent"),
        F.lit(12).alias("num_threads"), F.lit(40).alias("open_files"), F.lit(3).alias("connections"),
        F.col("process_error").alias("error")))
    metrics = F.struct(
        F.struct(F.lit(64.0).alias("total_gb"), F.col("mem_available_gb").alias("available_gb"),
                 F.col("mem_used_gb").alias("used_gb"), F.col("mem_percent").alias("percent"),
                 F.lit(16.0).alias("swap_total_gb"), F.col("swap_used_gb").alias("swap_used_gb"),
                 F.col("swap_percent").alias("swap_percent")).alias("memory"),
        F.struct(F.col("cpu_percent").alias("percent"), F.lit(8).alias("count")).alias("cpu"),
        F.struct(F.lit(500.0).alias("total_gb"), (F.lit(500.0) - F.col("disk_free_gb")).alias("used_gb"),
                 F.col("disk_free_gb").alias("free_gb"), F.col("disk_percent").alias("percent")).alias("disk"),
        proc.alias("process"))
    return series.select(F.to_json(F.struct(
        F.col("host").cast("string").alias("host"), F.col("seq"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("boot_time").cast("double").alias("boot_time"), metrics.alias("metrics"))).alias("value"))
