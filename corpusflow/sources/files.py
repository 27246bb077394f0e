"""Sources: CSV layouts, paired files, source sets, saved splits, JSONL telemetry, run logs."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import PANDAS_NA
from corpusflow.session import scratch_path
from corpusflow.sources.csv_split import csv_records, files_of

CANONICAL_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType()),
    T.StructField("domain", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("dataset", T.StringType()), T.StructField("dataset_rank", T.IntegerType()),
    T.StructField("row_idx", T.LongType()),
])


FILE_STRIDE = 1 << 33    # rows of one file; ids of a split stay below it
PART_STRIDE = 1 << 53    # rows of one part of a pair
LISTED_FILES = 100_000   # a listing of at most so many files is broadcast


def string_schema(cols: list[str]) -> T.StructType:
    """All-string schema: labels and ids are cast explicitly later (``try_cast``)."""
    return T.StructType([T.StructField(c, T.StringType()) for c in cols])


def read_csv_source(spark: SparkSession, path, schema: T.StructType | None = None, sep: str = ",",
                    encoding: str = "UTF-8", na_tokens=PANDAS_NA, row_index: bool = True, splittable: bool = True) -> DataFrame:
    """CSV with header; quoted separators, quoted newlines and doubled quotes are
    legal. NA tokens become null (P1).

    A file is read by as many tasks as Spark cuts it into byte ranges (:mod:`corpusflow.sources.csv_split`): records
    are found first, then their fields by the JVM's parser. Other encodings than UTF-8, separators of several
    characters and ``splittable=False`` (for files whose lines end in bare carriage returns) are read by one
    task per file.

    ``row_index`` adds ``source_file`` and ``row_idx``, unique in the source and in reading order: the rank of
    the file by path times ``FILE_STRIDE`` plus the position of the row in the file."""
    options = {"header": "true", "sep": sep, "encoding": encoding, "multiLine": "true", "escape": '"', "mode": "PERMISSIVE"}
    r = spark.read.options(**options)
    df = (r.schema(schema) if schema is not None else r).csv(path)
    if splittable and len(sep) == 1 and encoding.upper() in ("UTF-8", "UTF8") and df.columns:
        df = _parse_records(csv_records(spark, path, sep), df.schema, options)
    elif row_index:
        # a multi-line scan never cuts a file, so the generated ids of its rows are consecutive
        df = df.withColumn("source_file", F.col("_metadata.file_path")).withColumn("_cf_mid", F.monotonically_increasing_id())
        first = df.groupBy("source_file").agg(F.min("_cf_mid").alias("_cf_first"))   # a row per file
        df = df.join(first, "source_file").withColumn("_cf_pos", F.col("_cf_mid") - F.col("_cf_first")).drop("_cf_mid", "_cf_first")
    plain = [c for c in df.columns if c not in ("source_file", "_cf_pos")]
    df = df.withColumns({c: F.when(F.col(c).isin(*na_tokens), None).otherwise(F.col(c)) for c in plain})
    if not row_index:
        return df.select(*plain)
    files = [f for f, _ in files_of(spark, path)]
    if len(files) > PART_STRIDE // FILE_STRIDE:
        raise ValueError(f"{len(files)} files: order keys are unique up to {PART_STRIDE // FILE_STRIDE}")
    if len(files) <= 1:
        rank = df.withColumn("_cf_rank", F.lit(0))
    else:
        ranks = spark.createDataFrame([(f, k) for k, f in enumerate(files)], "source_file string, _cf_rank long")
        # the listing comes from the driver, so it is broadcast; dealt by file, all rows of a file would meet in one task
        rank = df.join(F.broadcast(ranks) if len(files) <= LISTED_FILES else ranks, "source_file")
    return (rank.withColumn("row_idx", (F.col("_cf_rank") * FILE_STRIDE + F.col("_cf_pos")).cast("long"))
            .select(*plain, "source_file", "row_idx"))


def _parse_records(records: DataFrame, schema: T.StructType, options: dict) -> DataFrame:
    """Fields of one-record texts by the names and types of ``schema``; headers (position 0) are dropped."""
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    rows = records.where("position > 0").select("source_file", (F.col("position") - 1).alias("_cf_pos"),
                                                F.from_csv("record", ddl, options).alias("_cf_row"))
    return rows.select(*[F.col("_cf_row").getField(f.name).alias(f.name) for f in schema], "source_file", "_cf_pos")


def tag_source(df: DataFrame, label=None, domain=None, language=None, dataset=None) -> DataFrame:
    """Constant tag columns (a constant label makes a single-class source)."""
    for name, v in [("label", label), ("domain", domain), ("language", language), ("dataset", dataset)]:
        if v is not None:
            df = df.withColumn(name, v if isinstance(v, Column) else F.lit(v))
    if label is not None and not isinstance(label, Column):
        df = df.withColumn("label", F.col("label").cast("int"))
    return df


def labelled_pair(parts: list[tuple[DataFrame, int]], domain=None, language=None) -> DataFrame:
    """S3: the label comes from *which file* a row was read from. The parts follow each other:
    ``row_idx`` (when present) of the n-th part is raised by ``n * PART_STRIDE``, so order keys
    stay unique and a text in two parts is kept from the first."""
    if len(parts) > 1 << 10:
        raise ValueError(f"{len(parts)} parts: order keys are unique up to {1 << 10}")
    tagged = [tag_source(df, label=lab, domain=domain, language=language) for df, lab in parts]
    tagged = [df.withColumn("row_idx", F.col("row_idx") + F.lit(k * PART_STRIDE)) if "row_idx" in df.columns else df
              for k, df in enumerate(tagged)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_labelled_pair(spark: SparkSession, files: dict, domain=None, language=None, sep=",",
                       text_col: str = "text") -> DataFrame:
    """S3 from paths: one scan per file, label by file, union by name."""
    parts = [(read_csv_source(spark, p, sep=sep), lab) for p, lab in files.items()]
    return labelled_pair(parts, domain=domain, language=language)


@dataclass
class SourceSpec:
    """One source of the corpus: how to read it and how to make canonical columns."""
    name: str
    reader: object                       # callable(spark) -> DataFrame
    text: object = None                  # Column or callable(df) -> Column
    label: object = None
    domain: object = None
    language: object = None
    optional: bool = False
    required_cols: list = field(default_factory=list)
    strict_label: bool = False           # P5: a non-castable label fails the source
    group: str | None = None             # sources of one group (a train/test pair) fail as one


def _resolve(v, df):
    if v is None:
        return F.lit(None)
    if callable(v) and not isinstance(v, Column):
        return v(df)
    return v if isinstance(v, Column) else F.lit(v)


def _canonical(spark: SparkSession, spec: SourceSpec, rank: int) -> DataFrame:
    """The source's rows in canonical columns, with ``_cf_bad``: a label that is there but no integer."""
    raw = spec.reader(spark)
    missing = [c for c in spec.required_cols if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    df = raw.select(
        _resolve(spec.text, raw).cast("string").alias("text"),
        _resolve(spec.label, raw).cast("string").alias("_cf_label_raw"),
        _resolve(spec.domain, raw).cast("string").alias("domain"),
        _resolve(spec.language, raw).cast("string").alias("language"),
        (F.col("row_idx") if "row_idx" in raw.columns else F.monotonically_increasing_id()).cast("long").alias("row_idx"))
    # "1.0" is a label like "1": read as a number, then truncated
    df = df.withColumn("label", F.col("_cf_label_raw").try_cast("double").try_cast("int"))
    return (df.withColumn("_cf_bad", F.col("_cf_label_raw").isNotNull() & F.col("label").isNull())
            .withColumn("dataset", F.lit(spec.name)).withColumn("dataset_rank", F.lit(rank)).select(*CANONICAL_SCHEMA.fieldNames(), "_cf_bad"))


def _write_parts(spark: SparkSession, parts: dict[int, DataFrame], path: str) -> dict[int, tuple[int, int]]:
    """Write the sources by rank in one job -> {rank: (complete rows, bad labels)}, counted on what was written
    (a flag per row; the sources themselves are read once)."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("text", "label", "domain", "language")])
    rows = reduce(lambda a, b: a.unionByName(b), parts.values())
    rows.where(full | F.col("_cf_bad")).withColumn("_cf_part", F.col("dataset_rank")).write.partitionBy("_cf_part").mode("overwrite").parquet(path)
    flags = spark.read.schema("_cf_bad boolean, _cf_part int").parquet(path)
    got = {r["_cf_part"]: (r["n"], r["bad"]) for r in flags.groupBy("_cf_part").agg(
        F.count_if(~F.col("_cf_bad")).alias("n"), F.count_if("_cf_bad").alias("bad")).collect()}     # one row per source
    return {k: got.get(k, (0, 0)) for k in parts}


def load_corpus(spark: SparkSession, specs: list[SourceSpec], on_error: str = "skip", path: str | None = None):
    """Read every source in isolation -> (union, report).

    All sources are read once, by one job that writes the canonical rows to ``path`` (a fresh folder under the
    checkpoint folder by default), a part per source; rows and labels that do not cast are counted on what was
    written, so the report reads no source again. What comes back reads the parts of the good sources. Only if
    that job fails are the sources written one by one, to find the one that broke it.

    The report counts the rows that are loaded. A failing source is reported and skipped; an optional absent source yields
    nothing with status ``missing``; a group with one failed member fails as a whole; no usable source at all raises."""
    base = path or scratch_path(spark, "corpus")
    parts, stats, where, report = {}, {}, {}, {}

    def fail(rank, e):
        spec = specs[rank]
        if spec.optional and isinstance(e, AnalysisException) and "PATH_NOT_FOUND" in str(e):
            report[rank] = (spec.name, rank, "missing", 0, None)
        elif on_error != "skip":
            raise e
        else:
            report[rank] = (spec.name, rank, "failed", 0, (str(e).splitlines() or [type(e).__name__])[0][:200])

    for rank, spec in enumerate(specs):
        try:
            parts[rank] = _canonical(spark, spec, rank)
        except Exception as e:  # noqa: BLE001 - whatever breaks one source, the others load
            fail(rank, e)
    if parts:
        try:
            stats, where = _write_parts(spark, parts, f"{base}/all"), {rank: f"{base}/all/_cf_part={rank}" for rank in parts}
        except Exception:  # noqa: BLE001 - one of them is broken: find it
            for rank, df in parts.items():
                try:
                    stats |= _write_parts(spark, {rank: df}, f"{base}/{rank}")
                    where[rank] = f"{base}/{rank}/_cf_part={rank}"
                except Exception as e:  # noqa: BLE001
                    fail(rank, e)
    for rank, (n, bad) in stats.items():
        if specs[rank].strict_label and bad:
            fail(rank, ValueError(f"{bad} labels do not cast to int"))
        else:
            report[rank] = (specs[rank].name, rank, "ok", n, None)
    failed_groups = {specs[r].group for r, x in report.items() if x[2] == "failed" and specs[r].group}
    for rank, x in report.items():
        if x[2] == "ok" and specs[rank].group in failed_groups:
            report[rank] = (x[0], rank, "failed", 0, "group member failed")
    good = [r for r in sorted(report) if report[r][2] == "ok"]
    if not good:
        raise ValueError("no source could be loaded")
    rep = spark.createDataFrame([report[r] for r in sorted(report)], "dataset string, dataset_rank int, status string, n_rows long, error string")
    read = [where[r] for r in good if report[r][3]]              # a source without rows has no part
    if not read:
        return empty_canonical(spark), rep
    kept = T.StructType([*CANONICAL_SCHEMA, T.StructField("_cf_bad", T.BooleanType())])
    return spark.read.schema(kept).parquet(*read).where("not _cf_bad").drop("_cf_bad"), rep


def empty_canonical(spark: SparkSession) -> DataFrame:
    """An empty, typed canonical frame."""
    return spark.createDataFrame([], CANONICAL_SCHEMA)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def load_or_make_splits(spark: SparkSession, base: str, maker, names=("train", "val", "test"),
                        fmt: str | None = None) -> DataFrame:
    """Use saved splits only when all three exist, else build them with ``maker()``.

    Splits saved by ``write_splits`` (parquet folders) are found first, then CSV files, unless
    ``fmt`` names one of them. Labels are normalised (P7; unknown values become null) and a
    missing ``domain`` is ``unknown`` (P11)."""
    from corpusflow.functions.text import normalise_label
    for fmt in [fmt] if fmt else ["parquet", "csv"]:
        paths = [f"{base}/{n}.{fmt}" if fmt == "csv" else f"{base}/split={n}" for n in names]
        if not all(_exists(spark, p) for p in paths):
            continue
        parts = []
        for n, p in zip(names, paths):
            df = (read_csv_source(spark, p, row_index=False) if fmt == "csv" else spark.read.parquet(p))
            if "domain" not in df.columns:
                df = df.withColumn("domain", F.lit("unknown"))
            if "label" in df.columns:
                df = df.withColumn("label", normalise_label("label", mode="lenient", on_invalid="null"))
            parts.append(df.withColumn("split", F.lit(n)))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return maker()


def ensure_column(df: DataFrame, name: str, default) -> DataFrame:
    """Add ``name`` with ``default`` when absent."""
    return df if name in df.columns else df.withColumn(name, F.lit(default))


def resolve_text_column(df: DataFrame, priority=("text", "content", "headline", "article", "news"),
                        exclude=("label",), contains=None) -> Column:
    """First present column of ``priority``; else (``contains``) the first
    column whose lower-case name contains one of the words; else the first column not in
    ``exclude``. Resolved on the schema only (driver side, no data)."""
    cols = df.columns
    for c in priority:
        if c in cols:
            return F.col(c)
    if contains:
        for c in cols:
            if any(w in c.lower() for w in contains):
                return F.col(c)
    rest = [c for c in cols if c not in exclude]
    if not rest:
        raise ValueError("no text column")
    return F.col(rest[0])


def resolve_text(df: DataFrame, rules, exclude=("label",)) -> Column:
    """Ordered rules; a rule is a column name or a tuple of names joined by a
    space (all must be present)."""
    from corpusflow.functions.text import compose_text
    for rule in rules:
        names = (rule,) if isinstance(rule, str) else tuple(rule)
        if all(n in df.columns for n in names):
            return F.col(names[0]) if len(names) == 1 else compose_text(*names)
    return resolve_text_column(df, priority=(), exclude=exclude)


# ------------------------------------------------------------------ telemetry JSONL

_MEM = T.StructType([T.StructField(n, T.DoubleType()) for n in
                     ["total_gb", "available_gb", "used_gb", "percent", "swap_total_gb", "swap_used_gb", "swap_percent"]])
_CPU = T.StructType([T.StructField("percent", T.DoubleType()), T.StructField("count", T.IntegerType()),
                     T.StructField("per_core", T.ArrayType(T.DoubleType())),
                     T.StructField("load_avg", T.ArrayType(T.DoubleType()))])
_DISK = T.StructType([T.StructField(n, T.DoubleType()) for n in ["total_gb", "used_gb", "free_gb", "percent"]])
_GPU = T.StructType([T.StructField("used_mb", T.IntegerType()), T.StructField("total_mb", T.IntegerType()),
                     T.StructField("percent", T.DoubleType())])
_PROC = T.StructType([
    T.StructField("pid", T.IntegerType()), T.StructField("status", T.StringType()),
    T.StructField("memory_rss_gb", T.DoubleType()), T.StructField("memory_vms_gb", T.DoubleType()),
    T.StructField("cpu_percent", T.DoubleType()), T.StructField("num_threads", T.IntegerType()),
    T.StructField("open_files", T.IntegerType()), T.StructField("connections", T.IntegerType()),
    T.StructField("gpu_memory", _GPU), T.StructField("create_time", T.StringType()),
    T.StructField("error", T.StringType())])
TELEMETRY_SCHEMA = T.StructType([
    T.StructField("host", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("timestamp", T.StringType()), T.StructField("uptime_seconds", T.DoubleType()),
    T.StructField("boot_time", T.DoubleType()),
    T.StructField("metrics", T.StructType([
        T.StructField("memory", _MEM), T.StructField("cpu", _CPU), T.StructField("disk", _DISK),
        T.StructField("vm_restarted", T.BooleanType()), T.StructField("process", _PROC)])),
    T.StructField("alerts", T.ArrayType(T.StringType())),
])


def _entry(value_col: str) -> Column:
    """The one JSON object of a line, or null. The line is parsed as the only element of an
    array, so anything after the object makes it malformed; quotes must be double."""
    many = F.from_json(F.concat(F.lit("["), F.col(value_col), F.lit("]")), T.ArrayType(TELEMETRY_SCHEMA),
                       {"allowSingleQuotes": "false"})
    # bound to a variable, the parsed line is used twice but made once
    return F.get(F.transform(F.array(many), lambda m: F.when(F.size(m) == 1, F.get(m, F.lit(0)))), F.lit(0))


def parse_telemetry_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Parse JSON lines strictly; malformed and blank lines are dropped (see
    :func:`count_malformed`). An object without a timestamp is an entry whose time is unknown."""
    # exploded, the entry is a column of its own to filters and fields, so no line is parsed for each of them again
    parsed = lines.select("*", F.explode(F.array(_entry(value_col))).alias("_e"), F.trim(F.col(value_col)).alias("_t"))
    ok = parsed.where((F.length("_t") > 0) & F.col("_e").isNotNull())
    return ok.select("*", "_e.*").drop("_e", "_t", value_col)


def _line_order(lines: DataFrame) -> DataFrame:
    """``_cf_line``: a per-file line order that survives split files. Within one input
    split the generated id grows with the line; splits of one file are ordered by their
    start offset, and ``start + row-in-split`` is increasing because every line takes at
    least one byte. The window is per split, so no group exceeds one split."""
    from pyspark.sql import Window
    w = Window.partitionBy("_cf_file", "_cf_start").orderBy("_cf_mid")
    return (lines.withColumn("_cf_line", F.col("_cf_start") + F.row_number().over(w) - 1)
            .drop("_cf_mid", "_cf_start"))


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """JSONL scan that silently drops malformed lines; adds ``ts`` (TIMESTAMP_NTZ from the
    ISO string), ``source_file`` and ``line`` (order in the file). An entry without a counter
    gets its time in microseconds as ``seq``, as the stream reader does, so rotated files of a
    host follow each other. A missing path raises (R14)."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_cf_file"),
        F.col("_metadata.file_block_start").alias("_cf_start"), F.monotonically_increasing_id().alias("_cf_mid"))
    df = parse_telemetry_lines(_line_order(lines)).withColumnsRenamed({"_cf_file": "source_file", "_cf_line": "line"})
    return (df.withColumn("host", F.coalesce("host", F.lit("default")))
            .withColumn("ts", F.to_timestamp_ntz("timestamp"))
            .withColumn("seq", F.coalesce(F.col("seq"), F.unix_micros(F.col("ts").cast("timestamp_ltz")))))


def count_malformed(spark: SparkSession, path: str) -> DataFrame:
    """How many non-blank lines of a JSONL path failed to parse."""
    lines = spark.read.text(path)
    p = lines.select(F.trim("value").alias("t"),
                     _entry("value").alias("e"))
    return p.agg(F.count_if((F.length("t") > 0) & F.col("e").isNull()).alias("malformed"),
                 F.count_if(F.length("t") == 0).alias("blank"))


# ------------------------------------------------------------------ run logs

ACCURACY_PATTERN = r"Final Accuracy:[^(]*\(([0-9.]+)%"


def parse_run_logs(spark: SparkSession, path: str, model_from: str = "file") -> DataFrame:
    """Per log file, the first ``Final Accuracy: x (y%)`` line -> accuracy y/100. The model is named after the file, or
    (``model_from="folder"``, for logs that Spark wrote by partition) after the value of its folder."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        # split start offset, then the id growing inside the split: file order
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_cf_i"))
    hits = lines.select("file", "_cf_i", F.regexp_extract("value", ACCURACY_PATTERN, 1).alias("pct")).where(F.col("pct") != "")
    first = hits.groupBy("file").agg(F.min_by("pct", "_cf_i").alias("pct"))
    model = F.regexp_extract("file", r"([^/=]+)/[^/]*$" if model_from == "folder" else r"([^/]+?)(\.[^./]*)?$", 1)
    return first.select(model.alias("model"), (F.col("pct").cast("double") / 100).alias("accuracy"))
