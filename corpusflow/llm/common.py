"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession, n_bytes: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches by bytes as well as rows: long texts never pile up in one Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that no column of ``df`` uses (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        k = f"_cf_{n}"
        while k.lower() in taken:
            k += "_"
        taken.add(k.lower())
        out.append(k)
    return out


def arrow_columns(df: DataFrame, fn, fields: str, drop: tuple[str, ...] = (), no_gc: bool = False) -> DataFrame:
    """Add the columns of the DDL ``fields`` computed batch by batch from Arrow data.

    ``fn()`` runs once per task and returns ``step(batch) -> [array per field]``. Columns of ``df``
    are passed through untouched (no copy); a result column replaces a column of the same name. With ``no_gc``
    cycles are not searched while the task runs: large caches without cycles cost more to scan than all else.
    """
    new = StructType.fromDDL(fields)
    gone = {f.name.lower() for f in new} | {c.lower() for c in drop}
    keep = [f for f in df.schema if f.name.lower() not in gone]
    schema = StructType(keep + list(new))
    arrow = to_arrow_schema(schema)
    names = [f.name for f in keep]

    def run(batches):
        step, was = fn(), gc.isenabled()
        if no_gc:
            gc.disable()
        try:
            for b in batches:
                if b.num_rows:
                    cols = [b.column(b.schema.get_field_index(n)) for n in names] + list(step(b))
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c
                                                      for c, f in zip(cols, arrow, strict=True)], schema=arrow)
        finally:
            if was:                                 # the worker may serve other tasks
                gc.enable()

    return df.mapInArrow(run, schema)


def texts(column) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [t or b"" for t in column.to_pylist()]


def sha256(column: Column) -> Column:
    return F.sha2(column, 256)
