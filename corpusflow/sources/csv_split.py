"""Quoted CSV in many tasks: records are found from byte ranges, quoted line ends included.

Spark's text scan cuts a file into byte ranges of whole lines. Whether a range starts inside a quoted field
depends on all that stands before it, but each range is a function of two states: for both starts it tells
how it ends, and how many records begin in it. These functions are composed in file order (a few numbers per
range); then every task knows its start and its first position, and yields the records that begin and end in its range.
A record that crosses ranges is put together from its parts, the only text that moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import ensure_checkpoint_dir

PART_BYTES = 1 << 20      # parts up to this size are kept by the first scan; longer ones cost a further scan


def ends_inside(line: bytes, sep: bytes, inside: bool) -> bool:
    """Whether a line ends within a quoted field, begun at the start of a record or (``inside``) within one.

    A quote opens a field only as its first character; within, two quotes stand for one; what follows the closing
    quote belongs to the field up to the separator. Quotes elsewhere are ordinary characters.
    """
    at = 0
    if not inside:
        if b'"' not in line:
            return False
        inside = line.startswith(b'"')
        at = 1 if inside else 0
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1:at + 2] == b'"':
                at += 2
                continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)
        inside = line[at:at + 1] == b'"'
        at += inside


class Range:
    """Records of one byte range, from a start that is known or supposed.

    ``head`` collects lines of a record begun before the range, ``open`` those of the record begun last and
    not ended; ``n`` counts the records that begin here (blank lines are none).
    """

    def __init__(self, sep: bytes, inside: bool, keep: int | None = None):
        self.sep, self.inside, self.keep = sep, inside, keep
        self.head: list[bytes] | None = [] if inside else None
        self.in_head, self.open, self.n, self.size = inside, [], 0, 0
        self.long_head = self.long_open = False

    def feed(self, line: bytes) -> bytes | None:
        """The record that ends with this line, if it began in the range."""
        was, self.inside = self.inside, ends_inside(line, self.sep, self.inside)
        if self.in_head:
            self._hold(self.head, line)
            self.in_head = self.inside
            return None
        if not was and not self.inside:
            line = line[:-1] if line.endswith(b"\r") else line
            self.n += line != b""
            return line or None
        if not was:
            self.n, self.size, self.long_open = self.n + 1, 0, False
        self._hold(self.open, line)
        if self.inside:
            return None
        record, self.open = b"\n".join(self.open), []
        return record[:-1] if record.endswith(b"\r") else record

    def _hold(self, lines: list[bytes], line: bytes) -> None:
        if self.keep is not None:
            self.size += len(line) + 1
            if self.size > self.keep:
                if self.in_head:
                    self.long_head = True
                else:
                    self.long_open = True
                lines.clear()
                return
        lines.append(line)

    def parts(self) -> tuple[bytes | None, bytes | None, bool]:
        """(head, open record, whether one of them was too long to keep)."""
        head = b"\n".join(self.head) if self.head is not None else None
        tail = b"\n".join(self.open) if self.inside and not self.in_head else None
        return head, tail, self.long_head or (tail is not None and self.long_open)


def _ranges(batches) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """(file, start, lines) of each byte range of a task, in reading order."""
    from itertools import groupby

    def rows():
        for b in batches:
            lines = b.column(0)
            lines = lines.cast(pa.large_binary() if pa.types.is_large_string(lines.type) else pa.binary())
            yield from zip(b.column(1).to_pylist(), b.column(2).to_pylist(), lines.to_pylist(), strict=True)

    for (file, start), group in groupby(rows(), key=lambda r: r[:2]):
        yield file, start, (_bom(x[2]) if k == 0 and start == 0 else x[2] for k, x in enumerate(group))


def _bom(line: bytes) -> bytes:
    return line.removeprefix(b"\xef\xbb\xbf")


def _scan(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


_SUMMARY = ("file string, start long, inside_out boolean, inside_in boolean, n_out long, n_in long, "
            "head binary, tail_out binary, tail_in binary, long_out boolean, long_in boolean")


def range_summaries(lines: DataFrame, sep: str, keep: int = PART_BYTES) -> DataFrame:
    """One row per byte range: how it ends and how many records begin in it for both starts, and its parts of
    records that cross ranges as far as they are short."""
    mark = sep.encode()

    def run(batches):
        for file, start, text in _ranges(batches):
            out, ins = Range(mark, False, keep), Range(mark, True, keep)
            for line in text:
                out.feed(line)
                ins.feed(line)
            (_, tail_out, long_out), (head, tail_in, long_in) = out.parts(), ins.parts()
            row = [file, start, out.inside, ins.inside, out.n, ins.n, head, tail_out, tail_in, long_out, long_in]
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _SUMMARY.split(", ")])

    return lines.mapInArrow(run, _SUMMARY)


def compose(rows: list) -> list[tuple[str, int, bool, int, int, int, bool]]:
    """(file, start, inside, position of the first record that begins there, head's crossing, tail's crossing, long) per range.

    Ranges in file order; a crossing is the position of the record that goes over the end of its range, -1 if none."""
    out, file = [], None
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, inside, seen, crossing = r["file"], False, 0, -1
        n = r["n_in"] if inside else r["n_out"]
        ends = r["inside_in"] if inside else r["inside_out"]
        long = r["long_in"] if inside else r["long_out"]
        head = crossing if inside else -1
        begun = ends and (not inside or r["new"])
        tail = seen + n - 1 if begun else -1
        out.append((file, r["start"], inside, seen, head, tail, long))
        crossing = tail if begun else (crossing if ends else -1)
        inside, seen = ends, seen + n
    return out


def csv_records(spark: SparkSession, path, sep: str = ",", keep: int = PART_BYTES) -> DataFrame:
    """(source_file, position, record): the records of the CSV files of ``path``, each header the record at position 0.

    Records end at line feeds outside quotes (a carriage return before it is dropped); blank lines are no
    records; a quote never closed takes the rest of its file. Files of one byte range need one scan, others two, and a
    third if a part of a crossing record is longer than ``keep``. Empty files have no records. The driver sees a few numbers
    per byte range.
    """
    ensure_checkpoint_dir(spark)
    lines, mark = _scan(spark, path), sep.encode()
    known: dict[tuple[str, int], tuple[bool, int]] = {}
    crossing = None
    if max((n for _, n in files_of(spark, path)), default=0) > smallest_range(spark):
        summary = range_summaries(lines, sep, keep).checkpoint()
        numbers = summary.select("file", "start", "inside_out", "inside_in", "n_out", "n_in", "long_out", "long_in",
                                 F.col("tail_in").isNotNull().alias("new")).collect()
        at = compose(numbers)
        known = {(f, s): (inside, first) for f, s, inside, first, *_ in at}
        places = [x for x in at if x[4] >= 0 or x[5] >= 0]
        if places:
            where = spark.createDataFrame(places, "file string, start long, inside boolean, first long, head_of long, tail_of long, long boolean")
            if any(x[6] for x in places):
                held = spark.sparkContext.broadcast(known)
                summary = lines.mapInArrow(lambda b: _parts(b, mark, held.value), "file string, start long, head binary, tail_in binary, tail_out binary")
            parts = summary.select("file", "start", "head", "tail_in", "tail_out").join(where, ["file", "start"])
            piece = F.explode(F.array(F.struct(F.col("head_of").alias("position"), F.col("head").alias("text")),
                                      F.struct(F.col("tail_of").alias("position"), F.when(F.col("inside"), F.col("tail_in")).otherwise(F.col("tail_out")).alias("text"))))
            crossing = (parts.select("file", "start", piece.alias("p")).where("p.position >= 0 and p.text is not null")
                        .groupBy("file", F.col("p.position").alias("position"))
                        .agg(F.array_sort(F.collect_list(F.struct("start", F.col("p.text").alias("text")))).alias("parts"))
                        .select("file", "position", F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["text"].cast("string")), "\n"), r"\r\z", "").alias("record")))
    held = spark.sparkContext.broadcast(known)      # a place in the file and a flag per byte range
    known_ranges = bool(known)

    def run(batches):
        for file, start, text in _ranges(batches):
            inside, first = held.value.get((file, start), (False, 0))
            part, found, pos, size = Range(mark, inside), [], [], 0
            for line in text:
                record = part.feed(line)
                if record is not None:
                    found.append(record)
                    pos.append(first + part.n - 1)
                    size += len(record)
                    if size > 4 << 20 or len(found) == 8192:
                        yield _records(file, pos, found)
                        found, pos, size = [], [], 0
            if part.inside and not known_ranges:
                found.append(part.parts()[1].removesuffix(b"\r"))       # a quote that never closes, in a file of one range
                pos.append(first + part.n - 1)
            if found:
                yield _records(file, pos, found)

    whole = lines.mapInArrow(run, "source_file string, position long, record binary").withColumn("record", F.col("record").cast("string"))
    if crossing is None:
        return whole
    return whole.unionByName(crossing.withColumnRenamed("file", "source_file"))


def _records(file, pos, found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(pos), pa.string()), pa.array(pos, pa.int64()), pa.array(found, pa.binary())],
                                      names=["source_file", "position", "record"])


def _parts(batches, mark: bytes, known) -> Iterator[pa.RecordBatch]:
    for file, start, text in _ranges(batches):
        part = Range(mark, known[file, start][0])
        for line in text:
            part.feed(line)
        head, tail, _ = part.parts()
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start], pa.int64()), *(pa.array([x], pa.binary()) for x in (head, tail, tail))],
                                         names=["file", "start", "head", "tail_in", "tail_out"])


def files_of(spark: SparkSession, path) -> list[tuple[str, int]]:
    """(file, length) by path: the listing that the driver holds for any scan; nothing is read."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length")
    return sorted((r["file"], r["length"]) for r in listed.collect())


def smallest_range(spark: SparkSession) -> int:
    """A file of at most so many bytes is never cut."""
    return min(_bytes(spark.conf.get(f"spark.sql.files.{k}")) for k in ("maxPartitionBytes", "openCostInBytes"))


def _bytes(text: str) -> int:
    """A size such as ``16m`` or ``134217728b`` in bytes."""
    text = text.strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1:])
    return int(text[:-1]) << unit if unit else int(text)
