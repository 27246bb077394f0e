"""Quoted CSV read by many tasks: the records, fields and places of Python's reader, wherever the ranges are cut."""

import csv
import io
import os
import random

import pytest

from corpusflow.sources import csv_split
from corpusflow.sources import files as S


def _put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    return os.path.join(folder, name)


@pytest.fixture()
def small_ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    was = {k: spark.conf.get(k) for k in keys}

    def cut(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "1")
    yield cut
    for k, v in was.items():
        spark.conf.set(k, v)


def python_rows(text, sep=","):
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep, strict=False) if r]


def got_rows(df):
    cols = [c for c in df.columns if c not in ("source_file", "row_idx")]
    rows = sorted(df.collect(), key=lambda r: r["row_idx"])
    assert [r["row_idx"] for r in rows] == list(range(len(rows)))
    return [[r[c] or "" for c in cols] for r in rows]


FIELDS = ["", "a", "plain text", "a,b", "line\nbreak", "two\n\nlines\n", 'say "hi"', '"', '""', "é漢", "crlf\r\nin", "x" * 300, "tail ", " lead", ";", '",\n"']


def make(rng, rows, sep, ending):
    out = io.StringIO(newline="")
    w = csv.writer(out, delimiter=sep, lineterminator=ending)
    w.writerow(["id", "text", "other"])
    for k in range(rows):
        w.writerow([f"r{k}", rng.choice(FIELDS) + rng.choice(FIELDS), rng.choice(FIELDS)])
        if rng.random() < 0.05:
            out.write(ending)
    return out.getvalue()


@pytest.mark.parametrize("seed,cut,sep,ending", [(1, 16, ",", "\n"), (2, 50, ";", "\n"), (3, 97, ",", "\r\n"), (4, 400, ",", "\n"), (5, 1 << 20, ";", "\r\n")])
def test_random_files_at_any_cut(spark, tmp_dir, small_ranges, seed, cut, sep, ending):
    text = make(random.Random(seed), 60, sep, ending)
    small_ranges(cut)
    df = S.read_csv_source(spark, _put(tmp_dir, "a.csv", text), sep=sep, na_tokens=("\x00",))
    assert got_rows(df) == python_rows(text, sep)[1:]


def test_one_file_takes_many_tasks(spark, tmp_dir, small_ranges):
    text = make(random.Random(9), 400, ",", "\n")
    small_ranges(len(text.encode()) // 12)
    records = csv_split.csv_records(spark, _put(tmp_dir, "a.csv", text))
    assert records.rdd.getNumPartitions() >= 12
    got = {r["position"]: r["record"] for r in records.collect()}
    assert sorted(got) == list(range(401)) and [next(csv.reader(io.StringIO(got[k], newline=""))) for k in range(401)] == python_rows(text)


@pytest.mark.parametrize("keep", [1, 200])
def test_records_longer_than_what_the_first_scan_keeps(spark, tmp_dir, small_ranges, monkeypatch, keep):
    rows = [["id", "text"], ["a", "line\n" * 200], ["b", "x"], ["c", 'q"\n' * 300], ["d", "\n" * 50]]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows(rows)
    small_ranges(64)
    monkeypatch.setattr(csv_split.csv_records, "__defaults__", (",", keep))
    assert got_rows(S.read_csv_source(spark, _put(tmp_dir, "a.csv", out.getvalue()))) == rows[1:]


def test_quotes_within_fields_are_ordinary(spark, tmp_dir, small_ranges):
    text = 'id,size\n1,5" disk\n2,a "quoted" word\n3,"x"\n4,it"s\n5,"a\nb"\n'
    for cut in (8, 15, 1 << 20):
        small_ranges(cut)
        df = S.read_csv_source(spark, _put(tmp_dir, f"{cut}.csv", text))
        assert got_rows(df) == [["1", '5" disk'], ["2", 'a "quoted" word'], ["3", "x"], ["4", 'it"s'], ["5", "a\nb"]]


def test_quote_that_never_closes_and_bom(spark, tmp_dir, small_ranges):
    text = "﻿id,text\n1,a\n2,\"open\n3,b\n4,c"
    for cut in (6, 1 << 20):
        small_ranges(cut)
        got = {r["position"]: r["record"] for r in csv_split.csv_records(spark, _put(tmp_dir, f"{cut}.csv", text)).collect()}
        assert got == {0: "id,text", 1: "1,a", 2: '2,"open\n3,b\n4,c'}


def test_folder_of_files(spark, tmp_dir, small_ranges):
    small_ranges(40)
    for k, name in enumerate(("b x.csv", "a%20.csv", "c.csv")):
        _put(tmp_dir, name, f'id,text\n{k},"first\nof {name}"\n{k},second\n')
    _put(tmp_dir, "empty.csv", "")
    rows = sorted(S.read_csv_source(spark, tmp_dir).collect(), key=lambda r: r["row_idx"])
    assert [r["text"] for r in rows] == ["first\nof a%20.csv", "second", "first\nof b x.csv", "second", "first\nof c.csv", "second"]
    assert [r["row_idx"] % S.FILE_STRIDE for r in rows] == [0, 1] * 3 and len({r["row_idx"] for r in rows}) == 6
    assert S.read_csv_source(spark, tmp_dir, row_index=False).columns == ["id", "text"]


def test_other_encodings_and_whole_file_reads_agree(spark, tmp_dir):
    text = make(random.Random(3), 30, ",", "\n")
    p, q = _put(tmp_dir, "u.csv", text), _put(tmp_dir, "l.csv", text.replace("漢", "").encode("latin-1"))
    one = got_rows(S.read_csv_source(spark, p, splittable=False, na_tokens=("\x00",)))
    assert one == got_rows(S.read_csv_source(spark, p, na_tokens=("\x00",))) == python_rows(text)[1:]
    assert got_rows(S.read_csv_source(spark, q, encoding="ISO-8859-1", na_tokens=("\x00",))) == python_rows(text.replace("漢", ""))[1:]


def test_too_many_parts_and_files_are_errors(spark, monkeypatch, tmp_dir):
    df = spark.createDataFrame([("t", 0)], "text string, row_idx long")
    with pytest.raises(ValueError):
        S.labelled_pair([(df, 0)] * 1025)
    monkeypatch.setattr(S, "PART_STRIDE", S.FILE_STRIDE)
    for n in "ab":
        _put(tmp_dir, f"{n}.csv", "text\nx\n")
    with pytest.raises(ValueError):
        S.read_csv_source(spark, tmp_dir)


@pytest.mark.parametrize("line,inside,want", [
    (b"", False, False), (b"", True, True), (b"a,b", False, False), (b'"a', False, True), (b'"a"', False, False), (b'a"', True, False), (b'a""', True, True),
    (b'a"""', True, False), (b'x,"', False, True), (b'"a"b,"c', False, True), (b'a"b,c', False, False), (b'a",b"', True, False), (b'a","b', True, True), (b'"",""",', False, True)])
def test_line_transitions(line, inside, want):
    assert csv_split.ends_inside(line, b",", inside) == want
