"""Delimited text in ranges: quoted line ends, any cut, dialects and headings by file."""

import csv
import io
import random

import pytest

from terrafold.sources import delimited, lines


@pytest.mark.parametrize("size,end", [(37, "\n"), (200, "\r\n"), (10_000, "\n")])
def test_every_cut_gives_the_same_records(spark, tmp_path, monkeypatch, size, end):
    rnd = random.Random(size)
    cell = lambda: rnd.choice(["", "a", "b\nc", 'say "x"', "x;y", "\n", "é漢", "long " * 20, '"', "'", " "])
    rows = [(str(k), cell(), cell()) for k in range(150)]
    text = io.StringIO()
    csv.writer(text, delimiter=";", lineterminator=end).writerows([("id", " b ", "c"), *rows])
    (tmp_path / "t.csv").write_bytes(text.getvalue().encode())
    df = delimited.read_delimited(spark, str(tmp_path / "t.csv"), range_bytes=size)
    assert df.columns == ["id", "b", "c"] and df.rdd.getNumPartitions() == -(-len(text.getvalue().encode()) // size)
    got = {r.id: (r.b, r.c) for r in df.collect()}
    assert got == {k: (b or None, c or None) for k, b, c in rows}


@pytest.mark.parametrize("step", [1, 7])
def test_small_steps(spark, tmp_path, step):
    (tmp_path / "t.csv").write_bytes(b'a,b\n1,"x\ny"\n2,""\n\n3,z')
    for n in range(1, 26):
        ranges = lines.ranges_of([(str(tmp_path / "t.csv"), 23)], n)
        quotes = [open(tmp_path / "t.csv", "rb").read()[:a].count(b'"') % 2 for _, a, _, _ in ranges]
        reader = lines.LineReader({"ranges": "\n".join(f"{p}\t{a}\t{b}\t{s}\t{q}" for (p, a, b, s), q in zip(ranges, quotes)), "encoding": "utf-8", "separator": ",", "columns": "2"})
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(lines, "STEP", step)
            assert [row for p in reader.partitions() for row in reader.read(p)] == [("1", "x\ny"), ("2", None), ("3", "z")]


def test_headings_by_file(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a;b\n1;x\n")
    (tmp_path / "2.csv").write_text("b,a,d\ny,2,q\n")
    (tmp_path / "3.csv").write_bytes("﻿a;a;\nHuế;4;5\n".encode())
    (tmp_path / "4.csv").write_text("")
    df = delimited.read_delimited(spark, f"{tmp_path}/*.csv")
    assert df.columns == ["a", "b", "d", "a.1", "Unnamed: 2"]
    assert sorted(map(tuple, df.collect()), key=str) == [("1", "x", None, None, None), ("2", "y", "q", None, None), ("Huế", None, None, "4", "5")]
    with pytest.raises(Exception):
        delimited.read_delimited(spark, f"{tmp_path}/none/*.csv")


def test_short_long_and_stray(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1\n2,x,y\n3,5" pipe\n4,z\n')
    df = delimited.read_delimited(spark, str(tmp_path / "t.csv"), range_bytes=4)
    assert df.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, df.collect()), key=str) == [("1", None), ("2", "x"), ("3", '5" pipe'), ("4", "z")]


def test_code_page(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("tên\tsố\n" .encode("utf-8") + "Hué\t1\n".encode("utf-8"))
    (tmp_path / "u.csv").write_bytes("n\tm\nHu\xe9\t1\nx\t2\n".encode("latin-1"))
    assert [r["tên"] for r in delimited.read_delimited(spark, str(tmp_path / "t.csv")).collect()] == ["Hué"]
    assert [r["n"] for r in delimited.read_delimited(spark, str(tmp_path / "u.csv"), range_bytes=5).collect()] == ["Hué", "x"]
