"""Multi-line CSV in parallel, against Spark's own reader of whole files."""

from __future__ import annotations

import csv
import io
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from riskloom.plans.warehouse import validate_csv
from riskloom.schemas import CONTRACTS
from riskloom.sources import csv_records, files, sinks

SETTINGS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@contextmanager
def small_blocks(spark, size: int):
    before = {key: spark.conf.get(key) for key in SETTINGS}
    for key in SETTINGS:
        spark.conf.set(key, str(size))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def text_of(rows: list[list[str]], end: str) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def some_rows(seed: int, n: int, crlf: bool) -> list[list[str]]:
    some = random.Random(seed)
    pieces = ["a", "é", ",", '"', '""', "\n", "\n\n", "\\", " ", "long " * 20, "\r\n" if crlf else "\n", "x,y\n\"z\""]
    return [[str(k), "".join(some.choice(pieces) for _ in range(some.randrange(0, 9))), some.choice(["", "v", "w\nw"])]
            for k in range(n)]


@pytest.mark.parametrize("size", [200, 1_000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_are_those_that_were_written(spark, tmp_path, size, end):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    expected = []
    for k in range(3):
        rows = some_rows(k, 40, end == "\r\n")
        (folder / f"{k}.csv").write_text(text_of([["id", "Note", "last one"], *rows], end), newline="")
        expected += [(k * 40 + at + 1, *row) for at, row in enumerate(rows)]
    whole = spark.read.options(header=True, escape='"', multiLine=True).csv(str(folder))
    with small_blocks(spark, size):
        found = files.scan_csv(spark, str(folder), multi_line=True)
        assert found.columns == ["id", "Note", "last one"]
        if end == "\n":  # of CRLF files Spark's reader turns the breaks within fields into LF
            assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
        numbered = files.scan_csv_numbered(spark, str(folder), True).orderBy("row_id").collect()
    assert [(r[0], r[1], r[2] or "", r[3] or "") for r in numbered] == expected


def test_ordered_files_are_bounded_and_keep_the_numbers(spark, tmp_path):
    rows = spark.range(300).selectExpr("CAST((id * 7) % 300 AS STRING) AS id", "concat(repeat('x', 100), '\n\"', id) AS note")
    path = str(tmp_path / "t")
    sinks.write_csv_in_order(rows, F.col("id").cast("bigint"), path, file_bytes=4_000)
    sizes = [p.stat().st_size for p in (tmp_path / "t").glob("*.csv")]
    assert len(sizes) >= 6 and max(sizes) < 12_000
    found = files.scan_csv_numbered(spark, path, True).orderBy("row_id").collect()
    assert [(r["row_id"], r["id"]) for r in found] == [(k + 1, str(k)) for k in range(300)]
    assert found[7]["note"].endswith('\n"1')
    sinks.write_csv_in_order(rows, F.col("id").cast("bigint"), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1


def test_one_file_takes_many_tasks(spark, tmp_path):
    (tmp_path / "t.csv").write_text(text_of([["id", "note"], *([str(k), f"a\nb {k}"] for k in range(4_000))], "\n"))
    with small_blocks(spark, 4_096):
        records = csv_records.csv_records(spark, str(tmp_path / "t.csv"))
        assert records.select("start").distinct().count() > 8
        assert files.scan_csv(spark, str(tmp_path / "t.csv"), multi_line=True).count() == 4_000


def test_a_field_longer_than_blocks(spark, tmp_path):
    long = "line of a field\n" * 300
    (tmp_path / "t.csv").write_text(text_of([["id", "note"], ["1", long], ["2", "b"], ["3", long + "end"]], "\n"))
    with small_blocks(spark, 256):
        rows = files.scan_csv(spark, str(tmp_path / "t.csv"), multi_line=True).collect()
    assert sorted((r["id"], r["note"]) for r in rows) == [("1", long), ("2", "b"), ("3", long + "end")]


def test_blank_lines_are_skipped_and_bad_files_are_errors(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('\nid,note\n\n1,"a\n\nb"\n\n2,c\n')
    assert sorted(map(tuple, files.scan_csv(spark, str(path), multi_line=True).collect())) == [("1", "a\n\nb"), ("2", "c")]
    for text, told in (('id,note\n1,"open\n2,b\n', "not closed"), ("id,note\n1,2,3\n", "MALFORMED"),
                       ('id,note\n1,5" pipe\n2,6" pipe\n', "MALFORMED")):
        path.write_text(text)
        with pytest.raises(Exception, match=told):
            files.scan_csv(spark, str(path), multi_line=True).collect()


def test_headers_must_agree(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("id,note\n1,x\n")
    (folder / "b.csv").write_text("ID,Note\n2,y\n")
    assert files.scan_csv(spark, str(folder), multi_line=True).count() == 2
    (folder / "c.csv").write_text("note,id\ny,3\n")
    with pytest.raises(ValueError, match="different headers"):
        files.scan_csv(spark, str(folder), multi_line=True)


def test_a_begin_table_too_large_to_broadcast(spark, tmp_path, monkeypatch):
    rows = some_rows(8, 60, False)
    (tmp_path / "t.csv").write_text(text_of([["id", "a", "b"], *rows], "\n"))
    monkeypatch.setattr(csv_records, "fits", lambda df: False)
    with small_blocks(spark, 128):
        found = files.scan_csv_numbered(spark, str(tmp_path / "t.csv"), True).orderBy("row_id").collect()
    assert [(r["row_id"], r["id"], r["a"] or "") for r in found] == [(k + 1, row[0], row[1]) for k, row in enumerate(rows)]


def test_validation_names_the_row_after_line_breaks(spark, tmp_path):
    names = CONTRACTS["accounts"].required
    rows = [["1", "c1", "two\nlines", "2020-01-01", "ACTIVE"], ["1", "c2", "x", "2020-01-01", "ACTIVE"]]
    (tmp_path / "t.csv").write_text(text_of([list(names), *[row[: len(names)] for row in rows]], "\n"))
    passed, lines = validate_csv(spark, str(tmp_path / "t.csv"), CONTRACTS["accounts"], True)
    assert not passed and any("2" in line for line in lines[1:])
