"""A quoted CSV cut into many byte ranges gives the rows of the unsplit reader."""

import csv
import io
import random

import pytest

from specsheet.sources.csv import read_quoted, read_records

HEADER = ["id", "text", "other"]


def rows(n, seed=1):
    rnd = random.Random(seed)
    pieces = ["plain", 'say ""x""'.replace('""', '"'), "two\nlines", "a,b", "\n\n", '"', "ends with break\n", "é – ü", "x" * 300, "three\nmore\nlines", ""]
    return [[str(i), "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 4))), rnd.choice(pieces)] for i in range(n)]


def text_of(data, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(HEADER)
    w.writerows(data)
    return out.getvalue()


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for k in keys:
        spark.conf.set(k, "1000")
    yield
    for k in keys:
        spark.conf.unset(k)


def got(df):
    ordered = sorted(df.collect(), key=lambda r: r["row_id"])
    assert len({r["row_id"] for r in ordered}) == len(ordered)
    return [[r["id"], r["text"] or "", r["other"] or ""] for r in ordered]


def test_one_file_many_splits(spark, small_splits, tmp_path):
    data = rows(2000)
    (tmp_path / "one.csv").write_text(text_of(data), encoding="utf-8")
    records = read_records(spark, str(tmp_path / "one.csv"))
    assert records.select("block").distinct().count() > 50
    assert got(read_quoted(spark, str(tmp_path / "one.csv"))) == data
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "one.csv"))
    assert [[r["id"], r["text"] or "", r["other"] or ""] for r in whole.collect()] == data


def test_a_record_over_many_splits(spark, small_splits, tmp_path):
    data = [["1", "a", "b"], ["2", "line of a long record\n" * 400, "c"], ["3", "d\ne", "f"]]
    (tmp_path / "long.csv").write_text(text_of(data), encoding="utf-8")
    assert got(read_quoted(spark, str(tmp_path / "long.csv"))) == data


def test_files_encodings_and_line_ends(spark, small_splits, tmp_path):
    one, two, three = rows(150, 2), [["7", "Citroën\nnew", "ü"], ["8", "naïve", "x"]], rows(60, 3)
    (tmp_path / "a.csv").write_text(text_of(one), encoding="utf-8")
    (tmp_path / "b c.csv").write_bytes(text_of(two).encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(("\ufeff" + text_of(three, "\r\n")).encode())
    found = got(read_quoted(spark, str(tmp_path)))
    assert found == one + two + three


def test_header_alone_and_no_trailing_break(spark, tmp_path):
    (tmp_path / "h.csv").write_text("id,text,other\n")
    assert read_quoted(spark, str(tmp_path / "h.csv")).count() == 0
    (tmp_path / "n.csv").write_text('id,text,other\n1,"a\nb",c')
    assert got(read_quoted(spark, str(tmp_path / "n.csv"))) == [["1", "a\nb", "c"]]
    with pytest.raises(FileNotFoundError):
        read_quoted(spark, str(tmp_path / "none.csv"))
