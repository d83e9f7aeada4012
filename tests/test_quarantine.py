"""Checked CSV reading: planted bad lines land in the quarantine with a reason, a swapped header raises."""

import pytest
from pyspark.sql import types as T

from wattframe.sources import files as io

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("name", T.StringType())])
LINES = ["1,2.5,a", "2,abc,b", "3,4.0", "4,5.0,d,extra", "x,y,e", '5,6.0,"f, g"', "6,,", '7,oops,"h, i"']
BAD = {"2,abc,b": "price", "3,4.0": "number of fields", "4,5.0,d,extra": "number of fields", "x,y,e": "k", '7,oops,"h, i"': "price"}


def _write(folder, *files):
    folder.mkdir()
    for i, lines in enumerate(files):
        (folder / f"{i}.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


@pytest.mark.parametrize("header", [None, ["key", "price (eur)", "label"]])
def test_planted_bad_lines(spark, tmp_path, header):
    top = [",".join(header)] if header else []
    path = _write(tmp_path / "in", top + LINES[:4], top + LINES[4:])
    good, bad = io.read_csv_checked(spark, path, SCHEMA, header)
    assert sorted(map(tuple, good.collect()), key=lambda r: r[0]) == [(1, 2.5, "a"), (5, 6.0, "f, g"), (6, None, None)]
    assert {r["line"]: r["reason"] for r in bad.collect()} == BAD
    assert good.count() + bad.count() == len(LINES)  # no line is lost


def test_a_swapped_header_raises(spark, tmp_path):
    path = _write(tmp_path / "in", ["key,price,label", "1,2.0,a"], ["price,key,label", "2.0,1,a"])
    with pytest.raises(Exception, match="header"):
        io.read_csv_checked(spark, path, SCHEMA, ["key", "price", "label"])
    with pytest.raises(ValueError):
        io.read_csv_checked(spark, path, SCHEMA, ["key"])


def test_files_without_lines(spark, tmp_path):
    good, bad = io.read_csv_checked(spark, _write(tmp_path / "in", ["k,price,name"]), SCHEMA, ["k", "price", "name"])
    assert good.count() == bad.count() == 0
