"""Quoted CSV cut at its true record ends by many tasks."""

import random

import pytest

from offerscore.sources import records
from offerscore.sources.offers import read_offers


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two files with line breaks, quotes and commas inside fields; one field spans many ranges."""
    rng, base = random.Random(4), tmp_path_factory.mktemp("csv")
    words = ["a", "b c", 'say ""hi""', "x,y", "line\nbreak", "two\n\nbreaks", "cr\r\nlf", '""', "é", ""]

    def field():
        return '"' + rng.choice(words) + rng.choice(words) + '"' if rng.random() < 0.5 else rng.choice(["plain", "7", "", "5.5"])
    for name, n, end in (("one.csv", 400, "\n"), ("two.csv", 50, "\r\n")):
        rows = [f"{name}-{k},{field()},{field()}" for k in range(n)]
        if end == "\r\n":          # the whole reader would turn this one into a line feed
            rows = [r.replace("\r\n", " ") for r in rows]
        rows[n // 2] = f'{name}-long,"' + "many\nlines " * 300 + '",z'
        text = "offer_id,note,remarks" + end + end.join(rows) + (end if name == "one.csv" else "")
        (base / name).write_bytes(text.encode())
    return base


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_split_reading_gives_the_rows_of_the_whole_reader(spark, folder, small_ranges):
    whole = read_offers(spark, str(folder))
    split = read_offers(spark, str(folder), split=True)
    assert split.columns == whole.columns == ["offer_id", "note", "remarks"]
    lines = records._lines(spark, str(folder))
    assert lines.rdd.getNumPartitions() > 10 and records.parities(lines).where("inside").count() > 3
    got = rows_of(split)
    assert len(got) == 450 and got == rows_of(whole)


@pytest.mark.parametrize("text, want", [
    ("a,b\n", []), ("a,b", []), ("", None), ('a,b\n"x\ny",2\n', [("x\ny", "2")]), ('a,b\n1,2\n\n3,4', [("1", "2"), ("3", "4")]),
    ('"a","b"\n"1","un""quoted"\n', [("1", 'un"quoted')])])
def test_odd_files(spark, tmp_path, text, want):
    (tmp_path / "f.csv").write_text(text)
    if want is None:
        assert read_offers(spark, str(tmp_path), split=True).columns == []
    else:
        assert rows_of(read_offers(spark, str(tmp_path), split=True)) == want


def test_a_header_with_line_breaks(spark, tmp_path, small_ranges):
    (tmp_path / "f.csv").write_text('"id' + "\nx" * 1000 + '",b\n1,2\n3,"4\n5"\n')
    out = read_offers(spark, str(tmp_path), split=True)
    assert out.columns[1] == "b" and rows_of(out) == [("1", "2"), ("3", "4\n5")]
