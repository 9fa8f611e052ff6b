"""CSV read in parallel against Python's own reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from pairwright.sources import csv_records
from pairwright.sources.tables import INDEX, load_csv


def cell(r):
    kind = r.random()
    if kind < 0.5:
        return str(r.randrange(1000))
    if kind < 0.6:
        return ""
    if kind < 0.8:
        return r.choice(['a,b', 'say "hi"', "two\nlines", "cr\r\nlf", '"', '""', ",", "\n\n", "lone\rturn", "é ünï", "x" * 70])
    return r.choice(['in"side', "plain text", " padded "])


def text_of(r, rows, end, quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=end, quoting=quoting)
    for row in rows:
        writer.writerow(row)
        if r.random() < 0.05:
            out.write(end)  # a blank line
    return out.getvalue()


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    spark.conf.set("spark.sql.files.minPartitionNum", 1)


@pytest.fixture
def splits(spark):
    yield lambda size: small_splits(spark, size)
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


def read(found):
    return [tuple(r) for r in found.rows.orderBy(INDEX).collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [64, 300, 1 << 20])
def test_same_as_pythons_reader(spark, tmp_path, splits, end, size):
    r = random.Random(size + len(end))
    rows = [["id", "a", 'na"me', "note"], *([str(k), cell(r), cell(r), cell(r)] for k in range(150))]
    text = text_of(r, rows, end, r.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    path = tmp_path / "in.csv"
    path.write_bytes(b"\xef\xbb\xbf" + text.encode())
    splits(size)
    found = load_csv(spark, f"file://{path}")
    want = [x for x in csv.reader(io.StringIO(text, newline="")) if x]
    assert found.headers == want[0]
    assert read(found) == [(k, *(c or None for c in x)) for k, x in enumerate(want[1:])]
    if size < 1000:
        lines = csv_records._lines(spark, f"file://{path}")
        assert lines.rdd.getNumPartitions() > 5 and any(s.within for s in csv_records.states(lines)[0].values())


def test_one_cell_over_many_splits(spark, tmp_path, splits):
    path = tmp_path / "in.csv"
    long = "\n".join(f'line {k} with ""quotes"", commas' for k in range(60))
    path.write_text(f'a,b\n1,x\n2,"{long}"\n3,y\n')
    splits(50)
    assert read(load_csv(spark, str(path))) == [(0, "1", "x"), (1, "2", long.replace('""', '"')), (2, "3", "y")]


def test_a_ragged_record_is_told_by_its_number(spark, tmp_path, splits):
    path = tmp_path / "in.csv"
    path.write_text("a,b\n" + "".join(f'{k},"two\nlines"\n' for k in range(20)) + "\n1,2,3\n" + "1,2\n" * 20 + "9\n")
    splits(40)
    with pytest.raises(ValueError, match="line 23 has 3 cells, the header has 2"):
        load_csv(spark, str(path))


def test_odd_files(spark, tmp_path):
    path = tmp_path / "in.csv"
    for content in ("", "\n\n"):
        path.write_text(content)
        with pytest.raises(ValueError, match="file is empty"):
            load_csv(spark, str(path))
    path.write_text("a,b")
    assert read(load_csv(spark, str(path))) == [] and load_csv(spark, str(path)).headers == ["a", "b"]
    path.write_bytes(b"a,b\r1,2\r\r3,\"x\ry\"\r")
    assert read(load_csv(spark, str(path))) == [(0, "1", "2"), (1, "3", "x\ry")]
    path.write_text('a,b\n1,"never closed\n2,3\n')
    assert read(load_csv(spark, str(path))) == [(0, "1", "never closed\n2,3\n")]
    path.write_text("a,b\n , \n1,\n")
    assert read(load_csv(spark, str(path), drop_blank_rows=True)) == [(1, "1", None)]
    assert load_csv(spark, str(path)).rows.filter(F.col("c1").isNull()).count() == 1


@pytest.mark.parametrize("seed", range(6))
def test_scan_agrees_with_the_reader_at_every_cut(seed):
    r = random.Random(seed)
    text = "".join(r.choice(['"', '""', ",", "\r", "a", "b c", '"x"', "\r\n", "\n"]) for _ in range(60))
    for cut in range(len(text)):
        state, records, rows = False, 0, 0
        lines = text[:cut].split("\n")
        for line in lines[:-1] if lines[-1] == "" else lines:
            state, n, m = csv_records.scan(line, state)
            records, rows = records + n, rows + m
        want = list(csv.reader(io.StringIO(text[:cut], newline="")))
        assert records + state == len(want) and rows + state == sum(1 for x in want if x), (text[:cut], want)
