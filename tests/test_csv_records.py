"""CSV records over several lines, read in many splits."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from harmonia.sources.csv_records import ends_inside, read_records
from tests.test_sources import land, rows


@pytest.fixture
def small_splits(spark):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_state_of_a_line():
    for line, inside, after in [
        (b"a,b", False, False), (b'a,"b', False, True), (b'a,5" wide', False, False), (b'"a"",b', False, True), (b'"a""",b', False, False),
        (b'x"y,"z', False, True), (b'end",b', True, False), (b'end","b', True, True), (b'""', True, True), (b'"', True, False), (b"", True, True),
        (b'a" b,c"', True, False), (b'"a"b"c', False, False), (b'"a"b,"c', False, True),
    ]:
        assert ends_inside(line, inside, b",") is after, line


def written(rng, n):
    """Lines as careless programs write them, and the same text."""
    out = ["id,a,b,c"]
    for k in range(n):
        cells = [str(k + 1)]
        for _ in range(3):
            word = "".join(rng.choice('ab ,"\n;é') for _ in range(rng.randrange(12)))
            if rng.random() < 0.5:
                cells.append('"' + word.replace('"', '""') + '"')
            else:
                plain = word.replace(",", "").replace("\n", "").lstrip('"')
                cells.append(plain)
        out.append(",".join(cells))
        if rng.random() < 0.1:
            out += ["", ""]
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("encoding", ["utf-8", "cp1252"])
def test_records_against_the_csv_module(spark, tmp_path, small_splits, seed, encoding):
    text = written(random.Random(seed), 80)
    bronze, exports = land(spark, tmp_path, many__csv=text.encode(encoding))
    assert spark.read.text(str(exports / "many.csv")).rdd.getNumPartitions() > 5
    expected = [tuple(r) for r in csv.reader(io.StringIO(text)) if r and len(r) == 4][1:]
    assert rows(bronze.read("many.csv")) == [(k + 1, *r) for k, r in enumerate(expected)]


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    long = "line\n" * 400
    text = f'a,b\n1,"{long}"\n2,x"y\n3,"p\nq"\n'
    bronze, _ = land(spark, tmp_path, big__csv=text)
    assert rows(bronze.read("big.csv")) == [(1, "1", long), (2, "2", 'x"y'), (3, "3", "p\nq")]


def test_two_files_of_one_export(spark, tmp_path, small_splits):
    folder = tmp_path / "exports" / "two.csv"
    folder.mkdir(parents=True)
    (folder / "part-0.csv").write_text('a,"b\nc"\n1,"x\ny"\n' + "".join(f'{k},"u\n{k}"\n' for k in range(2, 60)))
    (folder / "part-1.csv").write_text('a,"b\nc"\n60,z\n')
    from harmonia.sources.exports import Bronze

    table = Bronze.land(spark, str(tmp_path / "exports"), str(tmp_path / "bronze")).read("two.csv")
    assert table.columns == ("a", "b\nc")
    assert rows(table) == [(1, "1", "x\ny"), *((k, str(k), f"u\n{k}") for k in range(2, 60)), (60, "60", "z")]


def test_an_open_cell_is_an_error(spark, tmp_path, small_splits):
    (tmp_path / "open.csv").write_text("a,b\n" + "1,2\n" * 300 + '1,"never closed\n' + "3,4\n" * 300)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(str(tmp_path / "open.csv")).select(*place, F.col("value").cast("binary").alias("line"))
    with pytest.raises(ValueError, match="not closed"):
        read_records(lines, ",", "utf-8")
    with pytest.raises(ValueError, match="longer than 100 bytes"):
        read_records(lines, ",", "utf-8", 100)
