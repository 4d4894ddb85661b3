"""CSV dialects and encodings, Parquet sources, ordinals and sinks."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from harmonia.operators.profiling import profile
from harmonia.sources.artifacts import read_json_lines, read_tables, write_artifacts, write_csv, write_json_lines
from harmonia.sources.exports import Bronze, SourceTable, choose_delimiter, format_source_ref, list_sources, split_source_ref


def land(spark, folder, **files):
    exports = folder / "exports"
    exports.mkdir()
    for name, content in files.items():
        (exports / name.replace("__", ".")).write_bytes(content if isinstance(content, bytes) else content.encode())
    return Bronze.land(spark, str(exports), str(folder / "bronze")), exports


def rows(table):
    return [tuple(r) for r in table.df.orderBy("ordinal").collect()]


def test_references():
    assert format_source_ref("a.xlsx", "s") == "a.xlsx#s" and format_source_ref("a.csv") == "a.csv"
    assert split_source_ref("a#b#c") == ("a", "b#c") and split_source_ref("a.csv") == ("a.csv", None)


def test_delimiters():
    assert choose_delimiter(["a;b;c", "1,5;2;3", "4;5;6"]) == ";"
    assert choose_delimiter(["a\tb", "1\t2"]) == "\t"
    assert choose_delimiter(["a|b", "1|2"]) == "|"
    assert choose_delimiter(['a,b', '"x,y",2']) == ","
    assert choose_delimiter(["one", "two"]) == ","


def test_listing_and_semicolons(spark, tmp_path):
    names = ["Matricule personne", "Type suivi actuel", "Poste actuel"] + [f"Info {i}" for i in range(20)]
    bronze, exports = land(
        spark, tmp_path, salaries_suivis_small__CSV=";".join(names) + "\n" + ";".join(f"v{i}" for i in range(23)) + "\n",
        **{"~$lock__csv": "x", "notes__txt": "x"},
    )
    assert list_sources(spark, str(exports)) == [("salaries_suivis_small.CSV", "csv")]
    table = bronze.sources()["salaries_suivis_small.CSV"]
    assert table.columns == tuple(names)
    profiles = profile(spark, [table])
    source = profiles.sources.first()
    assert source["row_count"] == 1 and "travailleur" in source["inferred_entities"]
    with pytest.raises(ValueError):
        bronze.read("other.csv")
    with pytest.raises(ValueError):
        bronze.read("other.docx")


def test_encodings(spark, tmp_path):
    text = "Nom,Région\nœuvre,Auvergne-Rhône-Alpes\n"
    bronze, _ = land(
        spark, tmp_path, bom__csv=b"\xef\xbb\xbf" + text.encode(), cp__csv=text.encode("cp1252"),
        latin__csv=b"a,b\n\xe9\x81,x\n",
    )
    sources = bronze.sources()
    assert sources["bom.csv"].columns == ("Nom", "Région") == sources["cp.csv"].columns
    assert rows(sources["bom.csv"]) == rows(sources["cp.csv"]) == [(1, "œuvre", "Auvergne-Rhône-Alpes")]
    assert rows(sources["latin.csv"]) == [(1, "\xe9\x81", "x")]


def test_cells(spark, tmp_path):
    bronze, _ = land(
        spark, tmp_path, odd__csv='a,b,a,B\n1,2,3,4\n5,"x\ny",6\n\n7,"say ""hi""",8,9,surplus\n', empty__csv="", head__csv="a,b\n",
    )
    sources = bronze.sources()
    odd = sources["odd.csv"]
    # A repeated header keeps its last value; names may differ in case only.
    assert odd.columns == ("a", "b", "B")
    assert rows(odd) == [(1, "3", "2", "4"), (2, "6", "x\ny", ""), (3, "8", 'say "hi"', "9")]
    assert sources["empty.csv"].columns == () and sources["head.csv"].df.count() == 0
    profiles = profile(spark, sources.values())
    assert {r["source_ref"]: r["row_count"] for r in profiles.sources.collect()} == {"odd.csv": 3, "empty.csv": 0, "head.csv": 0}


def test_ordinals_follow_the_file_across_splits(spark, tmp_path):
    lines = "id,v\n" + "".join(f"{i},{'x' * (i % 50)}\n" for i in range(1, 5001))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        bronze, _ = land(spark, tmp_path, many__csv=lines)
        table = bronze.read("many.csv")
        assert table.df.count() == 5000
        assert table.df.where(F.col("ordinal") != F.col("c_0").cast("bigint")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_parquet_source_and_typed_cells(spark, tmp_path):
    exports = tmp_path / "exports"
    df = spark.createDataFrame(
        [(1, date(2024, 1, 2), datetime(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5), None)],
        "i int, d date, t timestamp_ntz, u timestamp_ntz, n string",
    )
    df.write.parquet(str(exports / "typed.parquet"))
    table = Bronze.land(spark, str(exports), str(tmp_path / "bronze")).read("typed.parquet")
    assert table.format == "parquet"
    assert rows(table) == [(1, "1", "2024-01-02", "2024-01-02", "2024-01-02T03:04:05", "")]
    direct = SourceTable.from_dataframe("t", df, F.lit(1))
    assert rows(direct) == rows(table)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", True, None), ("a", False, "é")], "k string, f boolean, v string")
    empty = df.where("false")
    write_artifacts({"full": df, "none": empty}, str(tmp_path / "out"))
    found = read_tables(spark, str(tmp_path / "out"), ["full", "none", "absent"])
    assert set(found) == {"full", "none"} and found["none"].columns == ["k", "f", "v"]
    write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "csv"), header=True).fillna("").collect())) == [("a", "false", "é"), ("b", "true", "")]
    write_json_lines(df, str(tmp_path / "jsonl"))
    assert sorted(map(tuple, read_json_lines(spark, str(tmp_path / "jsonl"), "k string, f boolean, v string").collect()), key=str) == [
        ("a", False, "é"), ("b", True, None)]
