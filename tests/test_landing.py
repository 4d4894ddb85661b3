"""Part files of the exports that are landed."""

from pyspark.sql import functions as F

from suite import landing


def test_part_files_follow_the_bytes_of_the_texts(spark, tmp_path, monkeypatch):
    """A task's share of an export stays the same where the table grows; the parts follow one another."""
    monkeypatch.setattr(landing, "PART_BYTES", 10_000)
    for rows, parts in ((200, 4), (1_600, 16)):
        df = spark.range(rows).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"), F.lit(None).cast("string").alias("none"))
        made = landing._in_order(df, "doc_id")
        assert made.rdd.getNumPartitions() == parts
        made.write.csv(f"{tmp_path}/{rows}")
        files = spark.read.csv(f"{tmp_path}/{rows}", schema="doc_id long, text string, none string")
        spans = files.groupBy(F.input_file_name().alias("file")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("file").collect()
        assert all(a["high"] < b["low"] for a, b in zip(spans, spans[1:], strict=False))
        assert files.count() == rows
