"""Every labelled row counts in the fit of op4."""

import zlib

from pyspark.sql import functions as F

from harmonia.llm import quality
from tests.llm import fixtures as fx


def test_fit_uses_every_label(spark):
    ids = sorted(range(21_000), key=lambda k: zlib.crc32(str(k).encode()))
    last = ids[-80:]
    texts = [(k, " ".join(fx.prose(k, 80)) if n % 4 else " ".join(f"{w}***" for w in fx.prose(k, 80))) for n, k in enumerate(last)]
    poor = {k for n, k in enumerate(last) if n % 4 == 0}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k not in poor)) for k in ids], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model.ratio.any() and model.threshold > float("-inf")
    assert {r.doc_id for r in quality.score(docs, model).where("kept").collect()} == set(last) - poor


def test_rows_that_may_meet_labels(spark):
    docs = spark.range(0, 40_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    found = {r.doc_id for r in quality._may_meet(docs, docs.where("doc_id % 100 = 7")).collect()}
    assert set(range(7, 40_000, 100)) <= found and len(found) < 440
