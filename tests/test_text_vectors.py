"""What a task of the text model holds at once, and normalisation in the packer."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from harmonia.functions import ngram_counts
from harmonia.functions.text import normalize
from harmonia.operators import text_vectors
from harmonia.session import ensure_checkpoint_dir
from suite.texts import centroid_predict


def test_arrays_of_a_model_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(text_vectors, "ARRAY_CODES", 50)
    docs = spark.createDataFrame([(i, f"{i * 7919:07d}{i * 104729:09d}") for i in range(200)], "record_id int, text string")
    packed = text_vectors.packed_counts(docs, "text").cache()
    tokens = text_vectors.document_frequency(packed, 200).cache()
    held = text_vectors.Deal.of(packed, tokens).in_blocks(tokens, "idf", "idf")
    distinct = tokens.where("code IS NOT NULL").count()
    sizes = [r[0] for r in held.select(F.size("codes")).collect()]
    assert sum(sizes) == distinct > 500 and max(sizes) < 120


def test_batches_follow_the_codes_of_texts(spark, monkeypatch):
    monkeypatch.setattr(text_vectors, "BATCH_CODES", 100)
    rows = spark.range(0, 60, 1, 1).select(F.sequence(F.lit(1), F.lit(30)).alias("codes"))

    def widths(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([len(batch.column(0).flatten())])})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = [r[0] for r in text_vectors.bounded(rows, widths, "n long").collect()]
    assert sum(found) == 1800 and max(found) == 90
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_packer_normalises_as_the_column_does(spark, monkeypatch):
    codes = [c for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["x" + "-".join(map(chr, codes[k:k + 997])) + "Z" for k in range(0, len(codes), 997)] + ["", "É", "½", "--", "ﷺ"]
    want = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normalize(F.col("t"))).collect()]
    data = [t.encode() for t in texts]
    found, bounds = ngram_counts.normalized(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert [found[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:], strict=False)] == want
    # Long texts go piece by piece.
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(["é" * 50 + "½" + "a" * 60, "!!", "Ab1"])], names=["record_id", "t"])
    whole = [r for b in ngram_counts.packer(1)([batch]) for r in b.to_pylist()]
    monkeypatch.setattr(ngram_counts, "PIECE_CHARS", 16)
    parts = [r for b in ngram_counts.packer(1)([batch]) for r in b.to_pylist()]
    key = lambda r: (r["record_id"], sorted(zip(r["codes"], r["n"], strict=True)), r["digest"])
    assert list(map(key, parts)) == list(map(key, whole)) and [r["record_id"] for r in whole] == [1, 3]


def test_scans_of_packed_texts_are_small(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "4096")
        text_vectors.packed_counts(spark.createDataFrame([(1, "abc")], "record_id int, text string"), "text")
        assert int(spark.conf.get(name)) <= text_vectors.READ_ROWS
    finally:
        spark.conf.set(name, before)


def test_frequencies_of_texts_are_those_of_packed_counts(spark):
    texts = ["", None, "ab", "ab", "É!", "abcabcabc", "the same text", "the same text", "z" * 3000, "--"]
    docs = spark.createDataFrame(list(enumerate(texts)), "record_id int, text string")
    names = ["code", "digest", "df", "idf"]
    want = text_vectors.document_frequency(text_vectors.packed_counts(docs, "text"), len(texts)).select(*names)
    direct = text_vectors.frequency_of_texts(docs, "text").select(*names)
    assert sorted(direct.collect(), key=str) == sorted(want.collect(), key=str)
    # Nothing but the texts is read.
    assert "written-" not in "".join(direct.inputFiles())


def test_predictions_write_and_shuffle_texts_not_their_counts(spark, tmp_path):
    """Counts hold several times as many bytes as their texts; the texts are shuffled twice (to be weighed for the model and for the scores)."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(600)), "xy"[i % 2]) for i in range(400)]
    # One text is copied, and one has no letters.
    rows += [(i, rows[0][1], "x") for i in range(400, 420)] + [(420, "--", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    size = sum(len(text) for _, text, _ in rows)

    def written_bytes():
        return sum(f.stat().st_size for f in Path(ensure_checkpoint_dir(spark).removeprefix("file:")).rglob("*.parquet"))

    def shuffled_bytes():
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before, shuffled = written_bytes(), shuffled_bytes()
    found = centroid_predict(spark, str(tmp_path)).collect()
    assert len(found) == 2 * len(rows) and {r["score"] for r in found if r["doc_id"] == 420} == {0.0}
    copies = {tuple(r)[1:] for r in found if r["doc_id"] == 0 or 400 <= r["doc_id"] < 420}
    assert len(copies) == 2
    assert written_bytes() - before < size / 2
    assert shuffled_bytes() - shuffled < 3 * size
