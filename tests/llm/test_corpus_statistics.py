"""Importance resampling, exact dedup and source divergence against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from harmonia.llm import bytetext as bt
from harmonia.llm import crc_table, divergence, exact_dedup, resampling
from tests.llm import fixtures as fx
from tests.llm.test_operators import same

CLASHES = ("digest", "row", "keep", "batch", "score", "rank", "n", "long", "first", "term", "value", "item", "part", "place", "total")


@pytest.fixture(scope="module")
def docs(spark):
    """The awkward table with columns named like those that the operators use inside."""
    return fx.documents(spark).select("*", *(F.lit("x").alias(c) for c in CLASHES)).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "lang", "source").collect()


# --- 11 --------------------------------------------------------------------------------------------
def test_checksums_from_the_table():
    rng = np.random.default_rng(3)
    for size in (1, 2, 127, 128, 129, 255, 256, 257, 5000, crc_table.SLICE + 1, 3 * crc_table.SLICE):
        span = rng.integers(0, 256, size).astype(np.uint8)
        assert crc_table.folded(span) == zlib.crc32(span.tobytes())
    words = [bytes(rng.integers(97, 123, int(k)).astype(np.uint8)) for k in [*rng.integers(1, 14, 300), 64, 63, 127, 128, 129, 1, 700, 700, 2]]
    data = np.frombuffer(b", ".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths + 2) - lengths - 2
    one, two = crc_table.word_checksums(data, starts, starts + lengths)
    assert one.tolist() == [zlib.crc32(w) for w in words]
    assert two.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)]


@pytest.mark.parametrize("limit", [1, 3, 10, 64, 1000])
def test_long_texts_in_pieces_have_the_same_features(limit):
    for text in ("one two  three " * 40, "x" * 300, "a " + "y" * 500 + " b c", "", " " * 300, "é è " * 100 + "z" * 90, "q" * 70 + " " * 200 + "r s"):
        data = np.frombuffer(text.encode(), np.uint8)
        found = Counter()
        for piece in resampling._pieces(data, np.array([0, len(data)]), limit):
            words, pairs, bounds, pair_bounds = resampling._features(*piece)
            assert bounds[-1] == len(words) and pair_bounds[-1] == len(pairs)
            found.update(words.tolist())
            found.update(pairs.tolist())
        assert found == Counter(zlib.crc32(f.encode()) % resampling.BUCKETS for f in features(text))


def features(text):
    w = fx.alphanumeric_words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def resampled(rows, target, percent=25, seed=7):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t))

    raw, wanted = counts(t for _, t in rows), counts(target)
    s_all, t_all = sum(raw.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((raw[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    scored = []
    for i, text in rows:
        own = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((i, len(own), weight, score, len(fx.alphanumeric_words(text)) >= 20))
    able = sorted((r for r in scored if r[4] and r[0] is not None), key=lambda r: (-r[3], r[0]))
    drawn = len(able) * percent // 100
    left = Counter(able[:drawn])
    found, place = [], {}
    for rank, r in enumerate(able[:drawn], 1):
        place.setdefault(r, []).append(rank)
    for r in scored:
        found.append((*r[:4], place[r].pop() if left[r] and place[r] else None))
    return found


@pytest.mark.parametrize("percent", [25, 100, 0])
def test_resampling(spark, docs, rows, percent):
    target = [" ".join(fx.prose(999, 60)[5:25]), "ONE two", None, "é è", "w1a w2b"]
    wanted = spark.createDataFrame([(t, "x") for t in target], "text string, bucket string")
    found = resampling.resample(docs, wanted, percent=percent).collect()
    same(found, resampled([(r.doc_id, r.text) for r in rows], target, percent))


def test_resampling_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANKS_AT_ONCE", 7)
    text = " ".join(fx.prose(1, 30))
    many = [(1, text)] * 50 + [(k, " ".join(fx.prose(k, 25))) for k in range(2, 40)]
    found = resampling.resample(spark.createDataFrame(many, "doc_id long, text string"), spark.createDataFrame([(text,)], "text string"), percent=60)
    same(found.collect(), resampled(many, [text], 60))


def test_resampling_of_empty_tables(spark):
    none = fx.no_documents(spark)
    assert resampling.resample(none, none).collect() == []
    one = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    same(resampling.resample(one, none).collect(), resampled([(1, "a b"), (2, None)], []))


# --- 12 --------------------------------------------------------------------------------------------
def index_of(spark, folder):
    return exact_dedup.DigestIndex(spark, str(folder), buckets=4)


def test_exact_dedup(spark, docs, rows, tmp_path):
    index = index_of(spark, tmp_path / "index")
    found = exact_dedup.deduplicate(docs, index, "first").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in groups}
    same([r[:3] + (r.text_sha256,) for r in found],
         [(r.doc_id, largest[r.text or ""], len(groups[r.text or ""]), digest[r.text or ""]) for r in rows])
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert {r.text_sha256 for r in kept} == set(digest.values())
    assert index.entries().count() == len(groups)


def test_later_batches_meet_the_index(spark, tmp_path):
    schema = "doc_id long, text string"
    index = index_of(spark, tmp_path / "index")
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], schema)
    second = spark.createDataFrame([(9, "a"), (8, "c"), (7, "c"), (6, "")], schema)

    def short(df):
        return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())

    expected = [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 1, True)]
    assert short(exact_dedup.deduplicate(first, index, "one")) == expected
    later = [(6, 4, 1, False), (7, 8, 2, False), (8, 8, 2, True), (9, 2, 1, False)]
    assert short(exact_dedup.deduplicate(second, index, "two")) == later
    # Another session's handle on the same folder, and batches that are run again.
    again = index_of(spark, tmp_path / "index")
    assert again.entries().count() == 4
    assert short(exact_dedup.deduplicate(second, again, "two")) == later
    assert short(exact_dedup.deduplicate(first, again, "one")) == expected
    assert again.entries().count() == 4
    assert exact_dedup.deduplicate(first.where("false"), again, "none").collect() == []
    again.close()


def test_the_index_is_read_without_a_shuffle(spark, tmp_path):
    index = index_of(spark, tmp_path / "index")
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    exact_dedup.deduplicate(rows, index, "one")
    groups = rows.select(exact_dedup.digest(F.col("text")).alias("digest")).distinct()
    plan = groups.join(index.entries().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "Python" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


# --- 13 --------------------------------------------------------------------------------------------
def audited(rows, least, ranks):
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fx.lower(r["text"] or ""))
        counts[r["lang"] or "", r["source"] or ""].update(terms)
        seen[r["lang"] or ""].update(set(terms))
    found = []
    for lang in {k[0] for k in counts}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        own = {s: {t: c[t] for t in kept} for (g, s), c in counts.items() if g == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def shares(c, v=len(kept)):
            total = sum(c.values())
            return {t: 1 + 1000000000 * (n + 5) // (total + 5 * v) for t, n in c.items()}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items, last in (("pair", pairs, None), ("term", terms, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                found += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:last])]
    return found


def corpus():
    rows = []
    for k in range(120):
        text = " ".join(w[:2] + w[-1] for w in fx.prose(k, 40 + k % 7, 30 + k % 50))
        rows.append((k, text + " É zZ 12 a_b", [None, "", "en", "fr"][k % 4], [None, "s1", "s2", "s1", "é"][k % 5], "x"))
    rows += [(200, None, "de", "only", "x"), (201, "", "fr", "silent", "x"), (202, "word " * 50, "en", "s9", "x"), (203, None, None, None, None)]
    return rows + rows[:3]


@pytest.mark.parametrize(("least", "ranks", "tile", "block"), [(3, 50, 128, 500_000), (3, 2, 2, 5), (1, 4, 1, 40), (1000, 50, 128, 500_000)])
def test_divergence(spark, monkeypatch, least, ranks, tile, block):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK_ROWS", block)
    schema = "doc_id long, text string, lang string, source string, value string"
    docs = spark.createDataFrame(corpus(), schema)
    rows = [r.asDict() for r in docs.collect()]
    same(divergence.divergence(docs, least_documents=least, ranks=ranks).collect(), audited(rows, least, ranks))


def test_divergence_of_awkward_tables(spark, docs, rows):
    same(divergence.divergence(docs, least_documents=2, ranks=5).collect(), audited([r.asDict() for r in rows], 2, 5))
    assert divergence.divergence(fx.no_documents(spark)).collect() == []


def test_terms_of_long_texts():
    text = "Aé b, c-d 1x " * 300 + "y" * 400
    data = np.frombuffer(text.encode(), np.uint8)
    kept = bt.CHUNK_BYTES
    try:
        bt.CHUNK_BYTES = 100
        found = divergence._long_terms(data)
    finally:
        bt.CHUNK_BYTES = kept
    assert found == Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fx.lower(text)))
