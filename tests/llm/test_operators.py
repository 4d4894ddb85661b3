"""Operators against plain Python, over small tables with every awkward case."""

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from harmonia.llm import (
    decontamination, language, near_dedup, packing, pii, quality, range_coder, sharding, substring_dedup, token_counts,
    token_files, tokens,
)
from harmonia.llm.components import connected_components
from harmonia.llm.scratch import Scratch, opened
from tests.llm import fixtures as fx


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(spark).cache()


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def key(row):
    return tuple((x is not None, x) for x in row)


def same(found, expected):
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, expected), key=key)


# --- 1 ---------------------------------------------------------------------------------------------
def test_shards_are_near_equal_and_places_gapless(spark, docs, pairs, tmp_path):
    rows = sharding.shard(docs, str(tmp_path / "map"), 4).collect()
    same([(r.doc_id, r["size"], r.text_crc32) for r in rows],
         [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs])
    load = [sum(r["size"] for r in rows if r.shard == k) for k in range(4)]
    assert max(load) - min(load) <= max(r["size"] for r in rows)
    for k in range(4):
        own = sorted(r.slot for r in rows if r.shard == k)
        assert own == list(range(len(own)))
    assert {r.law for r in rows} == {"bytes"} and {r.map_version for r in rows} == {2}


def test_rebalancing_moves_only_what_it_must(spark, docs, tmp_path):
    folder = str(tmp_path / "map")
    sharding.shard(docs, folder, 4)
    before = {r.virtual_slot: r.shard for r in sharding.load_map(spark, folder).collect()}
    sizes = sharding.slot_sizes(sharding.records(docs))
    grown = sharding.rebalanced(sharding.load_map(spark, folder), sizes, 5)
    sharding.save_map(grown, folder)
    after = {r.virtual_slot: r.shard for r in sharding.load_map(spark, folder, 3).collect()}
    moved = [s for s in after if after[s] != before[s]]
    held = {r.virtual_slot: r.bytes for r in sizes.collect()}
    assert len(after) == sharding.SLOTS and 4 in after.values()
    assert sum(held[s] for s in moved) <= sum(held.values()) * 0.45
    assert {r.shard for r in sharding.load_map(spark, folder, 1).collect()} == set(range(4))
    shrunk = {r.virtual_slot: r.shard for r in sharding.rebalanced(grown, sizes, 3).collect()}
    assert set(shrunk.values()) == {0, 1, 2}


# --- 2 ---------------------------------------------------------------------------------------------
ITEMS = [
    (1, " ".join(fx.prose(999, 60)[5:25])), (2, "one two three four"), (3, "A B C, d e f g h i j k l"), (4, ""), (5, None),
    (6, "word word word word word word word word word word word word"), (7, "w1a"), (8, "one two three four"), (None, "é è"),
    (9, " ".join(fx.prose(3, 120)[10:20])),
]


@pytest.mark.parametrize("bound", [decontamination.FILTER_BOUND, 0])
def test_decontamination(spark, docs, pairs, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "FILTER_BOUND", bound)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS] + [(1, ITEMS[0][1], "x")], "item_id long, text string, hits string")
    found = decontamination.decontaminate(docs, items).drop("item_ids", "text_key").collect()
    same(found, fx.contamination(pairs, ITEMS))


def test_winnowing_keeps_one_of_every_window():
    words = np.random.default_rng(5).integers(0, 4, 500).astype(np.uint64)
    bounds = np.array([0, 9, 10, 200, 500])
    grams, at = decontamination.bt.gram_hashes(words, bounds, 5)
    _, kept = decontamination.winnow(grams, at, bounds)
    for low, high in zip(bounds, bounds[1:], strict=False):
        for k in range(low, high - 9):
            assert ((kept >= k) & (kept <= k + 5)).any()


# --- 3 ---------------------------------------------------------------------------------------------
def test_passages_shared_across_documents(spark, docs, pairs):
    found = substring_dedup.repeated_passages(docs).collect()
    text = dict(p for p in pairs if p[0] is not None)
    named = {(r.doc_id, r.other_id) for r in found}
    first = len([t for t in fx.texts()]) - len(fx.AWKWARD) - 5 + 1
    for k in range(1, 5):
        row = next(r for r in found if (r.doc_id, r.other_id) == (first + k, first))
        words = fx.alphanumeric_words(text[row.doc_id])[row.start_word:row.end_word]
        assert set(fx.prose(999, 60)) <= set(words) and len(words) <= 66
    for k in range(6):
        near, copy, half = 13 + 3 * k, 14 + 3 * k, 15 + 3 * k
        assert {(near, k + 1), (copy, k + 1), (half, k + 1)} <= named
    for r in found:
        own = fx.alphanumeric_words(text[r.doc_id])[r.start_word:r.end_word]
        other = fx.alphanumeric_words(text[r.other_id])[r.other_start_word:r.other_end_word]
        assert len(own) == r.end_word - r.start_word and len(other) == r.other_end_word - r.other_start_word
        assert r.n_match >= substring_dedup.IDENTITY * max(len(own), len(other)) and min(len(own), len(other)) >= substring_dedup.PASSAGE_WORDS


def test_chains_against_all_chains():
    rng = random.Random(4)
    for _ in range(30):
        points = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(9)})
        best = 0.0
        for mask in range(1, 1 << len(points)):
            path = [p for k, p in enumerate(points) if mask >> k & 1]
            if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(path, path[1:], strict=False)):
                cost = sum(b[0] - a[0] + b[1] - a[1] for a, b in zip(path, path[1:], strict=False)) * substring_dedup.GAP_COST
                best = max(best, substring_dedup.SEED_WORDS * len(path) - cost)
        path = substring_dedup.chains(points)[0]
        cost = sum(b[0] - a[0] + b[1] - a[1] for a, b in zip(path, path[1:], strict=False)) * substring_dedup.GAP_COST
        assert abs(substring_dedup.SEED_WORDS * len(path) - cost - best) < 1e-9


def test_one_diagonal_is_no_special_case(monkeypatch):
    rng = random.Random(9)
    for _ in range(60):
        points = sorted({x for x in (rng.randrange(400) for _ in range(rng.randrange(1, 30)))})
        matches = [(x, x + 7) for x in points]
        assert substring_dedup._on_one_diagonal(matches) == substring_dedup._best_predecessors(matches)
    general = substring_dedup.align
    for seed in range(40):
        words = np.random.default_rng(seed).integers(0, 50, 300).astype(np.uint64)
        other = words.copy()
        changed = np.random.default_rng(seed + 1000).integers(0, 300, seed * 3)
        other[changed] = 99
        seeds = [k for k in range(20, 280, 9) if (words[k:k + 5] == other[k:k + 5]).all()]
        if len(seeds) < 2:
            continue
        found = substring_dedup.passages(words, other, seeds, seeds, 40, 0.75)
        parts = general(words, other, seeds, seeds)
        n, same = sum(p[0] for p in parts), sum(p[2] for p in parts)
        start = seeds[0] - parts[0][0]
        if n >= 40 and same >= 0.75 * n:
            assert found == [(start, start + n, start, start + n, same)]


def covered(rows, docs: dict[int, list[str]]) -> dict[int, set[int]]:
    """The words of each document that its passages hold, every passage checked."""
    held: dict[int, set[int]] = {}
    for r in rows:
        own, other = docs[r.doc_id][r.start_word:r.end_word], docs[r.other_id][r.other_start_word:r.other_end_word]
        assert len(own) == r.end_word - r.start_word and len(other) == r.other_end_word - r.other_start_word
        assert r.n_match >= substring_dedup.IDENTITY * max(len(own), len(other)) and min(len(own), len(other)) >= substring_dedup.PASSAGE_WORDS
        held.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return held


def test_two_passages_with_other_text_between(spark):
    """Both of two exact passages are found, whatever lies between them."""
    rng, docs, expected = random.Random(12), {}, {}
    word = lambda: f"v{rng.randrange(10**6)}"
    for words, gap in [(60, 30), (60, 60), (60, 100), (60, 150), (60, 250), (100, 150), (300, 500)] * 5:
        first, second = ([word() for _ in range(words)] for _ in range(2))
        for other in (False, True):
            i = len(docs) + 1
            docs[i] = [word() for _ in range(9)] + first + [word() for _ in range(gap + 5 * other)] + second + [word() for _ in range(9)]
        expected[i] = {*range(9, 9 + words), *range(14 + words + gap, 14 + 2 * words + gap)}
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = covered(substring_dedup.repeated_passages(table).collect(), docs)
    assert {i for i in expected if not expected[i] <= found.get(i, set())} == set()


def test_longest_parts_against_all_parts():
    rng = random.Random(13)
    for _ in range(200):
        parts = [(3, 3, 3), (5, 5, 5)]
        for _ in range(rng.randrange(6)):
            on, back, n, m = rng.randrange(12), rng.randrange(12), rng.randrange(40), rng.randrange(40)
            parts += [(on, on, on), (n, m, rng.randrange(min(n, m) + 1)), (back, back, back), (5, 5, 5)]
        parts.append((2, 2, 2))

        def passing(low, high, parts=parts):
            for a in range(low, high):
                for b in range(a + 1, high + 1):
                    n, m, same = (sum(p[k] for p in parts[a:b]) for k in range(3))
                    if a % 4 != 3 and b % 4 != 0 and min(n, m) >= 20 and 4 * same >= 3 * max(n, m):
                        yield min(n, m), a, b

        found, low = substring_dedup.longest_parts(parts, 20, 0.75), 0
        assert max((n for n, _, _ in passing(0, len(parts))), default=0) == max(
            (min(sum(p[k] for p in parts[a:b]) for k in range(2)) for a, b in found), default=0)
        for a, b in [*sorted(found), (len(parts), len(parts))]:
            assert a >= low and not list(passing(low, a)) and (a == b or any((x, y) == (a, b) for _, x, y in passing(a, b)))
            low = b


def test_passage_whose_fragments_stand_in_earlier_documents(spark):
    """Holders of a passage meet although each of its pieces occurs first elsewhere."""
    rng, docs, expected = random.Random(14), {}, {}
    word = lambda: f"v{rng.randrange(10**6)}"
    for pieces in [2, 3, 4] * 10:
        passage, n = [word() for _ in range(60)], 60 // pieces
        held = [passage[k * n:(k + 1) * n] for k in range(pieces)] + [passage] * 3
        for piece in held:
            docs[len(docs) + 1] = [word() for _ in range(30)] + piece + [word() for _ in range(30)]
        expected |= {len(docs) - k: set(range(30, 90)) for k in range(2)}
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = covered(substring_dedup.repeated_passages(table).collect(), docs)
    assert {i for i in expected if not expected[i] <= found.get(i, set())} == set()


def test_every_exact_passage_of_the_least_length(spark):
    """Exact passages of 40 to 50 words are met whatever fragments stand in earlier documents, at texts' ends too."""
    rng, docs, expected = random.Random(15), {}, {}
    word = lambda: f"v{rng.randrange(10**6)}"
    for n in [40, 41, 42, 43, 45, 50] * 8:
        passage, cut = [word() for _ in range(n)], rng.randrange(8, 32)
        before, after = (rng.choice([0, 30]) for _ in range(2))
        for piece in (passage[:cut], passage[cut:], passage[3:37], passage[:36]):
            docs[len(docs) + 1] = [word() for _ in range(30)] + piece + [word() for _ in range(30)]
        docs[len(docs) + 1] = [word() for _ in range(30 - before)] + passage + [word() for _ in range(30 - after)]
        docs[len(docs) + 1] = [word() for _ in range(before)] + passage + [word() for _ in range(after)]
        expected[len(docs)] = set(range(before, before + n))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = covered(substring_dedup.repeated_passages(table).collect(), docs)
    assert {i for i in expected if len(expected[i] & found.get(i, set())) < 0.75 * len(expected[i])} == set()


def test_changed_passages(spark):
    """Passages with words replaced at random, against all pairs of windows: those of 40 words may have no two seeds in common."""
    rng, docs, holds = random.Random(16), {}, {}
    word = lambda: f"v{rng.randrange(10**6)}"
    for n, share in [(40, 0.05), (50, 0.1), (60, 0.1), (60, 0.15), (100, 0.15), (100, 0.2)] * 40:
        passage = [word() for _ in range(n)]
        changed = set(rng.sample(range(n), round(n * share)))
        for held in (passage, [word() if k in changed else w for k, w in enumerate(passage)]):
            docs[len(docs) + 1] = [word() for _ in range(30)] + held + [word() for _ in range(30)]
        same = [k not in changed for k in range(n)]
        if any(sum(same[k:k + 40]) >= 30 for k in range(n - 39)):
            holds.setdefault((n, share), []).append(len(docs))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = covered(substring_dedup.repeated_passages(table).collect(), docs)
    met = {key: sum(i in found for i in ids) / len(ids) for key, ids in holds.items()}
    assert min(met.values()) >= 0.85 and sum(met.values()) >= 0.95 * len(met), met


def test_a_passage_whose_end_is_changed(spark):
    """40 words of which the first, the last and some others differ."""
    rng, docs = random.Random(17), {}
    word = lambda: f"v{rng.randrange(10**6)}"
    for _ in range(20):
        passage = [word() for _ in range(40)]
        for held in (passage, [word(), *passage[1:20], word(), *passage[21:38], word(), word()]):
            docs[len(docs) + 1] = [word() for _ in range(10)] + held + [word() for _ in range(5)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    assert set(covered(substring_dedup.repeated_passages(table).collect(), docs)) == set(range(2, 41, 2))


def test_chains_of_many_pairs_at_once():
    rng, long = random.Random(18), substring_dedup.LONG_WORDS
    pairs = []
    for _ in range(200):
        apart = rng.randrange(3)
        pairs.append([(x, x + rng.choice([0, 0, 0, 3][:apart + 2])) for x in (rng.randrange(300) for _ in range(rng.randrange(1, 9)))])
        if rng.random() < 0.3:
            pairs[-1].append((~50, ~53))
    flat = np.array([m for pair in pairs for m in pair])
    found = substring_dedup.pair_chains(np.array([len(p) for p in pairs]), flat[:, 0], flat[:, 1])
    for pair, held in zip(pairs, found, strict=True):
        steps = [*range(0, long - 5, 5), long - 5]
        short = [m for x, y in pair for m in ([(x, y)] if x >= 0 else [(~x + k, ~y + k) for k in steps])]
        assert held == [c for c in substring_dedup.chains(short) if len(c) >= substring_dedup.LEAST_SEEDS]


# --- 4 ---------------------------------------------------------------------------------------------
def test_quality_base_and_verdict(spark, docs, pairs):
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0, "x") for k in range(1, 24)] + [(None, 1, 0, "x"), (3, None, 0, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    model = quality.fit(docs, labels)
    found = quality.score(docs, model).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found],
         [(i, *fx.base_quality(t)) for i, t in pairs])
    assert not any(r.kept and r.base_failed for r in found)
    left = quality.keep_good(docs, model)
    assert left.schema == docs.schema
    same([(r.doc_id,) for r in left.collect()], [(r.doc_id,) for r in found if r.kept])


def test_log_ratio_parts_good_from_junk(spark):
    good = [" ".join(fx.prose(k, 80)) for k in range(60)]
    junk = [" ".join(f"{w}*** %%{w[::-1]}&&" for w in fx.prose(1000 + k, 80)) for k in range(30)]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(good + junk)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(0, 90, 2)], "doc_id long, quality int")
    verdict = {r.doc_id: r.kept for r in quality.quality(table, labels).collect()}
    assert all(verdict[k] == (k < 60) for k in range(90))
    assert all(r.kept for r in quality.quality(table, labels.where("quality > 1")).collect())


def test_most_poor_and_trusted_rows_get_the_right_verdict(spark):
    """On rows that set neither the target nor the threshold: both are fitted on every other label."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality IS NOT NULL").collect()
    learnt = spark.createDataFrame([r for k, r in enumerate(sorted(labels)) if k % 2], labels[0].__fields__)
    held = {r.doc_id: r.quality for k, r in enumerate(sorted(labels)) if not k % 2}
    rows = [r for r in quality.quality(docs, learnt).collect() if r.doc_id in held and not r.base_failed]
    for wanted in (0, 1):
        own = [r for r in rows if held[r.doc_id] == wanted]
        assert len(own) >= 10 and sum(r.kept == bool(wanted) for r in own) >= 0.9 * len(own)


# --- 5 ---------------------------------------------------------------------------------------------
PERSONAL = [
    "a@b.c_d@e.f x a@b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 1.2.3", "+5          +5 1234567890 + 12 +1 (017) 555-7713.",
    "4111 1111 1111 1111 x 4111-1111-1111-1112 é 378282246310005", "GB82 WEST 1234 5698 7654 32 iban", "GB83 WEST 1234 5698 7654 32",
    "my ssn 123-45-6789", "123-45-6789", 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"', "@a.b ..@x.y %@-.- +1()()()()23456789 1",
    "9" * 100_000, "a" * 100_000 + "@", "x1@y.zz " * 300, "1-" * 50_000,
]


def test_personal_data(spark, pairs):
    rows = pairs + [(500 + k, t) for k, t in enumerate(PERSONAL)]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    found = pii.find_pii(table)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    same([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found.drop("text").collect()],
         [(i, *(fx.personal_data(t) if len(t or "") < 90_000 else fx.personal_data(""))) for i, t in rows])
    spans = {r.doc_id: r.spans for r in found.collect()}
    assert spans[504] == "iban:0:27" and spans[505] == "" and spans[506] == "ssn:7:18" and spans[507] == "" and spans[508] == "secret:9:49"
    texts = {r.doc_id: r.text for r in pii.redact(table).collect()}
    assert texts[500] == "[EMAIL][EMAIL] x a@[EMAIL]" and texts[503] == "[CARD] x 4111-1111-1111-1112 é [CARD]" and texts[2] == dict(rows)[2]
    assert pii.redact(table).columns == table.columns


def test_account_numbers_before_other_capitals_and_context_after(spark):
    texts = {
        1: "DE89370400440532013000 BIC COBADEFF", 2: "DE89 3704 0044 0532 0130 00 EUR 500", 3: "GB82 WEST 1234 5698 7654 32 AND MORE",
        4: "NO93 8601 1117 947 DE89370400440532013000", 5: "DE88370400440532013000 BIC COBADEFF", 6: "123-45-6789 (SSN)", 7: "123-45-6789 (no)",
        8: f"{'ab' * 16} is the API token", 9: "DE89 3704 0044 0532 013 GB82 WEST 1234 5698 7654 32",
    }
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find_pii(table).collect()}
    assert spans == {1: "iban:0:22", 2: "iban:0:27", 3: "iban:0:27", 4: "iban:0:18,iban:19:41", 5: "", 6: "ssn:0:11", 7: "", 8: "secret:0:32", 9: "iban:24:51"}
    redacted = {r.doc_id: r.text for r in pii.redact(table).collect()}
    assert redacted[1] == "[IBAN] BIC COBADEFF" and redacted[2] == "[IBAN] EUR 500"


def test_many_numbers_in_a_text_and_clashing_names(spark):
    """Hundreds of thousands of matches in one text take seconds; columns may have any names."""
    one = "call +49 30 1234567 or a.b@c.de é 10.0.0.1 {:06d} "
    text = "".join(one.format(k) for k in range(34_000))
    assert len(text) > 1_500_000
    table = spark.createDataFrame([(1, text, "p", "q", 5)], "doc_id long, text string, _pii string, spans_email string, `a.b` int")
    begun = time.monotonic()
    row = pii.find_pii(table).collect()[0]
    counts = fx.personal_data(text)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.base_sha256) == counts and row.n_email == row.n_ip == 34_000
    found = pii.redact(table)
    assert found.columns == table.columns
    kept = found.collect()[0]
    assert kept.text == "".join(f"call [PHONE] or [EMAIL] é [IP] {k:06d} " for k in range(34_000))
    assert tuple(kept)[2:] == ("p", "q", 5) and time.monotonic() - begun < 60


# --- 6 ---------------------------------------------------------------------------------------------
def test_language(spark, pairs):
    rng = random.Random(3)
    kinds = {"aa": "alo mita ruko senda".split(), "bb": "xhu zrt vgor plyk".split(), "cc": "дом мир лес река".split()}
    rows = [(k, " ".join(rng.choice(kinds[n]) for _ in range(30)), n) for k, n in enumerate(list(kinds) * 40)]
    rows.append((900, " ".join(kinds["aa"] * 5 + kinds["cc"] * 3), None))
    rows += [(1000 + k, t, None) for k, (_, t) in enumerate(pairs)] + [(None, "alo mita", "aa")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.language(table).collect()}
    assert len(found) == len(rows)
    for i, t, n in rows:
        if n:
            assert found[i].lang_pred == n and found[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert (found[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= found[i].score <= 1
    assert (found[900].lang_pred, found[900].n_spans) == ("aa", 2) and 0.5 < found[900].score < 0.7
    assert {r.lang_pred for r in language.language(fx.documents(spark).where("lang IS NULL")).collect()} == {"und"}


def test_best_path_against_all_paths():
    rng = np.random.default_rng(6)
    bounds = np.array([0, 5, 5, 6, 12])
    scores = rng.integers(-9000, 0, (12, 3)).astype(np.int32)
    path = language.best_path(scores, bounds)
    for low, high in zip(bounds, bounds[1:], strict=False):
        def total(states, low=low):
            return sum(int(scores[low + k, s]) for k, s in enumerate(states)) - language.SWITCH * sum(a != b for a, b in zip(states, states[1:], strict=False))
        n = high - low
        if n:
            every = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
            assert total(path[low:high].tolist()) == max(total(s) for s in every.tolist())


# --- 7, 8, 9 -----------------------------------------------------------------------------------------
def ids_of(name: str, text: str | None) -> np.ndarray:
    tokenizer = Tokenizer.from_file(tokens.tokenizer_path(name))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_packing(docs, pairs):
    rows = packing.pack(docs, capacity=64, open_bins=3).collect()
    expected = []
    for i, t in pairs:
        ids = ids_of(tokens.WORD_BPE, t)
        expected += [(i, k // 64, k, min(64, len(ids) - k), zlib.crc32(ids[k:k + 64].tobytes())) for k in range(0, len(ids), 64)]
    same([r[:5] for r in rows], expected)
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert all(o == sum(n for _, n in held[:k]) for k, (o, _) in enumerate(held)) and sum(n for _, n in held) <= 64


def test_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # the bin of 7 closed
    assert bins.place(3) == (0, 6) and bins.place(2) == (2, 8) and bins.place(10) == (3, 0) and bins.place(1) == (0, 9)


def test_token_counts(docs, pairs):
    vocabulary = token_counts.rank_vocabulary(tokens.tokenizer_path(token_counts.PIECE_MODEL))
    library = Tokenizer(models.Unigram([("<unk>", -1e3), *vocabulary], unk_id=0))
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    extra = ["ab\U0001f600\U0001f601c \x01\x02 x\x01y", "\U0001f600", " a ", "▁▁ ▁a"]
    found = token_counts.token_counts(docs).collect()
    same([(r.doc_id, r.n_tokens) for r in found], [(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in pairs])
    counts = token_counts.WordCounts(token_counts.UnigramCounter(vocabulary))
    for t in extra:
        raw = np.frombuffer(t.encode(), np.uint8)
        assert counts.totals(raw, np.array([0, len(raw)]))[1].tolist() == [len(library.encode(t, add_special_tokens=False).ids)]


def test_ties_go_to_the_earlier_start():
    counter = token_counts.UnigramCounter([("a", -1.0), ("aa", -2.0), ("b", -1.0), ("ab", -2.0), ("aab", -3.0)])
    library = Tokenizer(models.Unigram([("<unk>", -50.0), ("a", -1.0), ("aa", -2.0), ("b", -1.0), ("ab", -2.0), ("aab", -3.0)], unk_id=0))
    for word in ("a", "aa", "aab", "abab", "aaab", "ba", "aaaaab", "axxb"):
        assert counter.counts([word]) == [len(library.encode(word).ids)]


def test_token_files(spark, docs, pairs, tmp_path):
    found = token_files.token_ids(docs, str(tmp_path / "ids")).collect()
    coded = [(i, ids_of(tokens.BYTE_BPE, t)) for i, t in pairs]
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in found], [(i, len(x), zlib.crc32(x.tobytes())) for i, x in coded])
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.doc_id or -1 for r in sorted(found, key=lambda r: r.start)]
    assert ordered == sorted(ordered)


def test_frames_are_filled_across_batches(monkeypatch):
    """Small batches make no small blocks: what they hold is coded together, with the same ids."""
    monkeypatch.setattr(token_files, "FRAME_IDS", 1000)
    rng, frames = np.random.default_rng(19), token_files._Frames(3, 50257)
    docs = [rng.integers(0, 50257, n).astype(np.uint32) for n in (0, 1, 300, 2500, 999, 1, *rng.integers(0, 400, 40))]
    found = []
    for low in range(0, len(docs), 4):
        part = docs[low:low + 4]
        found += frames.add(pa.array(range(low, low + len(part)), pa.int64()), np.concatenate(part), np.array([len(d) for d in part]))
    found = [f.to_pylist()[0] for f in [*found, *frames.rest()]]
    assert all(1000 <= f["n_ids"] < 1000 + max(f["lengths"]) for f in found[:-1]) and not list(frames.rest())
    assert [f["frame"] for f in found] == list(range(len(found))) and {f["part"] for f in found} == {3}
    assert [d for f in found for d in f["doc_ids"]] == list(range(len(docs)))
    assert [f["before"] for f in found] == np.cumsum([0, *(f["n_ids"] for f in found)])[:-1].tolist()
    back = np.concatenate(range_coder.decode([f["payload"] for f in found], 50257))
    assert (back == np.concatenate(docs)).all() and [n for f in found for n in f["lengths"]] == [len(d) for d in docs]


def test_a_tokenizer_forgets_pieces_by_their_ids(monkeypatch):
    held = tokens.PieceEncoder(tokens.tokenizer_path(tokens.BYTE_BPE), tokens.spaced_pieces)
    library = Tokenizer.from_file(tokens.tokenizer_path(tokens.BYTE_BPE))
    monkeypatch.setattr(tokens, "REMEMBERED_IDS", 2000)
    for k in range(8):
        # Blank-free texts: one long piece each.
        data = "".join(f"語{k * 400 + j}文" for j in range(400)).encode()
        ids, bounds = held.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert ids.tolist() == library.encode(data.decode(), add_special_tokens=False).ids and bounds[-1] == len(ids)
        assert held.used <= 2000 + len(ids)


def test_range_coder_round_trips_and_checks():
    rng = np.random.default_rng(8)
    for ids in (np.zeros(0, int), np.array([7]), np.zeros(9000, int), rng.integers(0, 50257, 9000), rng.integers(0, 40, 20000)):
        ids = ids.astype(np.uint32)
        blocks = [ids[k:k + 4096] for k in range(0, len(ids), 4096)]
        coded = range_coder.encode_blocks(blocks, 50257)
        assert (range_coder.decode([b"".join(coded)], 50257)[0] == ids).all()
    # All different, one block short, and both ends of the vocabulary.
    mixed = [np.arange(4096, dtype=np.uint32), np.array([50256, 0, 50256], np.uint32), np.zeros(1, np.uint32)]
    back = range_coder.decode(range_coder.encode_blocks(mixed, 50257), 50257)
    assert all((a == b).all() for a, b in zip(back, mixed, strict=True))
    broken = bytearray(coded[0])
    broken[40] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode([bytes(broken)], 50257)


def test_range_coder_mixes_three_orders():
    rng = np.random.default_rng(3)
    bits = {}
    for name, ids in (
        ("skewed", rng.choice(200, 40960, p=1 / np.arange(1, 201) / (1 / np.arange(1, 201)).sum())),
        ("order 1", np.arange(40960) % 97 * 31),
        ("order 2", np.tile([1, 2, 3, 1, 4, 3, 5, 1, 6, 2], 4096)),
    ):
        blocks = [ids[k:k + 4096].astype(np.uint32) for k in range(0, len(ids), 4096)]
        bits[name] = 8 * sum(map(len, range_coder.encode_blocks(blocks, 50257))) / len(ids)
    # Near the entropy where only counts help (6.1 bits), near nothing where contexts tell all.
    assert bits["skewed"] < 6.8 and bits["order 1"] < 1 and bits["order 2"] < 0.6, bits


def test_lanes_of_a_long_block_share_one_model():
    ids = np.random.default_rng(4).permutation(np.repeat(np.arange(6000, dtype=np.uint32), 20))
    coded = range_coder.encode_blocks([ids, ids[:5000]], 50257)
    assert all((a == b).all() for a, b in zip(range_coder.decode(coded, 50257), [ids, ids[:5000]], strict=True))
    # 6,000 ids as often as one another are 12.55 bits each.
    assert 8 * len(coded[0]) / len(ids) < 13.4


def test_pieces_are_given_to_the_library_in_rows(monkeypatch):
    path = tokens.tokenizer_path(tokens.BYTE_BPE)
    held, library = tokens.PieceEncoder(path, tokens.spaced_pieces), Tokenizer.from_file(path)
    rng, given, encoded = random.Random(6), [], held._encoded
    monkeypatch.setattr(held, "_encoded", lambda texts: given.extend(texts) or encoded(texts))
    parts = ["ab", "é", " ", " ", "\n", "\t", "'s", "12", "<|endoftext|>", "\u3000", "\xa0", "\x85", "\x1c", "語", "ß", ".", "%%", "😀"]
    for texts in (["".join(rng.choice(parts) for _ in range(30)) for _ in range(300)], [" ".join(f"w{k}x" for k in range(3000))]):
        given.clear()
        data, lengths = "".join(texts).encode(), [len(t.encode()) for t in texts]
        ids, bounds = held.encode(np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(lengths)]))
        for k, text in enumerate(texts):
            assert ids[bounds[k]:bounds[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
    # 3,000 pieces, all but the first of them in rows.
    assert len(given) <= 3000 / tokens.IN_A_ROW + 2


# --- 10 --------------------------------------------------------------------------------------------
def test_near_dedup(docs, pairs, monkeypatch):
    for full in (near_dedup.FULL_BUCKET, 2):
        monkeypatch.setattr(near_dedup, "FULL_BUCKET", full)
        found = near_dedup.near_dedup(docs).collect()
        groups = fx.near_groups(dict(p for p in pairs if p[0] is not None))
        expected = [(i, *groups[i], groups[i][1] == i) if i is not None else (None, len(fx.shingle_set(t)), None, True) for i, t in pairs]
        same(found, expected)


def test_scratch_of_one_job_is_not_seen_by_another(spark):
    with opened() as outer:
        first = Scratch(spark, "outer")
        with opened() as inner:
            second = Scratch(spark, "inner")
    Scratch(spark, "alone")
    assert outer == [first] and inner == [second]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)] + [(7, 7)]
    parent = list(range(200))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    same(found, [(n, root(n)) for n in nodes])


# --- all -------------------------------------------------------------------------------------------
def test_empty_tables(spark, tmp_path):
    none = fx.no_documents(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    for found in (
        sharding.shard(none, str(tmp_path / "map")), decontamination.decontaminate(none, items), substring_dedup.repeated_passages(none),
        quality.quality(none, labels), pii.find_pii(none), pii.redact(none), language.language(none), packing.pack(none),
        token_counts.token_counts(none), token_files.token_ids(none, str(tmp_path / "ids")), near_dedup.near_dedup(none),
    ):
        assert found.count() == 0


def test_a_changed_passage_that_a_nearer_document_holds(spark):
    """All seeds of the passage first stand in earlier documents, which hold too little of it each."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(7))
    rows, want = [], set()
    for k in range(20):
        passage = [word() for _ in range(60)]
        fragments = [passage[low:low + 20] for low in range(0, 60, 10)]
        changed = [word() if n % 10 == 5 else w for n, w in enumerate(passage)]
        for n, text in enumerate([*fragments, passage, changed]):
            rows.append((k * 10 + n, " ".join([*(word() for _ in range(30)), *text, *(word() for _ in range(30))])))
        want.add((k * 10 + 7, k * 10 + 6))
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in found} >= want


def test_gaps_of_any_size_are_compared_in_order(monkeypatch):
    def common(left, right):
        row = [0] * (len(right) + 1)
        for word in left:
            before = row[:]
            for k, other in enumerate(right, 1):
                row[k] = before[k - 1] + 1 if word == other else max(before[k], row[k - 1])
        return row[-1]

    rng = np.random.default_rng(4)
    cases = [(rng.integers(0, words, n), rng.integers(0, words, m)) for words, n, m in ((3, 5, 9), (50, 290, 301), (4, 70, 31), (200, 301, 300))]
    # One word more at its start: nothing stands in its place after it.
    long = rng.integers(0, 10**6, 400)
    cases.append((long, np.insert(long, 1, -1)))
    for bits in (1 << 13, 64, 7):
        monkeypatch.setattr(substring_dedup, "_GAP_BITS", bits, raising=False)
        for left, right in cases:
            assert substring_dedup._gap_matches(left, right) == common(left.tolist(), right.tolist())
