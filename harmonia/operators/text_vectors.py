"""TF-IDF vectors and nearest centroids of whole texts.

A text is one row.  Its n-grams are codes that a task counts where it needs them,
from the text: counts take several times the room of the text, so none are
written or shuffled.  Texts are dealt to groups of bounded size, and each group
is given the whole model, or one block of it at a time where it has more tokens
than a task should hold.  A task reads the model, then its texts one batch after
another, and gives what it finds for each text (and label).  N-grams are rows
only in the counts by token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harmonia.fixed_values import NGRAM_SIZES
from harmonia.functions import ngram_counts
from harmonia.functions.text import text
from harmonia.operators.text_model import ID
from harmonia.session import parallel, rows_per_batch, small_reads, written

# Tokens in one block of a model (for each label, where there are centroids), and codes in one group of texts.
BLOCK_TOKENS = 16_000_000
GROUP_CODES = 200_000_000
# A task has a group of one block; with more groups than these, several one after another.
MOST_TASKS = 400
# Codes in a batch of packed texts that a Python worker is given; a text with more is a batch of its own.
BATCH_CODES = 2_000_000
# Packed texts that a scan decodes at once; 4,096 by default, with thousands of codes each.
READ_ROWS = 128
# Codes in one array of a model: arrays are collected on the heap, over a hundred bytes a code.
ARRAY_CODES = 16_384

DIGITS = 8


# --- counts ---------------------------------------------------------------------------------------
def texts(records: DataFrame, column: str, *keep: str) -> DataFrame:
    """``record_id``, kept columns and ``text``, to be counted by the tasks that read them."""
    return records.select(ID, *keep, text(F.col(column)).alias("text"))


def packed_counts(records: DataFrame, column: str, *keep: str) -> DataFrame:
    """``record_id``, kept columns, ``codes``, ``n`` and ``digest`` of every text that is not empty once normalised.

    All below takes these in place of `texts`; they hold several times as many bytes.
    """
    small_reads(records.sparkSession, READ_ROWS)
    rows = parallel(texts(records, column, *keep))
    kept = rows.schema.fields[:-1]
    arrays = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("codes", "n")]
    schema = T.StructType([*kept, *arrays, T.StructField("digest", T.BinaryType())])
    return rows.mapInArrow(ngram_counts.packer(len(kept)), schema)


def _is_packed(rows: DataFrame) -> bool:
    return "codes" in rows.columns


def bounded(packed: DataFrame, work: Callable, schema: T.StructType | str) -> DataFrame:
    """``work`` on batches of packed texts of bounded size, written once.

    A batch is so many rows by default, however many codes they hold.
    """
    most = packed.agg(F.max(F.size("codes"))).first()[0] or 1
    with rows_per_batch(packed.sparkSession, BATCH_CODES // max(1, most)):
        return written(packed.mapInArrow(work, schema))


def document_frequency(rows: DataFrame, examples: int) -> DataFrame:
    """``code, digest, df, idf``: n-grams have a code, whole texts a digest.

    Codes are counted in the tasks that hold them; rows follow the tasks' distinct
    codes, not the texts.
    """
    if not _is_packed(rows):
        counted = parallel(rows.select("text")).mapInArrow(ngram_counts.count_texts, "code int, digest binary, df long")
        return _with_idf(counted.groupBy("code", "digest").agg(F.sum("df").alias("df")), examples)
    grams = bounded(rows.select("codes"), ngram_counts.count_codes, "code int, df long")
    whole = rows.groupBy("digest").agg(F.count("*").alias("df"))
    tokens = grams.groupBy("code").agg(F.sum("df").alias("df")).select("code", F.lit(None).cast("binary").alias("digest"), "df")
    return _with_idf(tokens.unionByName(whole.select(F.lit(None).cast("int").alias("code"), "digest", "df")), examples)


def frequency_of_texts(records: DataFrame, column: str) -> DataFrame:
    """`document_frequency` of the texts of a column."""
    return document_frequency(texts(records, column), records.count())


def _with_idf(tokens: DataFrame, examples: int) -> DataFrame:
    return tokens.withColumn("idf", F.round(F.log(F.lit(examples + 1) / (F.col("df") + 1)) + F.lit(1.0), 6))


# --- groups of texts and blocks of tokens -----------------------------------------------------------
@dataclass(frozen=True)
class Deal:
    """How many blocks the tokens are dealt to, how many groups the texts, and how many arrays hold a block."""

    blocks: int
    groups: int
    arrays: int

    @classmethod
    def of(cls, rows: DataFrame, tokens: DataFrame, labels: int = 1) -> Deal:
        distinct = tokens.where("code IS NOT NULL").count()
        size = F.size("codes") if _is_packed(rows) else F.length("text") * len(NGRAM_SIZES)
        codes = rows.agg(F.sum(size.cast("long"))).first()[0] or 0
        blocks = max(1, -(-distinct * labels // BLOCK_TOKENS))
        # All cores have a group of each block.
        groups = max(rows.sparkSession.sparkContext.defaultParallelism, -(-codes // GROUP_CODES))
        return cls(blocks, groups, max(1, -(-distinct // (blocks * ARRAY_CODES))))

    def group(self) -> Column:
        return F.pmod(F.xxhash64(ID), F.lit(self.groups)).cast("int").alias("group")

    def in_blocks(self, values: DataFrame, kind: str, value: str, *by: str) -> DataFrame:
        """``values`` by code as arrays: rows for every block (and label)."""
        block, array = F.pmod("code", F.lit(self.blocks)).alias("block"), F.pmod(F.xxhash64("code"), F.lit(self.arrays)).alias("array")
        held = values.where("code IS NOT NULL").groupBy(block, array, *by).agg(F.collect_list(F.struct("code", F.col(value).alias("v"))).alias("_all"))
        return held.select(
            "block", F.lit(kind).alias("kind"), (F.col(by[0]) if by else F.lit(None).cast("string")).alias("label"),
            F.col("_all.code").alias("codes"), F.col("_all.v").alias("values"),
        )

    def in_groups(self, values: DataFrame) -> DataFrame:
        """Rows of blocks in every group."""
        return values.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))

    def meet(self, model: DataFrame, rows: DataFrame, work: Callable, schema: T.StructType | str) -> DataFrame:
        """``work`` on every group and block: their rows of the model come first, then the texts as ``own``.

        Texts come by kind "text", behind all others in order.
        """
        names = [f.name for f in rows.schema.fields]
        own = rows.select(
            self.group(), F.struct(*names).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block")
        ).withColumn("kind", F.lit(TEXT))
        part = (F.col("block") * self.groups + F.col("group")).alias("part")
        both = model.unionByName(own, allowMissingColumns=True).select(part, "kind", *MODEL_COLUMNS, "own")
        tasks = min(self.blocks * self.groups, MOST_TASKS)
        dealt = both.repartitionById(tasks, F.pmod("part", F.lit(tasks))).sortWithinPartitions("part", "kind")
        return dealt.mapInArrow(_met(work, names), schema)


TEXT = "text"
MODEL_COLUMNS = ("label", "codes", "values", "digest", "value")


def _met(work: Callable, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work(model, packed texts)`` for each part, whose rows come one after another."""
    pack = ngram_counts.packer(len(names) - 1) if names[-1] == "text" else lambda batches: batches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, model, state = None, [], None, None
        for batch in batches:
            parts, is_text = batch.column("part").to_numpy(), pc.equal(batch.column("kind"), TEXT).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(is_text.view(np.int8)) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(parts)], strict=True):
                if low == high:
                    continue
                if parts[low] != part:
                    if state is not None:
                        yield from state.rest()
                    part, held, model, state = parts[low], [], None, None
                rows = batch.slice(low, high - low)
                if not is_text[low]:
                    held.append(rows.select(["kind", *MODEL_COLUMNS]))
                    continue
                if state is None:
                    model, held = _Model(held), []
                    state = work(model)
                own = pa.RecordBatch.from_arrays(rows.column("own").flatten(), names=names)
                for packed in pack([own]):
                    if len(packed):
                        yield from state.texts(packed)
        if state is not None:
            yield from state.rest()

    return run


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([*column.chunks, pa.array([], column.type)])


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after another, and how many each list has."""
    lists = _one(column) if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


class _Places:
    """Where a code stands among sorted ones: a bit for each known code, and the number of those before every 64."""

    def __init__(self, codes: np.ndarray):
        self.bits = np.zeros((ngram_counts.BASE ** max(NGRAM_SIZES) >> 6) + 1, np.uint64)
        np.bitwise_or.at(self.bits, codes >> 6, np.uint64(1) << (codes & 63).astype(np.uint64))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)[:-1]]).astype(np.int32)

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which codes are known, the places of these)."""
        word, bit = codes >> 6, np.uint64(1) << (codes & 63).astype(np.uint64)
        known = np.flatnonzero(self.bits[word] & bit)
        word, bit = word[known], bit[known]
        return known, self.before[word] + np.bitwise_count(self.bits[word] & (bit - np.uint64(1)))


_NO_MODEL = pa.schema([
    ("kind", pa.string()), ("label", pa.string()), ("codes", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())),
    ("digest", pa.binary()), ("value", pa.float64()),
])


class _Model:
    """A block of a model in a task: values in the order of the codes, and those of the group's digests."""

    def __init__(self, rows: list[pa.RecordBatch]):
        kinds = ("idf", "centroid", "digest", "digest centroid")
        rows = rows or [pa.RecordBatch.from_pylist([], schema=_NO_MODEL)]
        of = {k: pa.Table.from_batches([r.filter(pc.equal(r.column("kind"), k)) for r in rows]) for k in kinds}
        codes, idf = (_flat(of["idf"].column(c))[0] for c in ("codes", "values"))
        order = np.argsort(codes)
        self.codes, self.idf = codes[order], idf[order]
        self.places = _Places(self.codes)
        self.digests = _one(of["digest"].column("digest"))
        self.whole = of["digest"].column("value").to_numpy()
        named, marked = of["centroid"], of["digest centroid"]
        self.labels = pc.unique(pa.chunked_array([*named.column("label").chunks, *marked.column("label").chunks], pa.string())).to_pylist()
        self.centroids = []
        for label in self.labels:
            mine, whole = (t.filter(_same(t.column("label"), label)) for t in (named, marked))
            held, over = np.zeros(len(self.codes)), np.zeros(len(self.digests))
            codes, weights = (_flat(mine.column(c))[0] for c in ("codes", "values"))
            known, at = self.places(codes)
            held[at] = weights[known]
            over[pc.index_in(_one(whole.column("digest")), self.digests).to_numpy()] = whole.column("value").to_numpy()
            self.centroids.append((held, over))


def _same(values: pa.ChunkedArray, value: str | None) -> pa.ChunkedArray:
    return pc.is_null(values) if value is None else pc.fill_null(pc.equal(values, value), False)


class _Weights:
    """Packed texts against a block: products of counts and idf that are not 0, and the weights that follow.

    Weights have 8 digits.  The length of a text is its ``norm``, or that of its products where the block is the whole model.
    """

    def __init__(self, model: _Model, packed: pa.RecordBatch):
        codes, lengths = _flat(packed.column("codes"))
        n, _ = _flat(packed.column("n"))
        self.rows = len(packed)
        known, at = model.places(codes)
        raw = n[known] * model.idf[at]
        some = np.flatnonzero(raw)
        self.at, self.raw, self.owner = at[some], raw[some], np.repeat(np.arange(self.rows), lengths)[known[some]]
        found = pc.fill_null(pc.index_in(packed.column("digest"), model.digests), -1).to_numpy()
        self.digest = np.where(found < 0, 0, found)
        self.raw_digest = np.where(found < 0, 0.0, np.append(model.whole, 0.0)[found])
        self.squares = self.sums(self.raw * self.raw) + self.raw_digest * self.raw_digest
        norm = packed.column("norm").to_numpy(zero_copy_only=False) if "norm" in packed.schema.names else np.sqrt(self.squares)
        self.norm = np.where(norm > 0, norm, np.inf)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of each text."""
        # Without any value these are whole numbers.
        return np.bincount(self.owner, weights=values, minlength=self.rows).astype(np.float64)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the codes, and of the digests."""
        return tuple(np.floor(raw / norm * 10**DIGITS + 0.5) / 10**DIGITS for raw, norm in (
            (self.raw, self.norm[self.owner]), (self.raw_digest, self.norm)))


class _Squares:
    def __init__(self, model: _Model):
        self.model = model

    def texts(self, packed: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({ID: packed.column(ID), "square": pa.array(_Weights(self.model, packed).squares)})

    def rest(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, kind))


class _Vectors(_Squares):
    """Codes and weights of each text, and a row with its digest."""

    def __init__(self, model: _Model, names: list[str]):
        super().__init__(model)
        self.names = names

    def texts(self, packed: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = _Weights(self.model, packed)
        weight, over = found.weights()
        ends = np.cumsum(np.bincount(found.owner, minlength=found.rows))
        yield pa.record_batch({
            **{n: packed.column(n) for n in self.names}, "codes": _lists(self.model.codes[found.at], ends, pa.int32()),
            "weights": _lists(weight, ends, pa.float64()), "digest": pa.nulls(found.rows, pa.binary()),
        })
        some = pa.array(np.flatnonzero(found.raw_digest))
        yield pa.record_batch({
            **{n: packed.column(n).take(some) for n in self.names}, "codes": pa.nulls(len(some), pa.list_(pa.int32())),
            "weights": _lists(over[some], np.arange(1, len(some) + 1), pa.float64()), "digest": packed.column("digest").take(some),
        })


# Sums that a task holds before it passes them on: those of so many labels at once.
HELD_SUMS = 1 << 24


class _LabelSums(_Squares):
    """Sums of the weights of each label by code, and the weights of the digests."""

    def __init__(self, model: _Model):
        super().__init__(model)
        self.held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

    def texts(self, packed: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = _Weights(self.model, packed)
        weight, over = found.weights()
        named = packed.column("expected").to_pylist()
        number = {label: k for k, label in enumerate(dict.fromkeys(named))}
        of = np.array([number[label] for label in named], np.int64)[found.owner]
        size = len(self.model.codes)
        for label, k in number.items():
            if label not in self.held:
                if (len(self.held) + 1) * size > HELD_SUMS:
                    yield from self.rest()
                self.held[label] = np.zeros(size), np.zeros(size, bool)
            own = np.flatnonzero(of == k)
            sums, seen = self.held[label]
            np.add.at(sums, found.at[own], weight[own])
            seen[found.at[own]] = True
        some = np.flatnonzero(found.raw_digest)
        yield self.rows([named[k] for k in some], pa.nulls(len(some), pa.int32()), packed.column("digest").take(pa.array(some)), over[some])

    def rest(self) -> Iterator[pa.RecordBatch]:
        for label, (sums, seen) in self.held.items():
            for low in range(0, len(seen), BATCH_CODES):
                at = low + np.flatnonzero(seen[low:low + BATCH_CODES])
                yield self.rows([label] * len(at), pa.array(self.model.codes[at], pa.int32()), pa.nulls(len(at), pa.binary()), sums[at])
        self.held = {}

    @staticmethod
    def rows(labels: list[str | None], codes: pa.Array, digests: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"label": pa.array(labels, pa.string()), "code": codes, "digest": digests, "sum": pa.array(sums, pa.float64())})


class _Dots(_Squares):
    """Products of every text with every label of the model."""

    def texts(self, packed: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = _Weights(self.model, packed)
        weight, over = found.weights()
        for label, (held, whole) in zip(self.model.labels, self.model.centroids, strict=True):
            dot = found.sums(weight * held[found.at])
            if len(whole):
                dot += over * whole[found.digest]
            yield pa.record_batch({ID: packed.column(ID), "label": pa.array([label] * found.rows, pa.string()), "dot": pa.array(dot)})


# --- vectors ------------------------------------------------------------------------------------------
class Weighed:
    """Texts (`texts` or packed counts) with the tokens of a model, for ``labels`` values of each token.

    ``tokens`` is read several times and should be a written table.
    """

    def __init__(self, rows: DataFrame, tokens: DataFrame, labels: int = 1):
        self.rows, self.tokens = rows, tokens
        self.deal = Deal.of(rows, tokens, labels)
        self.id_field = next(f for f in rows.schema.fields if f.name == ID)
        self.keep = [c for c in rows.columns if c not in (ID, "text", "codes", "n", "digest")]
        # A text that is copied everywhere is one row of a group.
        if _is_packed(rows):
            marks = rows.select(self.deal.group(), "digest")
        else:
            marks = parallel(rows.select(self.deal.group(), "text")).mapInArrow(ngram_counts.digests, "group int, digest binary")
        whole = tokens.where("digest IS NOT NULL").select("digest", F.col("idf").alias("value"))
        self.digests = written(marks.distinct().join(whole, "digest").select("group", "digest", "value"))
        if self.deal.blocks > 1:
            squares = self.meet(_Squares, T.StructType([self.id_field, T.StructField("square", T.DoubleType())]))
            norms = written(squares.groupBy(ID).agg(F.sqrt(F.sum("square")).alias("norm")))
            last = [c for c in rows.columns if c not in (ID, *self.keep)]
            self.rows = rows.join(norms, ID).select(ID, *self.keep, "norm", *last)

    def meet(self, work: Callable, schema: T.StructType | str, *more: DataFrame) -> DataFrame:
        idf = self.deal.in_groups(self.deal.in_blocks(self.tokens, "idf", "idf"))
        digests = self.digests.select(F.lit(0).alias("block"), F.lit("digest").alias("kind"), "group", "digest", "value")
        model = idf.unionByName(digests, allowMissingColumns=True)
        for table in more:
            model = model.unionByName(table, allowMissingColumns=True)
        return self.deal.meet(model, self.rows, work, schema)

    def vectors(self) -> DataFrame:
        """``record_id``, kept columns, ``codes`` and ``weights`` by block of tokens; a row with the ``digest`` has its weight alone."""
        kept = [f for f in self.rows.schema.fields if f.name in (ID, *self.keep)]
        arrays = [T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))]
        names = [f.name for f in kept]
        return self.meet(lambda model: _Vectors(model, names), T.StructType([*kept, *arrays, T.StructField("digest", T.BinaryType())]))


# --- model ----------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class TextModel:
    """``tokens``: code or digest, df, idf.  ``centroids``: label, code or digest, weight.  ``labels``: label, examples_count."""

    tokens: DataFrame
    centroids: DataFrame
    labels: DataFrame

    def save(self, folder: str) -> None:
        for name in ("tokens", "centroids", "labels"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> TextModel:
        return cls(*(spark.read.parquet(f"{folder}/{name}") for name in ("tokens", "centroids", "labels")))


def train(records: DataFrame, rows: DataFrame) -> TextModel:
    """A centroid for each label of ``records`` (``record_id, expected``); ``rows`` are their texts with ``expected`` kept.

    The mean of a label's vectors, brought to length 1, each weight to 8 digits.
    """
    labels = written(records.groupBy(F.col("expected").alias("label")).agg(F.count("*").alias("examples_count")))
    tokens = written(document_frequency(rows, records.count()))
    found = Weighed(rows, tokens).meet(_LabelSums, "label string, code int, digest binary, sum double")
    sums = found.groupBy("label", "code", "digest").agg(F.sum("sum").alias("sum"))
    means = written(sums.join(labels, "label").select("label", "code", "digest", (F.col("sum") / F.col("examples_count")).alias("mean")))
    lengths = means.groupBy("label").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("length"))
    weight = F.round(F.col("mean") / F.col("length"), DIGITS).alias("weight")
    return TextModel(tokens, written(means.join(lengths, "label").select("label", "code", "digest", weight)), labels)


def predict(records: DataFrame, rows: DataFrame, model: TextModel, top_k: int, *keep: str) -> DataFrame:
    """The ``top_k`` labels of every record by cosine, ties by label: (record_id, kept columns, rank, label, score).

    A label that shares no token with a record scores 0.
    """
    weighed = Weighed(rows, model.tokens, model.labels.count())
    grams = weighed.deal.in_groups(weighed.deal.in_blocks(model.centroids, "centroid", "weight", "label"))
    whole = weighed.digests.drop("value").join(model.centroids.where("digest IS NOT NULL").drop("code"), "digest").select(
        F.lit(0).alias("block"), F.lit("digest centroid").alias("kind"), "group", "digest", "label", F.col("weight").alias("value")
    )
    schema = T.StructType([weighed.id_field, T.StructField("label", T.StringType()), T.StructField("dot", T.DoubleType())])
    dots = weighed.meet(_Dots, schema, grams, whole)
    scores = dots.groupBy(ID, "label").agg(F.round(F.sum("dot"), 6).alias("score"))
    # Labels are the classes of the model: one short list.
    every = records.select(ID, *keep).crossJoin(F.broadcast(model.labels.select("label")))
    found = every.join(scores, [ID, "label"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = Window.partitionBy(ID).orderBy(F.desc("score"), "label")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return ranked.select(ID, *keep, "rank", "label", "score")
