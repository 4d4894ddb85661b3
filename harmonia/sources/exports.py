"""Exports in, bronze tables out.

A source is one CSV or Parquet export.  Every cell is text; a missing cell is
the empty text.  Landing writes each source once as Parquet with the position
of its rows, so every later step scans columns of Parquet instead of parsing
text again, and row ordinals stay the same however often they are read.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harmonia.sources.csv_records import join_pieces, read_records

DELIMITERS = (",", ";", "\t", "|")
SHEET_SEPARATOR = "#"
# Bytes that Windows-1252 leaves undefined; a file that holds one is Latin-1.
UNDEFINED_1252 = "81|8D|8F|90|9D"


# --- references ---------------------------------------------------------------------------
def format_source_ref(file: str, sheet: str | None = None) -> str:
    return f"{file}{SHEET_SEPARATOR}{sheet}" if sheet else file


def split_source_ref(source_ref: str) -> tuple[str, str | None]:
    file, separator, sheet = source_ref.partition(SHEET_SEPARATOR)
    return file, sheet if separator else None


# --- tables of sources -------------------------------------------------------------------------
@dataclass(frozen=True)
class SourceTable:
    """A source as text columns ``c_0 … c_n`` plus its 1-based row ``ordinal``.

    Header names are kept beside the data: they may repeat, differ only in case
    or hold any character, which column names in Spark may not.
    """

    source_ref: str
    columns: tuple[str, ...]
    df: DataFrame
    format: str = "csv"
    sheet: str | None = None

    def cell(self, name: str | None) -> Column:
        """Text of a column; the empty text where the source has no such column."""
        if name is None or name not in self.columns:
            return F.lit("")
        return F.col(f"c_{self.columns.index(name)}")

    @classmethod
    def from_dataframe(cls, source_ref: str, df: DataFrame, ordinal: Column, format: str = "table") -> SourceTable:
        """Read any DataFrame as a source; ``ordinal`` must order its rows uniquely."""
        cells = [cell_text(df.schema[name].dataType, F.col(f"`{name}`")).alias(f"c_{i}") for i, name in enumerate(df.columns)]
        return cls(source_ref, tuple(df.columns), df.select(ordinal.cast("bigint").alias("ordinal"), *cells), format)


def cell_text(data_type: T.DataType, cell: Column) -> Column:
    """Text of a typed cell; a timestamp at midnight is written as its date."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        midnight = F.date_trunc("day", cell) == cell
        has_micros = F.date_format(cell, "SSSSSS") != "000000"
        text = (
            F.when(midnight, F.date_format(cell, "yyyy-MM-dd"))
            .when(has_micros, F.date_format(cell, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
            .otherwise(F.date_format(cell, "yyyy-MM-dd'T'HH:mm:ss"))
        )
    elif isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(cell)
    else:
        text = cell.cast("string")
    return F.coalesce(text, F.lit(""))


# --- listing -----------------------------------------------------------------------------------
def list_sources(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(source_ref, format) of the CSV and Parquet exports in a folder, by name; either may be a folder of part files."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    found = []
    for status in files:
        name = status.getPath().getName()
        if name.startswith(("~$", ".", "_")):
            continue
        if name.lower().endswith(".csv"):
            found.append((name, "csv"))
        elif name.lower().endswith(".parquet"):
            found.append((name, "parquet"))
    return sorted(found)


# --- CSV -----------------------------------------------------------------------------------------
Range = tuple[int, int]


def _traits(lines: DataFrame) -> tuple[str, bool, dict[str, Range]]:
    """Encoding, whether quotes may join lines, and how often each delimiter stands on a line.

    One distributed pass over all bytes.  Delimiters count outside quotes, at
    least and at most, over the lines whose quotes are even.  A line is plain if
    all its quotes belong to cells that are quoted from end to end.
    """
    raw = F.col("value").cast("binary")
    even = F.pmod(F.length(F.regexp_replace("value", '[^"]', "")), F.lit(2)) == 0
    bare = F.when(even & (F.col("value") != ""), F.regexp_replace("value", '"[^"]*"', ""))
    counts = [F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))) for d in DELIMITERS]
    plain = ~F.regexp_replace("value", r'(?<![^,;\t|])"(?:[^"]|"")*+"(?![^,;\t|])', "").contains('"')
    row = lines.agg(
        F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"),
        F.coalesce(F.bool_or(F.hex(raw).rlike(f"^(..)*({UNDEFINED_1252})")), F.lit(False)).alias("undefined"),
        F.coalesce(F.bool_or(~plain), F.lit(False)).alias("joined"),
        *[f(n).alias(f"{name}_{i}") for i, n in enumerate(counts) for name, f in (("least", F.min), ("most", F.max))],
    ).first()
    encoding = "utf-8" if row["utf8"] else "latin-1" if row["undefined"] else "cp1252"
    ranges = {d: (row[f"least_{i}"], row[f"most_{i}"]) for i, d in enumerate(DELIMITERS) if row[f"least_{i}"] is not None}
    return encoding, row["joined"], ranges


def pick_delimiter(ranges: dict[str, Range], header: str) -> str:
    """The delimiter found equally often, and most often, on every line; else the header's most frequent one."""
    best, best_count = ",", 0
    for delimiter, (least, most) in ranges.items():
        if least == most and least > best_count:
            best, best_count = delimiter, least
    if best_count == 0 and any(d in header for d in DELIMITERS):
        best = max(DELIMITERS, key=header.count)
    return best


def choose_delimiter(lines: list[str]) -> str:
    """`pick_delimiter` for lines at hand."""
    ranges = {}
    for delimiter in DELIMITERS if lines else ():
        counts = [len(next(csv.reader([line], delimiter=delimiter), [])) - 1 for line in lines]
        ranges[delimiter] = (min(counts), max(counts))
    return pick_delimiter(ranges, lines[0] if lines else "")


def _decode_1252(cell: Column) -> Column:
    """Windows-1252 text that was read as Latin-1: only the range 0x80-0x9F differs."""
    codes = [c for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore")]
    return F.translate(cell, "".join(map(chr, codes)), bytes(codes).decode("cp1252"))


HEADER_LINES = 64


@dataclass(frozen=True)
class CsvDialect:
    """What the lines of a file have shown: names, delimiter, encoding, and whether records may span lines."""

    header: tuple[str, ...]
    delimiter: str
    encoding: str
    joined: bool

    @property
    def names(self) -> tuple[str, ...]:
        """A repeated header keeps its first place and its last value."""
        return tuple(dict.fromkeys(self.header))

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f"h_{i}", T.StringType()) for i in range(len(self.header))])

    def cells(self, prefix: str = "") -> list[Column]:
        last = {name: i for i, name in enumerate(self.header)}
        return [F.coalesce(F.col(f"{prefix}h_{last[name]}"), F.lit("")).alias(f"c_{i}") for i, name in enumerate(self.names)]


def csv_dialect(lines: DataFrame) -> CsvDialect | None:
    encoding, joined, ranges = _traits(lines)
    first = lines.where(F.col("value") != "").select(F.col("value").cast("binary")).head(HEADER_LINES)
    if not first:
        return None
    head = [bytes(row[0]).decode("utf-8-sig" if encoding == "utf-8" else encoding, "replace") for row in first]
    delimiter = pick_delimiter(ranges, head[0])
    header = next(csv.reader([f"{line}\n" for line in head], delimiter=delimiter))
    return CsvDialect(tuple(header), delimiter, encoding, joined)


def read_csv_source(spark: SparkSession, path: str, dialect: CsvDialect) -> DataFrame:
    """The raw rows; ``_block`` and ``_position`` give their place in ``_file``.

    Files whose quotes close on their line are read as Spark reads them.  Of the
    others the lines are joined first, split by split; ``_piece`` is set on rows
    that are a piece of a record over a border, whose text is in ``_record``.
    """
    if dialect.joined:
        place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
        lines = spark.read.text(path).select(*place, F.col("value").cast("binary").alias("line"))
        return _parsed(read_records(lines, dialect.delimiter, dialect.encoding), dialect)
    raw = spark.read.csv(
        path, schema=dialect.schema, header=True, sep=dialect.delimiter, quote='"', escape='"', enforceSchema=True,
        encoding="UTF-8" if dialect.encoding == "utf-8" else "ISO-8859-1",
    )
    cells = dialect.cells()
    if dialect.encoding == "cp1252":
        cells = [_decode_1252(cell).alias(f"c_{i}") for i, cell in enumerate(cells)]
    return raw.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_position"),
        *cells,
    )


def _parsed(records: DataFrame, dialect: CsvDialect) -> DataFrame:
    whole = F.when(F.col("piece").isNull(), F.col("record"))
    cells = F.from_csv(whole, dialect.schema.simpleString()[len("struct<"):-1].replace(":", " "), {"sep": dialect.delimiter, "quote": '"', "escape": '"'})
    return records.withColumn("cells", cells).select(
        F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("position").alias("_position"), F.col("piece").alias("_piece"),
        F.when(F.col("piece").isNotNull(), F.col("record")).alias("_record"), *dialect.cells("cells."),
    )


def land_csv(spark: SparkSession, path: str, target: str) -> tuple[str, ...]:
    """Writes the rows of a CSV export to ``target`` and returns its column names."""
    dialect = csv_dialect(spark.read.text(path))
    if dialect is None:
        spark.createDataFrame([], "_file string, _block bigint, _position bigint").write.mode("overwrite").parquet(target)
        return ()
    read_csv_source(spark, path, dialect).write.mode("overwrite").parquet(target)
    if dialect.joined:
        # Pieces of records over borders: two a split at most, added as whole rows.
        pieces = spark.read.parquet(target).where("_piece IS NOT NULL").select(
            F.col("_file").alias("file"), F.col("_block").alias("block"), F.col("_position").alias("position"),
            F.col("_piece").alias("piece"), F.col("_record").alias("record"),
        )
        joined = join_pieces(pieces).withColumn("piece", F.lit(None).cast("bigint"))
        _parsed(joined, dialect).write.mode("append").parquet(target)
    return dialect.names


def read_parquet_source(spark: SparkSession, path: str) -> tuple[tuple[str, ...], DataFrame]:
    df = spark.read.parquet(path)
    cells = [cell_text(df.schema[n].dataType, F.col(f"`{n}`")).alias(f"c_{i}") for i, n in enumerate(df.columns)]
    return tuple(df.columns), df.select(
        F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("bigint").alias("_block"),
        F.col("_metadata.row_index").alias("_position"), *cells,
    )


# --- bronze ------------------------------------------------------------------------------------------
CATALOGUE_SCHEMA = "source_ref string, format string, sheet string, columns array<string>, position int"


def whole_rows(spark: SparkSession, path: str) -> DataFrame:
    """Landed rows without the pieces that were joined to other rows."""
    rows = spark.read.parquet(path)
    return rows.where("_piece IS NULL") if "_piece" in rows.columns else rows


@dataclass(frozen=True)
class Bronze:
    """Landed sources of one folder."""

    spark: SparkSession
    folder: str

    @classmethod
    def land(cls, spark: SparkSession, exports_dir: str, folder: str) -> Bronze:
        """Write every export of ``exports_dir`` as Parquet under ``folder``."""
        catalogue = []
        for position, (source_ref, format) in enumerate(list_sources(spark, exports_dir)):
            path = f"{exports_dir}/{source_ref}"
            target = f"{folder}/{source_ref}"
            if format == "csv":
                names = land_csv(spark, path, f"{target}/rows")
            else:
                names, rows = read_parquet_source(spark, path)
                rows.write.mode("overwrite").parquet(f"{target}/rows")
            # Rows before each file split, from the landed rows: one line per split.
            blocks = (
                whole_rows(spark, f"{target}/rows")
                .groupBy("_file", "_block")
                .agg(F.min("_position").alias("_first"), F.count("*").alias("_rows"))
            )
            before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
            blocks.select(
                "_file", "_block",
                (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
            ).coalesce(1).write.mode("overwrite").parquet(f"{target}/blocks")
            catalogue.append((source_ref, format, None, list(names), position))
        spark.createDataFrame(catalogue, CATALOGUE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
            f"{folder}/_catalogue"
        )
        return cls(spark, folder)

    def sources(self) -> dict[str, SourceTable]:
        """Landed sources by reference, in listing order."""
        rows = self.spark.read.parquet(f"{self.folder}/_catalogue").orderBy("position").collect()
        return {row["source_ref"]: self._table(row) for row in rows}

    def read(self, source_ref: str) -> SourceTable:
        file, _ = split_source_ref(source_ref)
        row = self.spark.read.parquet(f"{self.folder}/_catalogue").where(F.col("source_ref") == source_ref).first()
        if row is None:
            if not file.lower().endswith((".csv", ".parquet")):
                raise ValueError(f"unsupported export format: {source_ref}")
            raise ValueError(f"unknown source: {source_ref}")
        return self._table(row)

    def _table(self, row: T.Row) -> SourceTable:
        target = f"{self.folder}/{row['source_ref']}"
        rows = whole_rows(self.spark, f"{target}/rows")
        # One row per file split; Spark broadcasts it when it measures it as small.
        blocks = self.spark.read.parquet(f"{target}/blocks")
        cells = [f"c_{i}" for i in range(len(row["columns"]))]
        df = rows.join(blocks, ["_file", "_block"]).select(
            (F.col("_position") + F.col("_shift")).alias("ordinal"), *cells
        )
        return SourceTable(row["source_ref"], tuple(row["columns"]), df, row["format"], row["sheet"])
