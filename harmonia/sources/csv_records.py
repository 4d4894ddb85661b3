"""Records of CSV files whose quoted cells hold line breaks, without giving up their splits.

A line alone does not tell whether it begins inside a quoted cell.  Each file
split is therefore read twice: first to learn where it ends if it begins
outside a cell and where if inside, which makes a split a function of two
states; these functions are chained along each file, so that the second reading
knows the state every split begins in.  It joins the lines of its own records;
only the record that crosses a border is put together from pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of the longest record that is joined over lines: a quote that nothing closes is an error, not one huge cell.
RECORD_LIMIT = 16 << 20

_OUTCOMES = "file string, block long, end_outside boolean, tail_outside long, end_inside boolean, head_inside long, tail_inside long"
_RECORDS = "file string, block long, position long, piece long, record string"


def ends_inside(line: bytes, inside: bool, delimiter: bytes) -> bool:
    """Whether the next line begins inside a quoted cell, given whether this one does.

    A quote opens a cell only at the cell's beginning; elsewhere it is text.  In
    a quoted cell two quotes are one, and after the closing quote the cell goes
    on as text up to the delimiter.
    """
    at, opening = 0, delimiter + b'"'
    if not inside:
        if line[:1] == b'"':
            at, inside = 1, True
        else:
            at = line.find(opening)
            if at < 0:
                return False
            at, inside = at + 2, True
    while True:
        close = line.find(b'"', at)
        if close < 0:
            return True
        if line[close + 1:close + 2] == b'"':
            at = close + 2
            continue
        at = line.find(opening, close + 1)
        if at < 0:
            return False
        at += 2


def _splits(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """(file and block, first row, end row) of the splits in a batch."""
    keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    low = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[low]:
            yield keys[low], low, k
            low = k


@dataclass
class _Path:
    """A split read from one state: where it is now, the bytes of the record open there, and those up to the first closed one."""

    inside: bool
    tail: int = 0
    head: int | None = None

    def pass_over(self, size: int) -> None:
        """Lines without quotes."""
        if self.inside:
            self.tail += size

    def read(self, line: bytes, delimiter: bytes) -> None:
        before, self.inside = self.inside, ends_inside(line, self.inside, delimiter)
        if self.inside or before:
            self.tail += len(line) + 1
        if not self.inside:
            if before and self.head is None:
                self.head = self.tail
            self.tail = 0


def _outcomes(delimiter: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a split: its end from either state, and the bytes of the records that cross its borders."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, outside, inside = None, _Path(False), _Path(True)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{
                "file": now[0], "block": now[1], "end_outside": outside.inside, "tail_outside": outside.tail,
                "end_inside": inside.inside, "head_inside": inside.head, "tail_inside": inside.tail,
            }], pa.schema([
                ("file", pa.string()), ("block", pa.int64()), ("end_outside", pa.bool_()), ("tail_outside", pa.int64()),
                ("end_inside", pa.bool_()), ("head_inside", pa.int64()), ("tail_inside", pa.int64()),
            ]))

        for batch in batches:
            lines = batch.column(2)
            size = pc.binary_length(lines).to_numpy(zero_copy_only=False) + 1
            before = np.concatenate([[0], np.cumsum(size)])
            quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
            for split, low, high in _splits(batch):
                if split != now:
                    if now is not None:
                        yield row()
                    now, outside, inside = split, _Path(False), _Path(True)
                done = low
                for k in quoted[np.searchsorted(quoted, low):np.searchsorted(quoted, high)].tolist():
                    line = lines[k].as_py()
                    for path in (outside, inside):
                        path.pass_over(int(before[k] - before[done]))
                        path.read(line, delimiter)
                    done = k + 1
                for path in (outside, inside):
                    path.pass_over(int(before[high] - before[done]))
        if now is not None:
            yield row()

    return scan


# Whether a split begins inside a cell, and the split that the record open there begins in.
Starts = dict[tuple[str, int], tuple[bool, int]]


def _starts(lines: DataFrame, delimiter: bytes, limit: int) -> Starts:
    """State of every split.  One row a split comes to the driver, which keeps the list of splits in any case."""
    starts: Starts = {}
    file, inside, owner, length = None, False, 0, 0

    def check(size: int, closed: bool) -> None:
        if size > limit:
            raise ValueError(f"{file}: a record with a quoted cell is longer than {limit} bytes")
        if not closed:
            raise ValueError(f"{file}: a quoted cell is not closed at the end of the file")

    for row in lines.mapInArrow(_outcomes(delimiter), _OUTCOMES).orderBy("file", "block").collect():
        if row["file"] != file:
            check(0, not inside)
            file, inside, owner, length = row["file"], False, row["block"], 0
        starts[file, row["block"]] = (inside, owner if inside else row["block"])
        if inside and row["head_inside"] is None:
            length += row["tail_inside"]
        else:
            check(length + row["head_inside"] if inside else 0, True)
            owner, length = row["block"], row["tail_inside"] if inside else row["tail_outside"]
        check(length, True)
        inside = row["end_inside"] if inside else row["end_outside"]
    check(0, not inside)
    return starts


def _assembler(starts: Starts, delimiter: bytes, encoding: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole records, and the pieces of those that cross a border.

    A whole record has the split and position that it begins at.  A piece has
    the split of its record, its own split as ``piece``, and a position only
    where the record begins.  Blank lines between records, and the first record
    of a file, its header, are left out.
    """

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, owner, position = None, False, 0, 0
        held: list[bytes] = []
        out: tuple[list, ...] = ([], [], [], [], [])

        def put(block: int, place: int | None, piece: int | None, record: bytes) -> None:
            # Position -1 is the header.
            if place != -1:
                for column, value in zip(out, (now[0], block, place, piece, record.decode(encoding)), strict=True):
                    column.append(value)

        def put_open() -> None:
            if held:
                put(owner, position if owner == now[1] else None, now[1], b"\n".join(held))

        def emitted() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            names = ["file", "block", "position", "piece", "record"]
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            quoted = pc.match_substring(batch.column(2), '"').to_numpy(zero_copy_only=False).tolist()
            lines = batch.column(2).to_pylist()
            for split, low, high in _splits(batch):
                if split != now:
                    if now is not None:
                        put_open()
                    now, held = split, []
                    inside, owner = starts[split]
                    position = -1 if split[1] == 0 else 0
                for line, has_quote in zip(lines[low:high], quoted[low:high], strict=True):
                    before = inside
                    if has_quote:
                        inside = ends_inside(line, before, delimiter)
                    if before or inside:
                        held.append(line)
                        if inside:
                            continue
                        record, held = b"\n".join(held), []
                        if owner != now[1]:
                            put(owner, None, now[1], record)
                            owner = now[1]
                            continue
                    elif line.strip():
                        record = line
                    else:
                        continue
                    put(now[1], position, None, record)
                    position += 1
                if sum(map(len, held)) > limit:
                    raise ValueError(f"{now[0]}: a record with a quoted cell is longer than {limit} bytes")
            yield emitted()
        if now is not None:
            put_open()
        yield emitted()

    return assemble


def read_records(lines: DataFrame, delimiter: str, encoding: str, limit: int = RECORD_LIMIT) -> DataFrame:
    """``file, block, position, piece, record`` of the files in ``lines`` (``file, block, line``).

    Lines are bytes and in file order within each split.  Rows with a NULL
    ``piece`` are whole records; :func:`join_pieces` makes records of the others.
    """
    mark = delimiter.encode()
    return lines.mapInArrow(_assembler(_starts(lines, mark, limit), mark, encoding, limit), _RECORDS)


def join_pieces(pieces: DataFrame) -> DataFrame:
    """The records that cross borders, from their pieces: at most one begins in a split."""
    in_order = F.array_sort(F.collect_list(F.struct("piece", "record")))
    return pieces.groupBy("file", "block").agg(
        F.max("position").alias("position"), F.array_join(F.transform(in_order, lambda p: p["record"]), "\n").alias("record")
    ).where("position IS NOT NULL")
