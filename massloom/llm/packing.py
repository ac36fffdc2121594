"""Packing tokenised documents into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.tokens import ByteBpe, encoder, let_go

#: Windows that a task holds open at most before it closes them by cutting; the rule alone keeps some hundreds open.
MAX_OPEN = 4096
_FLUSH = 2048


class SumOfSquares:
    """Online packing of pieces into windows of ``capacity``.

    ``count[h]`` is the number of open windows filled to level h. A piece of size s goes to the level (0: a new window)
    for which the sum of count[h]^2 over partial levels is smallest afterwards: going from h to h + s changes the sum
    by (2 count[h+s] + 1) - (2 count[h] - 1), without the first term when the window becomes full and without the
    second for a new one.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.enter = np.ones(capacity + 1, np.int64)
        self.enter[capacity] = 0
        self.leave = np.full(capacity + 1, -(1 << 60), np.int64)
        self.leave[0] = 0
        self.open: dict[int, list[list]] = defaultdict(list)
        self.n_open = 0

    def _shift(self, level: int, by: int) -> None:
        if 0 < level < self.capacity:
            n = self.count[level] = self.count[level] + by
            self.enter[level] = 2 * n + 1
            self.leave[level] = 2 * n - 1 if n else -(1 << 60)
            self.n_open += by

    def place(self, piece, size: int) -> list | None:
        """Put a piece of 1..capacity into a window; the window's pieces if that fills it."""
        level = int(np.argmin(self.enter[size:] - self.leave[: self.capacity - size + 1]))
        window = self.open[level].pop() if level else []
        window.append(piece)
        self._shift(level, -1)
        if level + size == self.capacity:
            return window
        self._shift(level + size, 1)
        self.open[level + size].append(window)
        return None

    def drain(self) -> Iterator[tuple[int, list]]:
        """All open windows, fullest first, which are then forgotten."""
        for level in sorted(self.open, reverse=True):
            for window in self.open[level]:
                yield level, window
        self.__init__(self.capacity)


def _merged(windows: list[tuple[int, list]], capacity: int, cut) -> Iterator[list]:
    """Fill the fullest windows with pieces of the emptiest, cut where need be; all but the last become full."""
    left, right = 0, len(windows) - 1
    while left < right:
        level, window = windows[left]
        while level < capacity and left < right:
            other_level, other = windows[right]
            piece = other.pop()
            size = piece[2]
            if size > capacity - level:
                head, piece = cut(piece, capacity - level)
                other.append(piece)
                piece = head
            window.append(piece)
            level += piece[2]
            windows[right] = (other_level - piece[2], other)
            if not other:
                right -= 1
        windows[left] = (level, window)
        if level == capacity:
            yield window
            left += 1
    if left == right:
        yield windows[left][1]


def _cut(piece, at: int):
    doc, start, size, ids, total = piece
    return (doc, start, at, ids[: 4 * at], total), (doc, start + at, size - at, ids[4 * at :], total)


def pack(docs: DataFrame, tokenizer: str, ranks: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, max_open: int = MAX_OPEN) -> DataFrame:
    """Pack every document's token ids into windows of at most ``capacity``.

    One row per piece: the id column, ``start`` (ids of the document before it), ``ids`` (binary, little-endian unsigned
    32-bit), ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` (place in the window, gapless from 0) and
    ``filled`` (whether the window was closed by cutting, not completed by the rule or by a document of its own).
    Each input partition packs its own stream, so nothing is shuffled; ``sequence_id`` is unique over partitions. A
    document longer than a window is cut into full windows and a rest; rests are placed online by ``SumOfSquares``.
    When a partition ends, or holds ``max_open`` partial windows, pieces of the emptiest windows are cut to fill the
    fullest, so that one padded window remains.

    Null and empty texts: the end id alone. A null id: kept as null. Repeated rows: packed once each. Empty table: no
    rows. Extra columns are ignored, whatever their names.
    """
    fields = [docs.schema[id_col].dataType, T.LongType(), T.BinaryType(), T.LongType(), T.LongType(), T.LongType(), T.BooleanType()]
    names = [id_col, "start", "ids", "doc_tokens", "sequence_id", "offset", "filled"]
    schema = T.StructType([T.StructField(n, f) for n, f in zip(names, fields, strict=True)])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(encoders=False)
        encode = encoder(ByteBpe, tokenizer, ranks)
        first = TaskContext.get().partitionId() << 40
        packing, rows, made, id_type = SumOfSquares(capacity), [], 0, pa.int64()

        def emit(window: list, filled: bool = False) -> None:
            nonlocal made
            at = 0
            for doc, start, size, ids, total in window:
                rows.append((doc, start, ids, total, first + made, at, filled))
                at += size
            made += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 7
            rows.clear()
            kinds = [id_type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            id_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                whole = total // capacity * capacity
                for start in range(0, whole, capacity):
                    emit([(doc, start, capacity, ids[4 * start : 4 * (start + capacity)], total)])
                if whole < total:
                    full = packing.place((doc, whole, total - whole, ids[4 * whole :], total), total - whole)
                    if full:
                        emit(full)
                    if packing.n_open >= max_open:
                        *full, rest = _merged(list(packing.drain()), capacity, _cut)
                        for window in full:
                            emit(window, filled=True)
                        for piece in rest:
                            if (window := packing.place(piece, piece[2])) is not None:
                                emit(window)
                if len(rows) >= _FLUSH:
                    yield flush()
        for window in _merged(list(packing.drain()), capacity, _cut):
            emit(window, filled=True)
            if len(rows) >= _FLUSH:
                yield flush()
        if rows:
            yield flush()

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
