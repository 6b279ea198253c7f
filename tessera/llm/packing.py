"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task packs the documents it reads, in a stream and without a shuffle. A document's
ids fill whole windows first; what is left over, shorter than a window, goes to the fill
level that minimises the sum of squared counts of partially filled windows (level 0: a
new window), kept in a level array. A window's pieces wait until it is full. Where too many
windows stay open, and at the end of the task, the open windows' pieces are cut anew into full windows, and
the last tail is cut at powers of two, which need no padding.

Defined results: null or empty text is a document of the end id alone; a null doc_id is kept;
repeated rows are packed as often as they stand; other columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches
from tessera.llm.tokens import MOST_CHARS, REMEMBERED

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
WINDOW = 2048
#: Windows that a task holds open at once (8 KB each).
MOST_OPEN = 2048


class Packer:
    """Places pieces; ``rows`` takes finished windows as lists of SCHEMA's tuples."""

    def __init__(self, first_sequence: int, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open = window, most_open
        self.levels = np.zeros(window + 1, np.int64)  # counts of partially filled windows by fill
        self.open: dict[int, list[list[tuple]]] = defaultdict(list)
        self.n_open = 0
        self.sequence = first_sequence
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at, total = 0, sum(len(p[2]) // 4 for p in pieces)
        for doc_id, start, ids, doc_tokens in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, self.sequence, at, total))
            at += n
        self.sequence += 1

    def best_level(self, n: int) -> int:
        """The level to put n ids on, fewer than a window: that of the least growth of the sum of squares (less 2 here); of equal ones the fullest."""
        counts = self.levels
        growth = 2 * (counts[n : self.window + 1] - counts[: self.window + 1 - n])
        growth[-1] -= 1  # a full window is counted no more
        growth[0] = 2 * counts[n] - 1  # a new window leaves no level
        used = counts[: self.window + 1 - n] > 0
        used[0] = True
        growth = np.where(used, growth, np.iinfo(np.int64).max)
        return int(len(growth) - 1 - np.argmin(growth[::-1]))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.window
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self._close([(doc_id, at // 4, ids[at : at + step], total)])
        if whole == len(ids):
            return
        rest = ids[whole:]
        level = self.best_level(len(rest) // 4)
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append((doc_id, whole // 4, rest, total))
        level += len(rest) // 4
        if level == self.window:
            self._close(pieces)
            return
        self.open[level].append(pieces)
        self.levels[level] += 1
        self.n_open += 1
        if self.n_open > self.most_open:
            self.recut(last=False)

    def recut(self, last: bool) -> None:
        """Cuts the open windows' pieces into full windows; the tail stays open, or at the last is cut at powers of two."""
        pieces = [p for level in sorted(self.open, reverse=True) for group in self.open[level] for p in group]
        self.open.clear()
        self.levels[:] = 0
        self.n_open = 0
        left = sum(len(p[2]) for p in pieces) // 4
        size = self.window if left >= self.window or not last else _power(left)
        group, room = [], size
        for doc_id, start, ids, doc_tokens in pieces:
            at, n = 0, len(ids) // 4
            while at < n:
                take = min(room, n - at)
                group.append((doc_id, start + at, ids[4 * at : 4 * (at + take)], doc_tokens))
                at, room, left = at + take, room - take, left - take
                if not room:
                    self._close(group)
                    group = []
                    room = size = self.window if left >= self.window or not last else _power(left)
        if group:
            fill = size - room
            self.open[fill].append(group)
            self.levels[fill] += 1
            self.n_open = 1

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _power(n: int) -> int:
    """The largest power of two up to n; 0 for 0."""
    return 1 << n.bit_length() - 1 if n else 0


def pack(documents: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW, most_open: int = MOST_OPEN, remembered: int = REMEMBERED, most_chars: int = MOST_CHARS) -> DataFrame:
    """Rows of SCHEMA, one for each piece; sequence_tokens is the sequence's length before padding. A worker remembers ``remembered`` chunks and encodes
    about ``most_chars`` characters at a time: fewer take less memory and more time, and give the same rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from tessera.llm.tokens import encoder, in_groups

        packer, end = Packer(TaskContext.get().partitionId() << 40, window, most_open), np.array([end_id], "<u4").tobytes()
        kinds = [pa.int64()] * 8
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def out(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in in_groups(batch.column(1).to_pylist(), most_chars):
                for doc_id, encoded in zip(ids[at : at + len(texts)], encoder(tokenizer_path, remembered).encode(texts), strict=True):
                    packer.add(doc_id, encoded + end)
                if rows := packer.taken():
                    yield out(rows)
        packer.recut(last=True)
        if rows := packer.taken():
            yield out(rows)

    bounded_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
