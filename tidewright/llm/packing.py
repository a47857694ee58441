"""Packing token ids into fixed windows by sum-of-squares online packing.

Each partition of the input packs its own documents. A document's full windows leave at once; its
rest is placed at the fill level that makes the sum of squared counts of partly filled windows least,
read off a level array. When the input ends, the least filled window is emptied and its pieces are
placed again by the same rule, among the others alone, until one is left; that one is cut into
sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import small_batches, table, tidy
from tidewright.llm.tokens import chunks, encoder

SIZE = 2048
#: Windows that may stay open at once: 32 MB of ids at most. Beyond that a rest goes to the best open one, cut if it fits in none.
MAX_OPEN = 4096
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class SumOfSquares:
    """Packs pieces (doc, start, bytes, doc_tokens) into windows of ``size`` ids; yields finished windows."""

    def __init__(self, size: int = SIZE, max_open: int = MAX_OPEN):
        self.size, self.max_open, self.open = size, max_open, 0
        self.levels = np.zeros(size + 1, dtype=np.int64)  # partly filled windows at each fill level
        self.windows: dict[int, list[list]] = defaultdict(list)

    def level_for(self, n: int, may_open: bool = True) -> int:
        """The fill level for ``n`` ids; 0 for a new window, -1 if none fits and none may be opened."""
        at = np.flatnonzero(self.levels[1 : self.size - n + 1]) + 1
        best, cost = -1, None
        if len(at):
            to = at + n
            delta = np.where(to < self.size, 2 * self.levels[to] + 2, 1) - 2 * self.levels[at]
            k = len(at) - 1 - int(np.argmin(delta[::-1]))  # of equal ones the fullest
            best, cost = int(at[k]), int(delta[k])
        if not self.open or may_open and self.open < self.max_open and (cost is None or 2 * self.levels[n] + 1 < cost):
            return 0
        return best

    def _put(self, level: int, piece: tuple, n: int) -> Iterator[list]:
        if level:
            window = self.windows[level].pop()
            self.levels[level] -= 1
            self.open -= 1
        else:
            window = []
        window.append(piece)
        if level + n == self.size:
            yield window
        else:
            self.windows[level + n].append(window)
            self.levels[level + n] += 1
            self.open += 1

    def _place(self, doc, start: int, ids: bytes, total: int, may_open: bool) -> Iterator[list]:
        """Place fewer ids than a window holds; where they fit in none, the fullest window is filled and the rest placed."""
        while ids:
            n = len(ids) // 4
            level = self.level_for(n, may_open)
            if level < 0:
                level = int(np.flatnonzero(self.levels)[-1])
                n = self.size - level
            yield from self._put(level, (doc, start, ids[: 4 * n], total), n)
            start, ids = start + n, ids[4 * n :]

    def add(self, doc, ids: bytes) -> Iterator[list]:
        total = len(ids) // 4
        start = 0
        while total - start >= self.size:
            yield [(doc, start, ids[4 * start : 4 * (start + self.size)], total)]
            start += self.size
        yield from self._place(doc, start, ids[4 * start :], total, True)

    def close(self) -> Iterator[list]:
        """Empty the least filled window into the others until one is left; cut that one into powers of two."""
        while self.open > 1:
            level = int(np.flatnonzero(self.levels)[0])
            self.levels[level] -= 1
            self.open -= 1
            for doc, start, ids, total in self.windows[level].pop():
                yield from self._place(doc, start, ids, total, False)
        rest = [p for ws in self.windows.values() for w in ws for p in w][::-1]
        left = sum(len(p[2]) for p in rest) // 4
        while left:
            goal = 1 << (left.bit_length() - 1)
            window, n = [], 0
            while n < goal:
                doc, start, ids, total = rest.pop()
                k = min(len(ids) // 4, goal - n)
                window.append((doc, start, ids[: 4 * k], total))
                if 4 * k < len(ids):
                    rest.append((doc, start + k, ids[4 * k :], total))
                n += k
            left -= n
            yield window


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, size: int = SIZE, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset.

    tokenizer: path of a ``tokenizers`` file, the same on all executors. Every document ends with
    ``end_id``; a null text is empty, so it is that id alone. Each id lies in one piece; the pieces of
    a sequence follow each other from offset 0 without a gap. Sequences hold ``size`` ids, but for a
    few of smaller power-of-two lengths at a partition's end. Repeated rows are packed as documents of
    their own; null ids stay null; other columns are ignored; an empty table gives no rows. A
    sequence's id is made of the partition's number and a count, so a lost task packs alike again. A
    text of any length is cut into full windows and a rest. No shuffle; memory is a batch of texts and
    the open windows.
    """
    small_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), SumOfSquares(size, max_open)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 32
        rows: list[list] = [[] for _ in ARROW]
        count = held = 0

        def emit(window: list) -> None:
            nonlocal count, held
            at = 0
            for doc, start, ids, total in window:
                n = len(ids) // 4
                for column, v in zip(rows, (doc, start, n, ids, total, base + count, at), strict=True):
                    column.append(v)
                at += n
                held += len(ids)
            count += 1

        def flush() -> pa.RecordBatch:
            nonlocal held
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, ARROW, strict=True)], schema=ARROW)
            for c in rows:
                c.clear()
            held = 0
            return out

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                for doc, ids in zip(keys[a:b], enc.encode(texts[a:b]), strict=True):
                    for window in packer.add(doc, ids + end):
                        emit(window)
                    if held > 1 << 22:
                        yield flush()
        for window in packer.close():
            emit(window)
        if rows[0]:
            yield flush()
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pack, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
