"""Sum-of-squares online packing of documents into windows of a fixed number of tokens.

Each input partition packs its own documents as it reads them, so nothing is shuffled and memory holds the open windows
only. A document's ids are cut into whole windows while they last; what remains goes to the fill level h (0 is a new
window) that fits and minimises the sum over levels of squared counts of partially filled windows, read off a level array:
moving a window from h to h + a changes the sum by (1 - 2 N[h]) [h > 0] + (1 + 2 N[h + a]) [h + a < size]. Ties take the
fullest level. At a partition's end the windows still open fill each other's gaps, the emptiest first to be dealt out, and
the last one is cut into windows of powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import lean, only, pieces, prepare, text_buffers
from .tokens import SLICE, encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Windows of `size` tokens. put() and end() give pieces (doc, start, ids, doc_tokens, sequence, offset); ids are bytes of 4 a token."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(size)]
        self.sequence = -1

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence

    def level(self, a: int) -> int:
        """The fill level that a remainder of a tokens goes to."""
        size, n = self.size, self.counts
        leave = 1 - 2 * n[: size - a + 1]
        reach = 1 + 2 * n[a : size + 1]
        leave[0] = 0
        reach[-1] = 0
        cost = leave + reach
        cost[1:][n[1 : size - a + 1] == 0] = np.iinfo(np.int64).max
        return int(size - a - np.argmin(cost[::-1]))

    def put(self, doc: int, ids: bytes) -> Iterator[tuple]:
        size, total, at = self.size, len(ids) // 4, 0
        while total - at >= size:
            yield doc, at, ids[4 * at : 4 * (at + size)], total, self._next(), 0
            at += size
        a = total - at
        if not a:
            return
        h = self.level(a)
        if h:
            sequence, rows = self.open[h].pop()
            self.counts[h] -= 1
        else:
            sequence, rows = self._next(), []
        rows.append((doc, at, ids[4 * at :], total))
        if h + a == size:
            yield from self._rows(sequence, rows)
        else:
            self.open[h + a].append((sequence, rows))
            self.counts[h + a] += 1

    @staticmethod
    def _rows(sequence: int, rows: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in rows:
            yield doc, start, ids, total, sequence, at
            at += len(ids) // 4

    @staticmethod
    def _take(pieces: list, n: int) -> list:
        """The first n tokens of `pieces`, which loses them; at most one piece is cut."""
        out = []
        while n:
            doc, start, ids, total = pieces.pop(0)
            k = min(n, len(ids) // 4)
            out.append((doc, start, ids[: 4 * k], total))
            if 4 * k < len(ids):
                pieces.insert(0, (doc, start + k, ids[4 * k :], total))
            n -= k
        return out

    def end(self) -> Iterator[tuple]:
        left = [(h, *w) for h in range(self.size - 1, 0, -1) for w in self.open[h]]
        spare: list = []
        have = 0
        while left:
            h, sequence, rows = left.pop(0)
            gap = self.size - h
            while left and have < gap:
                g, _, more = left.pop()
                spare += more
                have += g
            if have >= gap:
                yield from self._rows(sequence, rows + self._take(spare, gap))
                have -= gap
            else:
                spare, have = rows + spare, have + h
        while have >= self.size:
            yield from self._rows(self._next(), self._take(spare, self.size))
            have -= self.size
        while have:
            n = 1 << (have.bit_length() - 1)
            yield from self._rows(self._next(), self._take(spare, n))
            have -= n


def pack(docs: DataFrame, tokenizer: str, split: str, end_id: int, size: int = 1024) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of every row of `docs` (doc_id, text, ...).

    A row's ids are its text's by the tokenizers file `tokenizer` (see tokens.Encoder for `split`) and then `end_id`; each
    lies in exactly one piece. ids are little-endian unsigned 32-bit. offset is gapless from 0 within a sequence_id; a
    sequence has `size` tokens or a power of two. Null and empty texts are just `end_id`. Null and repeated doc_ids are
    packed like any other, each row by itself. Other columns are ignored; an empty table gives no pieces. sequence_id holds
    the partition above its 40th bit: it repeats as long as the input is split alike.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, packer = encoder(tokenizer, split), Packer(size)
        base = TaskContext.get().partitionId() << 40
        tail = np.array([end_id], "<u4").tobytes()

        def out(rows: list) -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset = zip(*rows, strict=True)
            cols = [doc, start, [len(x) // 4 for x in ids], total, [base + s for s in sequence], offset]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for i, j in pieces(text_buffers(batch.column(1))[0], SLICE):
                part = batch.slice(i, j - i)
                begin, ids = code.encode(part.column(1))
                own, at = memoryview(ids.view(np.uint8)), (4 * begin).tolist()
                rows = [r for n, d in enumerate(part.column(0).to_pylist()) for r in packer.put(d, bytes(own[at[n] : at[n + 1]]) + tail)]
                for n in range(0, len(rows), 1000):
                    yield out(rows[n : n + 1000])
        rows = list(packer.end())
        for i in range(0, len(rows), 1000):
            yield out(rows[i : i + 1000])

    return only(docs, doc_id="bigint", text="string").mapInArrow(lean(run), SCHEMA)
