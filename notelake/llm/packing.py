"""Order-preserving packing of documents into windows of at most `window` tokens.

The documents of an input partition, in their order, are one stream of tokens. Dynamic programming
over its possible cuts (ends of documents, ends of sentences, and a fixed grid where neither comes
often enough) minimises padding plus penalties for cutting inside a document:

    cost(j) = penalty(j) + min over i < j, pos(j) - pos(i) <= window, of cost(i) + padding(pos(j) - pos(i))

Padding up to the window is window - pos(j) + pos(i), so the minimum of cost(i) + pos(i) over the
sliding range comes from a monotone queue; the lengths without padding, the powers of two, are
looked up. The stream is settled in blocks of bounded size: all windows but the last of a block
stay, the last one's tokens open the next block.

No shuffle: each partition packs what it reads, so that a lost executor repeats only its own.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_schema, bytes_of, id_and_text, in_batches, small
from .token_counts import VOCABULARY, encoder

WINDOW, END_ID = 4096, 2
#: In tokens of padding: what a cut at a sentence's end, or elsewhere inside a document, costs.
SENTENCE_PENALTY, INNER_PENALTY = 24, 96
GRID, BLOCK_TOKENS = 1024, 1 << 19
#: Bytes of texts that are encoded together.
BATCH_BYTES = 1 << 18
SENTENCE_ENDS = (".", "!", "?", "。", "！", "？")

_SCHEMA = arrow_schema({"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()})
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(pos: list[int], penalty: list[int], window: int) -> list[int]:
    """Indices of the cheapest cuts of pos (increasing, first 0), the first and last among them.

    No two neighbours of pos are further apart than window.
    """
    n = len(pos)
    cost, prev = [0] * n, [0] * n
    powers = []
    p = 1
    while p < window:
        powers.append(p)
        p *= 2
    index = {x: i for i, x in enumerate(pos)}
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + pos, index), increasing in both
    for j in range(1, n):
        at = pos[j]
        while at - pos[queue[0][1]] > window:
            queue.popleft()
        low, i = queue[0]
        best, choice = low + window - at, i
        if best > 0:
            for p in powers:
                k = index.get(at - p)
                if k is not None and cost[k] < best:
                    best, choice = cost[k], k
        cost[j], prev[j] = best + penalty[j], choice
        key = cost[j] + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out = [n - 1]
    while out[-1]:
        out.append(prev[out[-1]])
    return out[::-1]


def powers_of_two(n: int, window: int) -> list[int]:
    """n as lengths that need no padding, longest first; the window itself counts as one."""
    out = [window] * (n // window)
    n %= window
    while n:
        out.append(1 << (n.bit_length() - 1))
        n -= out[-1]
    return out


class Stream:
    """The documents of one partition on their way into windows."""

    def __init__(self, base: int, window: int, sentence_ids: np.ndarray):
        self.next_id, self.window, self.sentence_ids = base, window, sentence_ids
        self.parts: list[tuple[int, int, np.ndarray, int]] = []  # doc_id, start, ids, doc_tokens
        self.size = 0
        self.grid = max(1, min(GRID, window // 4))

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            part = ids[at : at + BLOCK_TOKENS]
            self.parts.append((doc_id, at, part, len(ids)))
            self.size += len(part)
            at += len(part)
            if self.size >= BLOCK_TOKENS:
                yield from self.settle(False)

    def _candidates(self) -> tuple[np.ndarray, np.ndarray]:
        places, costs, at = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
        for _, start, ids, total in self.parts:
            inner = np.flatnonzero(np.isin(ids[:-1], self.sentence_ids)) + 1
            places.append(at + inner)
            costs.append(np.full(len(inner), SENTENCE_PENALTY))
            at += len(ids)
            places.append(np.array([at]))
            costs.append(np.array([0 if start + len(ids) == total else INNER_PENALTY]))
        pos, cost = np.concatenate(places), np.concatenate(costs)
        wide = np.flatnonzero(np.diff(pos) > self.grid)
        if len(wide):
            extra = np.concatenate([np.arange(pos[i] + self.grid, pos[i + 1], self.grid) for i in wide])
            pos, cost = np.concatenate([pos, extra]), np.concatenate([cost, np.full(len(extra), INNER_PENALTY)])
            order = np.argsort(pos, kind="stable")
            pos, cost = pos[order], cost[order]
        return pos, cost

    def settle(self, last: bool) -> Iterator[tuple]:
        """Rows of the windows that are certain now; with last, of all."""
        if not self.size:
            return
        pos, cost = self._candidates()
        cuts = pos[best_cuts(pos.tolist(), cost.tolist(), self.window)].tolist()
        if not last and len(cuts) > 2:
            cuts.pop()
        ends, at = [], 0
        for cut in cuts[1:]:
            size = cut - at
            # a window goes into unpadded ones only where the cuts cost less than its padding
            pieces = powers_of_two(size, self.window)
            if INNER_PENALTY * (len(pieces) - 1) >= self.window - size:
                pieces = [size]
            for p in pieces:
                at += p
                ends.append(at)
        yield from self._rows(ends)

    def _rows(self, ends: list[int]) -> Iterator[tuple]:
        begin, k, used = 0, 0, 0
        for end in ends:
            offset = 0
            while begin + offset < end:
                doc_id, start, ids, total = self.parts[k]
                take = min(len(ids) - used, end - begin - offset)
                piece = ids[used : used + take]
                yield doc_id, start + used, take, zlib.crc32(piece.tobytes()), total, self.next_id, offset
                offset += take
                used += take
                if used == len(ids):
                    k, used = k + 1, 0
            self.next_id += 1
            begin = end
        rest = self.parts[k:]
        if used:
            doc_id, start, ids, total = rest[0]
            rest[0] = (doc_id, start + used, ids[used:], total)
        self.parts, self.size = rest, sum(len(p[2]) for p in rest)


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of a document in a sequence: see _DDL.

    A document's tokens are those of its text and then end_id; a null or empty text has end_id alone.
    Sequences hold at most `window` tokens, in input order; each needs padding up to window unless
    its length is a power of two. sequence_id is unique over the table: the partition's number in the
    bits from 33 on, then a running number. A repeated row is a document of its own; an empty
    table gives no rows. Columns other than doc_id and text aren't read.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        marks = [encode.library.token_to_id(m + s) for m in SENTENCE_ENDS for s in ("", "</w>")]
        stream = Stream(TaskContext.get().partitionId() << 33, window, np.array([m for m in marks if m is not None], dtype="<u4"))
        end_ids = np.array([end_id], dtype="<u4")

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

        for batch in small(parts):
            ids_of, texts = batch.column(0).to_pylist(), bytes_of(batch.column(1))
            size = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):
                # texts of about BATCH_BYTES together, one at least
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES, side="right")))
                some = texts[at:end]
                counts, ids = encode.batch(some)
                rows: list[tuple] = []
                for doc_id, stop, n in zip(ids_of[at:end], np.cumsum(counts).tolist(), counts.tolist()):
                    rows.extend(stream.add(doc_id, np.concatenate([ids[stop - n : stop], end_ids])))
                if rows:
                    yield out(rows)
                at = end
        rows = list(stream.settle(True))
        if rows:
            yield out(rows)

    return in_batches(id_and_text(docs), run, _DDL)
