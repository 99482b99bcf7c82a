"""Removal of repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

A byte goes if a string of LENGTH bytes covering it also starts in a document with a smaller id.

1. Documents are packed into runs of bounded size, written to the shared folder.
2. Anchors: in each string of LENGTH bytes, the places where the hash of GRAM bytes is least. Equal
   strings have the same anchors, so only suffixes at anchors need sorting. As in prefix-doubling string sorts,
   runs first exchange the anchors' hashes (sorted, as differences) and learn which occur elsewhere;
   a suffix whose first GRAM bytes are unique is never sent.
3. Each run sorts what is left (once for equal contexts, with their smallest document id), front-codes
   it, and sends each range of the order to its bucket.
4. A bucket merges its runs with loser trees that carry common prefixes: two candidates are compared
   only from where both are known to agree with the last winner. Many ranges of a bucket are
   merged in step, one vector operation for all. Neighbours' common prefixes, and the bytes before
   the anchor, then give the smallest document of each string around it; a mask per suffix goes
   back to its run, which marks bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bytes_of, id_and_text, written
from .hashing import window_hashes

LENGTH, GRAM = 50, 24
#: Bytes of text in a run; hashes and suffixes for which a bucket is planned.
RUN_BYTES, BUCKET_HASHES, BUCKET_SUFFIXES = 4 << 20, 700_000, 240_000
#: Texts are searched for anchors in slices of so many bytes.
SLICE = 1 << 20
LANES = 2048
#: Contexts that are gathered at once.
GATHERED = 32_768
_U = np.uint64


def _zip(a: np.ndarray) -> bytes:
    """An array as compressed byte planes, which holds the small differences of sorted numbers well."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T if len(a) else np.zeros((0, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unzip(b: bytes, dtype, n: int, width: int = 1) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=n * width * np.dtype(dtype).itemsize + 1), dtype=np.uint8)
    flat = np.ascontiguousarray(raw.reshape(-1, n).T) if n else np.zeros((0, width * np.dtype(dtype).itemsize), np.uint8)
    out = flat.view(dtype)
    return out if width > 1 else out.reshape(-1)


# ---- anchors of a text -------------------------------------------------------------------------


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places of the least gram hashes in windows of `length` bytes, and those hashes."""
    places, hashes = [], []
    n, w = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    step = max(SLICE, 4 * length)
    for at in range(0, n - length + 1, step):
        part = data[at : min(n, at + step + length - 1)]
        h = window_hashes(part, gram)
        m = h.copy()  # the least of w hashes from each place on, by doubling
        size = 1
        while size * 2 <= w:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < w:
            m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
        # a place is an anchor if its hash is the least of some window: the greatest of those leasts is its own
        top = np.full(len(h), 0, dtype=_U)
        top[: len(m)] = m
        size = 1
        g = np.concatenate([np.zeros(w - 1, _U), top])
        while size * 2 <= w:
            g = np.maximum(g[:-size], g[size:])
            size *= 2
        if size < w:
            g = np.maximum(g[: len(g) - (w - size)], g[w - size :])
        found = np.flatnonzero(g[: len(h)] == h)
        places.append(found + at)
        hashes.append(h[found])
    p, h = np.concatenate(places), np.concatenate(hashes)
    if len(places) > 1:  # slices overlap
        p, first = np.unique(p, return_index=True)
        h = h[first]
    return p, h


# ---- runs --------------------------------------------------------------------------------------

_RUN_DDL = "run long, size long, ids binary, lengths binary, data binary"


def runs(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The documents of each partition in runs of about run_bytes of text."""
    schema = arrow_schema({"run": pa.int64(), "size": pa.int64(), "ids": pa.binary(), "lengths": pa.binary(), "data": pa.binary()})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, ids, texts, size = TaskContext.get().partitionId() << 33, [], [], 0

        def packed() -> pa.RecordBatch:
            row = (base, size, np.array(ids, np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(texts)))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in parts:
            for doc_id, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= run_bytes:
                    yield packed()
                    base, ids, texts, size = base + 1, [], [], 0
        if ids:
            yield packed()

    return docs.mapInArrow(run, _RUN_DDL)


class Run:
    """A run's texts in one array, and its anchors."""

    def __init__(self, row: dict, length: int, gram: int):
        self.length, self.gram, self.reach = length, gram, length - gram
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=row["size"] + 1) if row["size"] else b"", np.uint8)
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        places, hashes = anchors(self.data, length, gram)
        # texts lie next to each other: grams that cross from one into the next go
        doc = np.searchsorted(self.ends, places, side="right")
        inside = places + gram <= self.ends[np.minimum(doc, len(self.ends) - 1)]
        self.places, self.doc, self.hashes = places[inside], doc[inside], hashes[inside] >> _U(20)
        self.unique, self.of = np.unique(self.hashes, return_inverse=True)

    def shared_here(self) -> np.ndarray:
        """Whether two documents of this run hold a hash."""
        low, high = np.full(len(self.unique), len(self.ids)), np.full(len(self.unique), -1)
        np.minimum.at(low, self.of, self.doc)
        np.maximum.at(high, self.of, self.doc)
        return low != high

    def contexts(self, shared: np.ndarray) -> None:
        """Sort the suffixes at anchors of shared hashes, equal contexts once."""
        want = np.flatnonzero(shared[self.of])
        keys, lens = [], []
        for at in range(0, len(want), GATHERED):
            k, n = self._keys(self.places[want[at : at + GATHERED]], self.doc[want[at : at + GATHERED]])
            keys.append(k)
            lens.append(n)
        self.occ = want
        words = np.concatenate(keys) if keys else np.zeros((0, key_words(self.length, self.gram)), _U)
        lens_ = np.concatenate(lens) if lens else np.zeros((0, 2), np.uint8)
        order = _sorted(words)
        words = words[order]
        new = np.r_[True, (words[1:] != words[:-1]).any(axis=1)] if len(words) else np.zeros(0, bool)
        self.entry = np.empty(len(order), dtype=np.int64)
        self.entry[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.words, self.lens = words[first], lens_[order][first]
        ids = self.ids[self.doc[want]][order]
        self.least = np.minimum.reduceat(ids, first) if len(first) else np.zeros(0, np.int64)
        self.entry_hash = self.hashes[want][order][first]

    def _keys(self, places: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sort keys: the bytes from the anchor on, how many of them lack, the bytes before it backwards, how many lack."""
        right, left = np.minimum(self.ends[doc] - places, self.length), np.minimum(places - self.begins[doc], self.reach)
        width = 8 * key_words(self.length, self.gram)
        half = 8 * -(-(self.length + 1) // 8)
        out = np.zeros((len(places), width), dtype=np.uint8)
        j = np.arange(self.length)
        got = self.data[np.minimum(places[:, None] + j, len(self.data) - 1)]
        out[:, : self.length] = np.where(j < right[:, None], got, 0)
        out[:, half - 1] = self.length - right
        j = np.arange(self.reach)
        got = self.data[np.maximum(places[:, None] - 1 - j, 0)]
        out[:, half : half + self.reach] = np.where(j < left[:, None], got, 0)
        out[:, width - 1] = self.reach - left
        return out.view(">u8").astype(_U), np.stack([right, left], axis=1).astype(np.uint8)


def key_words(length: int, gram: int) -> int:
    """Words of 8 bytes in a sort key; each half ends with a byte of how much it lacks."""
    return -(-(length + 1) // 8) + -(-(length - gram + 1) // 8)


def _bucket(hashes: np.ndarray, buckets: int, places: int = LENGTH - GRAM + 1) -> np.ndarray:
    """A range of the anchors' hashes (of 44 bits) for each, all ranges about equally full.

    An anchor's hash is the least of `places` hashes, so low ones are frequent: with x in [0, 1), those above x are
    (1 - x)**places * (1 + (places - 1) * x / 2) of all. In whole numbers, which give the same on any machine.
    """
    one = _U((1 << 32) - 1)
    x = hashes >> _U(12)
    above = one - x
    for _ in range(places - 1):
        above = (above * (one - x)) >> _U(32)
    above = (above * ((_U(1 << 32) + ((x * _U(places - 1)) >> _U(1))) >> _U(8))) >> _U(24)
    return ((one - np.minimum(above, one)) * _U(buckets)) >> _U(32)


def _pieces(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices in order) for a bucket number of each element."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
    for i, j in zip(cut, np.r_[cut[1:], len(b)]):
        yield int(b[i]), order[i:j]


def _sorted(words: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian words, equal ones as they come: as byte strings of one length."""
    text = np.ascontiguousarray(words).astype(">u8")
    return np.argsort(text.view(f"S{8 * words.shape[1]}").reshape(-1), kind="stable")


def common_bytes(words: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many leading bytes the rows of two arrays of big-endian words share."""
    differ = words != other
    at = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1] - 1)
    rows = np.arange(len(words))
    x = words[rows, at] ^ other[rows, at]
    same, left = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for k in range(8):
        left &= ((x >> _U(56 - 8 * k)) & _U(255)) == 0
        same += left
    return 8 * at + same


# ---- merging -----------------------------------------------------------------------------------


def _lanes(words: np.ndarray, lanes: int) -> np.ndarray:
    """For each key its range among `lanes` ranges cut at sampled keys."""
    sample = words[:: max(1, len(words) // (16 * lanes))]
    sample = sample[np.lexsort(sample.T[::-1])]
    split = sample[np.linspace(0, len(sample), lanes + 1)[1:-1].astype(int)]
    low, high = np.zeros(len(words), np.int64), np.full(len(words), len(split))
    while (low < high).any():
        mid = (low + high) // 2
        s = split[np.minimum(mid, len(split) - 1)]
        differ = words != s
        at = differ.argmax(axis=1)
        rows = np.arange(len(words))
        above = (words[rows, at] >= s[rows, at]) & (low < high)
        below = ~above & (low < high)
        low = np.where(above, mid + 1, low)
        high = np.where(below, mid, high)
    return low


def merge(words: np.ndarray, lcp: np.ndarray, run: np.ndarray, n_runs: int, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of keys that come as sorted runs, one after another, and the words that each shares with the one before.

    lcp is how many leading words a key shares with the one before it in its run. One loser tree
    for each range of keys, all advanced in step. A node keeps its loser and the words that the loser shares
    with the winner that passed; a candidate that shares more with the last winner is smaller, and
    only where both share as many are words compared, from the first that isn't known.
    """
    n, width = words.shape
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lanes = int(max(1, min(lanes, 2 * n // n_runs)))
    lane = _lanes(words, lanes) if lanes > 1 else np.zeros(n, np.int64)
    size = 1 << max(0, (n_runs - 1).bit_length())
    counts = np.bincount(run * lanes + lane, minlength=n_runs * lanes).reshape(n_runs, lanes)
    begin = np.full((lanes, size), n, dtype=np.int64)
    stop = np.full((lanes, size), n, dtype=np.int64)
    at = np.cumsum(counts.ravel()).reshape(n_runs, lanes)
    stop[:, :n_runs], begin[:, :n_runs] = at.T, (at - counts).T
    cur = np.where(begin < stop, begin, n)
    keys = np.concatenate([words, np.full((1, width), np.uint64(0xFFFFFFFFFFFFFFFF))])
    loser, shared = np.zeros((lanes, size), np.int64), np.zeros((lanes, size), np.int64)

    def play(a, la, b, lb):
        """Does a win over b, and what the loser shares with the winner; arrays of entries (n: none) and known words."""
        wins, left = la > lb, np.minimum(la, lb)
        tie = np.flatnonzero(la == lb)
        d = la[tie]
        while len(tie):
            more = (d < width) & (d >= 0)
            x, y = keys[a[tie], np.clip(d, 0, width - 1)], keys[b[tie], np.clip(d, 0, width - 1)]
            same = more & (x == y)
            done = ~same
            wins[tie[done]] = np.where(more[done], x[done] < y[done], a[tie[done]] <= b[tie[done]])
            left[tie[done]] = d[done]
            tie, d = tie[same], d[same] + 1
        return wins, left

    def known(entries, value):
        return np.where(entries < n, value, -1)

    # the first tournament, from the leaves up: nothing is known yet
    champ = [np.arange(size)[None, :].repeat(lanes, 0)]
    while champ[-1].shape[1] > 1:
        c = champ[-1]
        a, b = c[:, 0::2].ravel(), c[:, 1::2].ravel()
        rows = np.arange(lanes).repeat(c.shape[1] // 2)
        ea, eb = cur[rows, a], cur[rows, b]
        wins, left = play(ea, known(ea, 0), eb, known(eb, 0))
        half = c.shape[1] // 2
        nodes = np.tile(np.arange(half, 2 * half), lanes)
        loser[rows, nodes], shared[rows, nodes] = np.where(wins, b, a), left
        champ.append(np.where(wins, a, b).reshape(lanes, half))
    win = champ[-1][:, 0]
    win_lcp = np.zeros(lanes, np.int64)
    total = np.bincount(lane, minlength=lanes)
    first = np.cumsum(total) - total
    order, out_lcp = np.empty(n, np.int64), np.zeros(n, np.int64)
    live = np.flatnonzero(total > 0)
    lcp = np.concatenate([lcp, [-1]])
    for step in range(int(total.max())):
        live = live[total[live] > step]
        w = win[live]
        e = cur[live, w]
        order[first[live] + step], out_lcp[first[live] + step] = e, win_lcp[live]
        e = e + 1
        e = np.where(e < stop[live, w], e, n)
        cur[live, w] = e
        cand, known_c, node = w, lcp[e], (w + size) >> 1
        for _ in range(size.bit_length() - 1):
            other, known_o = loser[live, node], shared[live, node]
            eo = cur[live, other]
            known_o = np.where(eo < n, known_o, -1)
            wins, left = play(e, known_c, eo, known_o)
            loser[live, node], shared[live, node] = np.where(wins, other, cand), left
            cand, e, known_c = np.where(wins, cand, other), np.where(wins, e, eo), np.where(wins, known_c, known_o)
            node >>= 1
        win[live], win_lcp[live] = cand, known_c
    return order, out_lcp


def smaller_elsewhere(words: np.ndarray, lens: np.ndarray, docs: np.ndarray, length: int, gram: int, shared: np.ndarray | None = None) -> np.ndarray:
    """A mask for each of the sorted keys: bit o says that the string from o bytes before the anchor starts in a smaller document too."""
    n, reach = len(words), length - gram
    half = 8 * -(-(length + 1) // 8)
    same = np.zeros(n, np.int64)
    if n > 1:
        same[1:] = np.minimum(common_bytes(words[1:, : half // 8], words[:-1, : half // 8]), length)
    mask = np.zeros(n, np.uint32 if reach < 32 else np.uint64)
    right, left = lens[:, 0].astype(np.int64), lens[:, 1].astype(np.int64)
    # the bytes before the anchors in order, and how many of these each shares with the one before it
    order = _sorted(words[:, half // 8 :])
    before = words[order, half // 8 :]
    agree = np.zeros(n, np.int16)
    if n > 1:
        agree[1:] = common_bytes(before[1:], before[:-1])
    del before
    alike = np.zeros(n, np.int64)

    for o in range(reach + 1):
        # those that agree in the o bytes before the anchor, and in the bytes from it on
        alike[order] = np.cumsum(agree < o)
        block = np.cumsum(same < length - o)
        some = np.flatnonzero((right >= length - o) & (left >= o))
        if not len(some):
            continue
        key = block[some] * (n + 1) + alike[some]
        by = np.argsort(key)
        k, d = key[by], docs[some][by]
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        least = np.repeat(np.minimum.reduceat(d, start), np.diff(np.r_[start, len(k)]))
        hit = some[by[d > least]]
        mask[hit] |= mask.dtype.type(1 << o)
    return mask


# ---- the whole ---------------------------------------------------------------------------------


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, run_bytes: int = RUN_BYTES, bucket_hashes: int = BUCKET_HASHES, bucket_suffixes: int = BUCKET_SUFFIXES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (begin, end) of the removed bytes of each row.

    Null texts count as empty. Rows that repeat a doc_id are judged each against smaller ids only. A
    row without an id loses nothing and takes nothing from others. An empty table gives no rows. Strings are
    compared byte by byte; hashes only say which are sent, and where.
    """
    rows = id_and_text(docs)
    held = written(runs(rows.filter("doc_id is not null"), run_bytes), "runs", "uncompressed")
    size = held.agg(F.sum("size")).first()[0] or 0
    places = length - gram + 1
    buckets = max(12, math.ceil(size * 2 / (places + 1) / bucket_hashes))

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in parts:
            for i in range(batch.num_rows):
                yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}

    def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    asked_schema = arrow_schema({"bucket": pa.int32(), "run": pa.int64(), "n": pa.int64(), "hashes": pa.binary()})

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(parts):
            unique = Run(row, length, gram).unique
            out = [(b, row["run"], len(i), _zip(np.diff(unique[i], prepend=_U(0)))) for b, i in _pieces(_bucket(unique, buckets, places))]
            if out:
                yield batch_of(out, asked_schema)

    told_schema = arrow_schema({"run": pa.int64(), "bucket": pa.int32(), "n": pa.int64(), "shared": pa.int64(), "bits": pa.binary()})

    def tell(block: pa.Table) -> pa.Table:
        got = block.to_pylist()
        lists = [np.cumsum(_unzip(r["hashes"], _U, r["n"]), dtype=_U) for r in got]
        _, of, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        flags = np.split(n[of] > 1, np.cumsum([len(x) for x in lists])[:-1])
        out = [(r["run"], r["bucket"], r["n"], int(f.sum()), np.packbits(f).tobytes()) for r, f in zip(got, flags)]
        return pa.Table.from_batches([batch_of(out, told_schema)])

    told = written(held.mapInArrow(ask, "bucket int, run long, n long, hashes binary").groupBy("bucket").applyInArrow(tell, "run long, bucket int, n long, shared long, bits binary"), "shared")
    expected = told.agg(F.sum("shared")).first()[0] or 0
    ranges = max(12, math.ceil(1.5 * expected / bucket_suffixes))
    hints = told.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "bits"))).alias("hints"))
    hinted = held.join(hints, "run", "left")

    def prepared(row: dict) -> Run:
        r = Run(row, length, gram)
        elsewhere, hints = np.zeros(len(r.unique), bool), {h["bucket"]: h for h in row["hints"] or []}
        for b, i in _pieces(_bucket(r.unique, buckets, places)):
            elsewhere[i] = np.unpackbits(np.frombuffer(hints[b]["bits"], np.uint8), count=hints[b]["n"]).astype(bool)
        r.contexts(elsewhere | r.shared_here())
        return r

    half, reach = 8 * -(-(length + 1) // 8), length - gram
    sent = np.r_[np.arange(length), half - 1, half + np.arange(reach), 8 * key_words(length, gram) - 1]  # without the padding
    sent_schema = arrow_schema({"range": pa.int32(), "run": pa.int64(), "n": pa.int64(), "common": pa.binary(), "rest": pa.binary(), "size": pa.int64(), "docs": pa.binary()})

    def exchange(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(parts):
            r, out = prepared(row), []
            for b, i in _pieces(_bucket(r.entry_hash, ranges, places)):
                text = np.ascontiguousarray(r.words[i].astype(">u8")).view(np.uint8)[:, sent]
                differ = text[1:] != text[:-1]
                common = np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), text.shape[1])].astype(np.uint8)
                rest = text[np.arange(text.shape[1]) >= common[:, None]]
                out.append((b, row["run"], len(i), zstandard.compress(common.tobytes(), 1), zstandard.compress(rest.tobytes(), 3), len(rest), _zip(r.least[i])))
            if out:
                yield batch_of(out, sent_schema)

    masks_schema = arrow_schema({"run": pa.int64(), "range": pa.int32(), "n": pa.int64(), "masks": pa.binary()})

    def combine(block: pa.Table) -> pa.Table:
        got = block.to_pylist()
        keys, docs_, lcps, run_of = [], [], [], []
        for k, r in enumerate(got):
            common = np.frombuffer(zstandard.decompress(r["common"]), np.uint8).astype(np.int64)
            rest = np.frombuffer(zstandard.decompress(r["rest"]) if r["size"] else b"", np.uint8)
            text = np.zeros((r["n"], 8 * key_words(length, gram)), np.uint8)
            own = np.arange(len(sent)) >= common[:, None]
            packed = np.zeros((r["n"], len(sent)), np.uint8)
            packed[own] = rest
            # undo the front coding: a byte comes from the last row above that sent it
            source = np.maximum.accumulate(np.where(own, np.arange(r["n"], dtype=np.int32)[:, None], np.int32(0)), axis=0)
            text[:, sent] = packed[source, np.arange(len(sent))]
            w = text.view(">u8").astype(_U)
            keys.append(w)
            differ = w[1:] != w[:-1]
            lcps.append(np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), w.shape[1])])
            docs_.append(_unzip(r["docs"], np.int64, r["n"]))
            run_of.append(np.full(r["n"], k, np.int32))
            r["common"] = r["rest"] = r["docs"] = None
        del text, packed, source, own, w, differ
        words = np.concatenate(keys)
        del keys
        doc, run_of, known = np.concatenate(docs_), np.concatenate(run_of), np.concatenate(lcps)
        del docs_, lcps
        order, _ = merge(words, known, run_of, len(got))
        w = words[order]
        del words, known, run_of
        last = half // 8 - 1
        lens = np.stack([length - (w[:, last] & _U(255)).astype(np.int64), reach - (w[:, -1] & _U(255)).astype(np.int64)], axis=1)
        mask = np.empty(len(order), np.uint32 if reach < 32 else np.uint64)
        mask[order] = smaller_elsewhere(w, lens, doc[order], length, gram)
        parts = np.split(mask, np.cumsum([r["n"] for r in got])[:-1])
        return pa.Table.from_batches([batch_of([(r["run"], r["range"], r["n"], _zip(m)) for r, m in zip(got, parts)], masks_schema)])

    masks = hinted.mapInArrow(exchange, "range int, run long, n long, common binary, rest binary, size long, docs binary").groupBy("range").applyInArrow(combine, "run long, range int, n long, masks binary")
    masks = masks.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("range", "n", "masks"))).alias("masks"))
    out_ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:bigint,end:bigint>>"
    out_schema = arrow_schema({"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))})

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(parts):
            r = prepared(row)
            mask = np.zeros(len(r.least), np.uint32 if reach < 32 else np.uint64)
            told_masks = {m["range"]: m for m in row["masks"] or []}
            for b, i in _pieces(_bucket(r.entry_hash, ranges, places)):
                mask[i] = _unzip(told_masks[b]["masks"], mask.dtype, told_masks[b]["n"])
            later = r.ids[r.doc[r.occ]] > r.least[r.entry]  # not the smallest of its own run: every string around it goes
            place, bits, lens = r.places[r.occ], mask[r.entry], r.lens[r.entry].astype(np.int64)
            change = np.zeros(len(r.data) + 1, np.int32)
            for o in range(reach + 1):
                hit = (later & (lens[:, 0] >= length - o) & (lens[:, 1] >= o)) | ((bits >> mask.dtype.type(o)) & mask.dtype.type(1) > 0)
                start = np.unique(place[hit] - o)
                change[start] += 1
                change[start + length] -= 1
            gone = np.cumsum(change[:-1]) > 0
            out = []
            for doc_id, a, b in zip(r.ids.tolist(), r.begins.tolist(), r.ends.tolist()):
                g = gone[a:b]
                edge = np.flatnonzero(np.diff(np.r_[0, g.astype(np.int8), 0])) if g.any() else np.zeros(0, int)
                kept = r.data[a:b][~g] if len(edge) else r.data[a:b]
                spans = [{"begin": int(x), "end": int(y)} for x, y in zip(edge[0::2], edge[1::2])]
                out.append((doc_id, b - a, int(g.sum()), len(spans), hashlib.sha256(kept.tobytes()).hexdigest(), spans))
            for at in range(0, len(out), 4096):
                yield batch_of(out[at : at + 4096], out_schema)

    found = hinted.join(masks, "run", "left").mapInArrow(judge, out_ddl)
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = rows.filter("doc_id is null").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))
    return found.unionByName(rest)
