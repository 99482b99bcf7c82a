"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

The items' words are the automaton's letters. Each document is streamed through it: the state and the
length of the longest match that ends at each word show which windows of which items end there. Words
outside the items' vocabulary reset the automaton, so only runs of known words, at least as long as
the shortest window, go through it one by one.

The automaton is as large as the items, never as the documents. Items are taken in batches of at most
BATCH_WORDS words; each batch is one pass over the documents.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, small, written
from .hashing import span_hashes, word_spans

WINDOW = 13
#: Contaminated: at least one word in COVERAGE is hit.
COVERAGE = 20
BATCH_WORDS = 400_000
BUFFER_BYTES = 1 << 18

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def words(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z: runs of a-z, 0-9 and whatever isn't ASCII."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass
class Automaton:
    """The generalised suffix automaton of several sequences."""

    window: int
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: list[set] = field(default_factory=lambda: [set()])
    #: For a state: (words, item) of items shorter than the window that end there as a whole.
    whole: dict[int, dict[int, set]] = field(default_factory=dict)

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(nxt)
        self.link.append(link)
        self.items.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """Where the transition p -c-> q is longer than by one, a copy of q that isn't."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return self._split(last, q, c)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def build(self, sequences: list[tuple[object, list[int]]]) -> None:
        for _, seq in sequences:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        seen = [-1] * len(self.next)
        for k, (item, seq) in enumerate(sequences):
            at = 0
            for c in seq:
                at = self.next[at][c]
                up = at
                while up > 0 and seen[up] != k:
                    seen[up] = k
                    self.items[up].add(item)
                    up = self.link[up]
            if 0 < len(seq) < self.window:
                self.whole.setdefault(at, {}).setdefault(len(seq), set()).add(item)

    def matches(self, seq: list[int]) -> Iterator[tuple[int, int, set]]:
        """(end, length, items): the windows that end before seq[end], as the longest and all their items."""
        nxt, link, length, window, whole = self.next, self.link, self.length, self.window, self.whole
        at = size = 0
        for i, c in enumerate(seq):
            while at and c not in nxt[at]:
                at = link[at]
                size = length[at]
            if c in nxt[at]:
                at = nxt[at][c]
                size += 1
            if not size:
                continue
            longest, found, up = 0, set(), at
            if size >= window:
                longest = window
                while length[link[up]] >= window:
                    up = link[up]
                found = self.items[up]
                up = at
            while whole and up > 0:
                for n, some in whole.get(up, {}).items():
                    if up != at or n <= size:
                        longest, found = max(longest, n), found | some
                up = link[up]
            if longest:
                yield i + 1, longest, found


class Matcher:
    """Finds the windows of a batch of items in texts."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        vocabulary: dict[bytes, int] = {}
        sequences = [(item, [vocabulary.setdefault(w, len(vocabulary)) for w in ws]) for item, ws in items if ws]
        self.automaton = Automaton(window)
        self.automaton.build(sequences)
        self.shortest = min((min(window, len(s)) for _, s in sequences), default=1 << 60)
        self.vocabulary = list(vocabulary)
        joined = b" ".join(self.vocabulary)
        data = np.frombuffer(joined, dtype=np.uint8)
        h = span_hashes(data, *word_spans(data, _INSIDE)) if vocabulary else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], order

    def _in_buffer(self, held: list[tuple[int, bytes]], found: dict, counts: np.ndarray) -> None:
        buffer = b" ".join([t for _, t in held]).lower()
        data = np.frombuffer(buffer, dtype=np.uint8)
        starts, ends = word_spans(data, _INSIDE)
        if not len(starts):
            return
        begins = np.cumsum([0] + [len(t) + 1 for _, t in held[:-1]])
        part = np.searchsorted(begins, starts, side="right") - 1
        n = np.bincount(part, minlength=len(held))
        for (k, _), m in zip(held, n):
            counts[k] += m
        if not len(self.hashes):
            return
        h = span_hashes(data, starts, ends)
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        ids = np.where(self.hashes[slot] == h, self.ids[slot], -1)
        edge = np.ones(len(ids) + 1, dtype=bool)  # where a run of known words of one text may begin
        edge[1:-1] = (part[1:] != part[:-1]) | ((ids[1:] < 0) != (ids[:-1] < 0))
        at = np.flatnonzero(edge)
        long = (np.diff(at) >= self.shortest) & (ids[at[:-1]] >= 0)
        first_word = np.cumsum(n) - n
        for a, b in zip(at[:-1][long].tolist(), at[1:][long].tolist()):
            p = int(part[a])
            k, run = held[p][0], ids[a:b].tolist()
            for end, size, items in self.automaton.matches(run):
                i, j = a + end - size, a + end
                # the bytes themselves, as hashes alone don't prove a word
                if all(buffer[starts[x] : ends[x]] == self.vocabulary[ids[x]] for x in range(i, j)):
                    shift, off = int(first_word[p]), int(begins[p])
                    spans, got = found.setdefault(k, ([], set()))
                    got |= items
                    if spans and spans[-1][1] >= i - shift:
                        spans[-1] = (spans[-1][0] if spans[-1][0] <= i - shift else i - shift, j - shift, min(spans[-1][2], int(starts[i]) - off), int(ends[j - 1]) - off)
                        while len(spans) > 1 and spans[-2][1] >= spans[-1][0]:
                            last = spans.pop()
                            spans[-1] = (min(spans[-1][0], last[0]), last[1], min(spans[-1][2], last[2]), last[3])
                    else:
                        spans.append((i - shift, j - shift, int(starts[i]) - off, int(ends[j - 1]) - off))

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
        """Words of each text, and for texts with a hit the spans (word, word, byte, byte) and the items."""
        counts, found, held, size = np.zeros(len(texts), dtype=np.int64), {}, [], 0
        for k, t in enumerate(texts):
            held.append((k, t))
            size += len(t)
            if size >= BUFFER_BYTES:
                self._in_buffer(held, found, counts)
                held, size = [], 0
        if held:
            self._in_buffer(held, found, counts)
        return counts, found


_matchers: dict[object, Matcher] = {}


def _matcher(shared, key: tuple) -> Matcher:
    """The worker's matcher for a batch of items; a worker keeps one at a time."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(shared.value, key[1])
    return _matchers[key]


def _item_batches(benchmark: DataFrame, batch_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).filter("i is not null").toLocalIterator():
        ws = words(row.t)
        if size and size + len(ws) > batch_words:
            yield held
            held, size = [], 0
        held.append((row.i, ws))
        size += len(ws)
    yield held


def _merged(spans: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(s[1], out[-1][1]), min(s[2], out[-1][2]), max(s[3], out[-1][3]))
        else:
            out.append(s)
    return out


_SPANS = "array<struct<first:bigint,last:bigint,begin:bigint,end:bigint>>"


def overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, batch_words: int = BATCH_WORDS) -> DataFrame:
    """docs with n_words, hit_spans (words first..last, bytes begin..end of the UTF-8 text) and hit_items.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one
    window; one of none, or without an id, has none. Null texts have no words. Items that share an
    id count once. Repeated documents each get their row. Columns of docs with these names are replaced.
    """
    spark = docs.sparkSession
    out = docs.drop("n_words", "hit_spans", "hit_items", "__spans", "__items").withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast(_SPANS), "hit_items": F.array().cast("array<string>")})
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema])
    names = out.columns
    for number, items in enumerate(_item_batches(benchmark, batch_words)):
        if number:
            out = written(out, "decontaminate")
        shared = spark.sparkContext.broadcast(items)

        def run(parts: Iterator[pa.RecordBatch], shared=shared, key=(uuid.uuid4().hex, window)) -> Iterator[pa.RecordBatch]:
            matcher = None
            for batch in small(parts):
                matcher = matcher or _matcher(shared, key)
                texts = [t or b"" for t in batch.column(names.index("text")).cast(pa.large_binary()).to_pylist()]
                counts, found = matcher.find(texts)
                spans, got = batch.column(names.index("hit_spans")).to_pylist(), batch.column(names.index("hit_items")).to_pylist()
                for k, (s, i) in found.items():
                    old = [(x["first"], x["last"], x["begin"], x["end"]) for x in spans[k]]
                    spans[k] = [dict(zip(("first", "last", "begin", "end"), x)) for x in _merged(old + s)]
                    got[k] = sorted({*got[k], *i})
                new = {"n_words": pa.array(counts, pa.int64()), "hit_spans": pa.array(spans, batch.schema.field("hit_spans").type), "hit_items": pa.array(got, batch.schema.field("hit_items").type)}
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)

        out = in_batches(out, run, schema)
    return out


def n_hit():
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])


def contaminated():
    return (n_hit() > 0) & (n_hit() * COVERAGE >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document: words, hit words, items with occurring windows, and the verdict."""
    found = overlap(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark)
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated rows; of the others, every hit span is cut out of the text.

    n_chars, where there is one, is the new text's length. Other columns of any name stay as they are. Null texts stay null;
    repeated rows go or stay together; an empty table stays empty.
    """
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.lit(0)).alias("row"), F.col("text").cast("string").alias("text"))
    found = overlap(rows, benchmark, window).filter(~contaminated())
    # text as bytes: spans are in bytes, and begin and end at whole characters
    raw = F.encode("text", "UTF-8")
    part = lambda begin, end: F.decode(F.substring(raw, (begin + 1).cast("int"), (end - begin).cast("int")), "UTF-8")
    after = F.slice("hit_spans", 2, F.size("hit_spans"))
    kept = F.concat(
        part(F.lit(0), F.get("hit_spans", 0)["begin"]), F.array_join(F.zip_with(F.slice("hit_spans", F.lit(1), F.size(after)), after, lambda s, t: part(s["end"], t["begin"])), ""),
        part(F.element_at("hit_spans", -1)["end"], F.octet_length(raw).cast("long")),
    )
    found = found.select("row", "text", F.when(F.size("hit_spans") > 0, kept).alias("clean"))
    col = {c: F.col("row")[f"c{i}"] for i, c in enumerate(rest)} | {"text": F.coalesce("clean", "text")}
    if "n_chars" in docs.columns:
        col["n_chars"] = F.when(F.col("clean").isNotNull(), F.char_length("clean")).otherwise(col["n_chars"])
    return found.select(*[col[f.name].cast(f.dataType).alias(f.name) for f in docs.schema])
