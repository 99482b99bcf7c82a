"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document is its set of distinct shingles of five words, each as a 64-bit hash. Its sketch has `bins` coordinates: in round i
each shingle falls into one bin by hashing and offers the value (i, hash); a bin keeps its smallest. All
bins fill after about bins * ln(bins) placements; from round `bins` on every shingle is offered
to the bin of the round's number, so that each coordinate fills for certain. Coordinates of two sets agree with
the chance of their Jaccard similarity J, with Chernoff-like concentration.

`bands` groups of `rows` coordinates are the buckets. A pair of J >= 0.85 shares none of the 32 buckets of 6
with a chance below 3e-7. Documents with equal sets are one class, and only its smallest id takes part. Buckets with the
same members are verified once, on the full sets, by counting common shingles. A block of a bucket, of
bounded size, returns a spanning forest of its components and no pairs.

First pass: the buckets of the first bands, a large bucket in blocks that all hold the same few members, its hubs. Work is in
proportion to the members, and near copies end up in one component. Second pass, over all bands: only buckets whose members aren't all in one
component, and of a large one only pairs of blocks that hold different components: members known to be connected
needn't be compared. So every two members of a bucket are compared, or are in one component already.
Components of the whole table are found without collecting anything.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, id_and_text, in_batches, small, spread_join, written
from .components import connected_components
from .hashing import SPACE, mix, segments, span_hashes, word_spans

WORDS, BANDS, ROWS = 5, 32, 6
#: So many bands are verified before the others.
FIRST_BANDS = 8
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A block of a bucket holds about so many documents and so many shingles at most.
BLOCK_DOCS, BLOCK_SHINGLES = 192, 1_500_000
#: Members of a large bucket that each of its blocks holds in the first pass.
HUBS = 4
_SLICE = 1 << 18
_SEEDS = mix(np.arange(1, 4096, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOW = np.uint64(0xFFFFFFFF)


def shingle_sets(texts: list[bytes], size: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles.

    Words are runs of other than ASCII white space after lower-casing A-Z. With fewer words than `size`
    the whole sequence is one shingle; without words the set is empty.
    """
    held: list[np.ndarray] = []
    current = 0

    def done() -> np.ndarray:
        w = np.concatenate(held) if held else np.zeros(0, np.uint64)
        if not len(w):
            return w
        n = max(1, len(w) - size + 1)
        s = np.full(n, min(len(w), size), dtype=np.uint64)
        for j in range(min(len(w), size)):
            s = mix(s * np.uint64(0x9FB21C651E98DF25) + w[j : j + n])
        return np.unique(s)

    for part in segments(texts, _SLICE):
        buffer = b" ".join([p for _, p in part]).lower()
        data = np.frombuffer(buffer, dtype=np.uint8)
        starts, ends = word_spans(data, ~SPACE)
        h = span_hashes(data, starts, ends)
        begins = np.cumsum([0] + [len(p) + 1 for _, p in part])
        cut = np.searchsorted(starts, begins)
        for i, (k, _) in enumerate(part):
            while current < k:
                yield done()
                held, current = [], current + 1
            held.append(h[cut[i] : cut[i + 1]])
    while current < len(texts):
        yield done()
        held, current = [], current + 1


def sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """The fast similarity sketch of a set that isn't empty."""
    out = np.full(bins, np.uint64(0xFFFFFFFFFFFFFFFF))
    step = max(1, math.ceil(1.2 * bins * math.log(bins) / len(shingles)))
    i = 0
    while i < bins:
        rounds = np.arange(i, min(bins, i + step))
        h = mix(shingles[None, :] ^ _SEEDS[rounds][:, None])
        np.minimum.at(out, (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64).ravel(), ((rounds.astype(np.uint64) << np.uint64(32))[:, None] | (h & _LOW)).ravel())
        i += step
        if out.max() < 0xFFFFFFFFFFFFFFFF:
            return out
    for b in np.flatnonzero(out == 0xFFFFFFFFFFFFFFFF):
        out[b] = np.uint64((bins + int(b)) << 32) | (mix(shingles ^ _SEEDS[bins + b]) & _LOW).min()
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for column in coordinates.reshape(bands, rows).T:
        keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + column)
    return keys.view(np.int64)


def sketches(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n (size of the set), set_a and set_b (its 128-bit hash, null if empty), keys (a bucket for each band)."""
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("keys", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(parts):
            n, a, b, keys, ends = [], [], [], [], [0]
            for s in shingle_sets(bytes_of(batch.column(1)), words):
                n.append(len(s))
                if len(s):
                    digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    a.append(int(digest[0]))
                    b.append(int(digest[1]))
                    keys.append(band_keys(sketch(s, bands * rows), bands, rows))
                else:
                    a.append(None)
                    b.append(None)
                ends.append(ends[-1] + (bands if len(s) else 0))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat).cast(pa.list_(pa.int64()))], schema=schema)

    return in_batches(id_and_text(docs), run, "doc_id long, n long, set_a long, set_b long, keys array<long>")


def full_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and shingles (the sorted hashes as bytes)."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(parts):
            sets = [s.tobytes() for s in shingle_sets(bytes_of(batch.column(1)), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], schema=schema)

    return in_batches(id_and_text(docs), run, "doc_id long, shingles binary")


def forest(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each set the first set of its component under links of the exact similarity."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if n == 2:
        common = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))]] * 2)
        common[1] = common[0][::-1]
    else:
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), sizes)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        common, width, at = np.zeros((n, n)), max(64, 4_000_000 // n), 0
        while at < len(column):
            first = column[at]
            end = int(np.searchsorted(column, first + width))
            x = np.zeros((n, width), dtype=np.float32)
            x[owner[at:end], column[at:end] - first] = 1
            common += x @ x.T
            at = end
    union = sizes[:, None] + sizes[None, :] - common
    linked = 100 * common >= percent * union
    np.fill_diagonal(linked, True)
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def _blocks_verified(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join, block by block of rows (block, id), what is linked by exact similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(block: pa.Table) -> pa.Table:
        ids = block.column("id").to_numpy()
        _, first = np.unique(ids, return_index=True)  # sorted by id, repeated ids once
        ids, held = ids[first], block.column("shingles").to_pylist()
        if len(ids) < 2:
            return schema.empty_table()
        top = forest([np.frombuffer(held[k], np.uint64) for k in first], percent)
        joined = np.flatnonzero(top != np.arange(len(ids)))
        return pa.table([pa.array(ids[top[joined]]), pa.array(ids[joined])], schema=schema)

    return rows.join(sets.withColumnRenamed("doc_id", "id"), "id").groupBy("block").applyInArrow(verify, "a long, b long")


def _first_pass(members: DataFrame) -> DataFrame:
    """(block, id): small buckets whole, large ones in blocks by the hash of the id, each with the bucket's hubs."""
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts").cast("long"))
    block = lambda part: F.struct("key", part.cast("long").alias("part")).alias("block")
    slot = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(HUBS)).alias("slot")
    hubs = members.filter("parts > 1").groupBy("key", "parts", slot).agg(F.min_by("id", F.xxhash64("id")).alias("id"))
    every = hubs.select("key", "id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return members.select(block(own), "id").unionByName(every.select(block(F.col("part")), "id")).distinct()


def _second_pass(members: DataFrame, known: DataFrame) -> DataFrame:
    """(block, id): of buckets that aren't in one component of known (id, component), what has to be compared still.

    In a large bucket each component with half a block of members or more has blocks of its own, and the others share blocks. Two
    blocks meet unless both are of the same component.
    """
    at = members.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("key")
    # a large bucket is a hot key
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    at = spread_join(at.withColumnRenamed("n", "size"), open_.withColumn("is_open", F.lit(True)), "key", sizes, F.col("id")).filter("is_open")
    at = written(at.select("key", "id", F.col("size").alias("n"), "early", "parts", "component"), "open")
    # a small bucket of the first bands has been compared as a whole
    small = at.filter("parts = 1 and not early").select(F.struct("key", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("other")).alias("block"), "id")
    large = at.filter("parts > 1")
    sizes = large.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("shingles"))
    groups = sizes.withColumn("own", (F.col("n") >= BLOCK_DOCS / 2) | (F.col("shingles") >= BLOCK_SHINGLES / 2))
    # components of one group: the hash of a large component (0 stands for those that share blocks)
    named = groups.select("key", "component", "own", "n", "shingles", F.when(F.col("own"), F.xxhash64("component")).otherwise(F.lit(0)).alias("group"))
    parts = named.groupBy("key", "group").agg(F.max("own").alias("own"), F.greatest(F.ceil(F.sum("n") / BLOCK_DOCS), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).cast("long").alias("of"))
    both = F.struct("key", "component").alias("both")
    groups = named.join(parts.drop("own"), ["key", "group"]).select(both, "group", "of", "n")
    # a bucket's large component is a hot key
    placed = spread_join(large.select("key", "id", both), groups.select("both", "group", "of"), "both", groups.select("both", "n"), F.col("id"))
    placed = placed.select("key", "id", F.struct("group", F.pmod(F.xxhash64("id", F.lit(7)), F.col("of")).alias("part")).alias("chunk"))
    chunks = parts.select("key", "own", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("of") - 1), lambda p: F.struct(F.col("group").alias("group"), p.alias("part")))).alias("chunk"))
    one, two = chunks.select("key", F.col("chunk").alias("x"), F.col("own").alias("own")), chunks.select("key", F.col("chunk").alias("y"))
    # blocks of a component's own don't meet each other; shared ones do, and each is compared within itself
    meet = one.join(two, "key").filter((F.col("x") < F.col("y")) & ~(F.col("own") & (F.col("x.group") == F.col("y.group"))) | ((F.col("x") == F.col("y")) & ~F.col("own")))
    pairs = meet.select("key", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("chunk"))
    block = F.struct("key", F.xxhash64("x", "y").alias("part"), F.xxhash64("y", "x").alias("other")).alias("block")
    return small.unionByName(placed.join(pairs, ["key", "chunk"]).select(block, "id"))


def components(docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, component) of the classes that are linked, by the two passes."""
    entries = reps.select(F.col("id"), F.col("n"), F.posexplode("keys").alias("band", "key"))
    mark = F.xxhash64("id")
    buckets = entries.groupBy("key").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 8)).alias("y")).filter("docs > 1")
    parts = F.when((F.col("docs") <= BLOCK_DOCS) & (F.col("shingles") <= BLOCK_SHINGLES), 1).otherwise(F.greatest(F.ceil(F.col("docs") / max(1, BLOCK_DOCS - HUBS)), F.ceil(F.col("shingles") / BLOCK_SHINGLES))).cast("int")
    once = buckets.groupBy("docs", "shingles", "x", "y").agg(F.min(F.struct("band", "key")).alias("first")).select("first.key", (F.col("first.band") < FIRST_BANDS).alias("early"), parts.alias("parts"))
    members = written(entries.select("key", "id", "n").join(once, "key"), "members")
    # as many as there are near duplicates: never a side to broadcast
    wanted = members.select(F.col("id").alias("doc_id")).distinct().hint("shuffle_hash")
    sets = written(full_sets(id_and_text(docs).join(wanted, "doc_id", "left_semi"), words), "sets")
    first = connected_components(_blocks_verified(_first_pass(members.filter("early").select("key", "id", "parts")), sets, percent))
    more = _blocks_verified(_second_pass(members, first), sets, percent)
    return connected_components(first.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    component_id is the smallest doc_id reachable by links, itself included; kept says that the row is
    that one. A null or empty text, or one of white space, has an empty set and no links. Rows that repeat
    a doc_id with the same text get the same result each; ids are taken as unique to a text. A row
    without an id has no component. An empty table gives no rows.
    """
    made = written(sketches(docs, words, bands, rows), "sketches")
    some = made.filter("n > 0 and doc_id is not null")
    reps = written(some.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies")), "classes")
    found = components(docs, reps, words, percent)
    key = F.struct("set_a", "set_b").alias("class")
    classes = written(reps.join(found, "id", "left").select(key, F.coalesce("component", "id").alias("component"), F.col("copies").alias("n")), "classes")
    # a class of many copies is split; documents without an id or without words have no class to look for
    out = spread_join(made.filter("n > 0 and doc_id is not null").select("doc_id", F.col("n").alias("n_shingles"), key), classes.select("class", "component"), "class", classes.select("class", "n"), F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", "component").unionByName(made.filter("not (n > 0 and doc_id is not null)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component")))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
