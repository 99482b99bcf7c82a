"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Grades 0 < 1 < 2 < 3. One weight vector is shared by all thresholds t1 < t2 < t3:
P(grade > k) = sigmoid(w.x - t[k+1]), and the expected severity is the sum of these over k.

The labels are binary, so the grades of the training rows come from them: 0 is not toxic, and toxic rows are
graded by thirds of how much of their worst passage is made of features that the labels single out.

A document is read in passages of PASSAGE words, so that a short insult in a long text isn't diluted, and has the
severity of its worst passage. Features of a passage: which words, and which beginnings of words (of
PREFIXES bytes), of a learned vocabulary it holds, each as a 64-bit hash.

The model is fitted on a sample of at most about SAMPLE labelled rows, whole texts of them. Features are counted, and passages are
looked through, by the executors; the driver gets the vocabulary (at most VOCABULARY features) and each sampled row's worst passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bytes_of, discard, id_and_text, small, written
from .hashing import mix, segments, span_hashes, word_spans

GRADES = 4
#: Labelled rows that the model is fitted on, about half of them toxic where there are enough; features it may use.
SAMPLE, VOCABULARY = 12_000, 4000
#: A feature is taken if its log-odds are so many standard errors from 0.
LEAST_Z = 3.3
#: A feature marks toxic text if its log-odds are above this.
MARKED = 2
PREFIXES = (4, 5, 6)
PASSAGE = 200
#: Share of toxic training rows that may fall below the toxic threshold.
MISSED = 0.02

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _feature_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int | None) -> np.ndarray:
    if size is None:
        return span_hashes(data, starts, ends)
    return mix(span_hashes(data, starts, starts + size) + np.uint64(size))


@dataclass
class Model:
    """Hashes of the vocabulary's features in order, their weights, the thresholds, and the least P(grade > 0) called toxic."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The largest w.x over the passages of each text; minus infinity without words."""
        out = np.full(len(texts), -np.inf)
        seen = np.zeros(len(texts), dtype=np.int64)  # words so far, for texts that come in parts
        open_: tuple[int, int, np.ndarray] | None = None  # the last passage: its text, its place, its features

        def settle(k: int, _: int, features: np.ndarray) -> None:
            out[k] = max(out[k], float(self.weights[features].sum()))

        for held in segments(texts, 1 << 20):
            data = np.frombuffer(b" ".join([p for _, p in held]).lower(), dtype=np.uint8)
            starts, ends = word_spans(data, _INSIDE)
            if not len(starts):
                continue
            begins = np.cumsum([0] + [len(p) + 1 for _, p in held[:-1]])
            part = np.searchsorted(begins, starts, side="right") - 1
            owner = np.array([k for k, _ in held])[part]
            n = np.bincount(owner, minlength=len(texts))
            first = np.searchsorted(owner, owner, side="left")
            place = (np.arange(len(owner)) - first + seen[owner]) // PASSAGE
            seen += n
            # (text, passage, feature) as one number; passages of a buffer are numbered from the least
            low, size_v = int(place.min()), len(self.hashes) + 1
            many = int(place.max()) - low + 1
            group = (owner - int(owner[0])) * many + place - low
            keys = [np.zeros(0, np.int64)]
            for size in (None, *PREFIXES) if len(self.hashes) else ():
                # of a beginning, the hash has the size mixed in, so that it isn't the word of the same bytes
                some = np.flatnonzero(ends - starts > size) if size else slice(None)
                h = _feature_hashes(data, starts[some], ends[some], size)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                known = self.hashes[at] == h
                keys.append(group[some][known] * size_v + at[known])
            for k in np.unique(owner).tolist():
                out[k] = max(out[k], 0.0)
            last = int(owner[-1])
            # a passage may go on in the next buffer: it is scored when that is known
            if open_ and open_[:2] == (owner[0], place[0]):
                keys.append((open_[1] - low) * size_v + open_[2])
            elif open_:
                settle(*open_)
            # each feature once for a passage
            key = np.unique(np.concatenate(keys))
            group, feature = key // size_v, key % size_v
            mine = group == (last - int(owner[0])) * many + int(place[-1]) - low
            open_ = (last, int(place[-1]), feature[mine])
            group, feature = group[~mine], feature[~mine]
            if len(group):
                first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                np.maximum.at(out, group[first] // many + int(owner[0]), np.add.reduceat(self.weights[feature], first))
        if open_:
            settle(*open_)
        return out

    def over(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def passages(text: bytes) -> list[np.ndarray]:
    """The different features of each passage of a text, sorted."""
    data = np.frombuffer(text.lower(), dtype=np.uint8)
    starts, ends = word_spans(data, _INSIDE)
    if not len(starts):
        return []
    place = np.arange(len(starts)) // PASSAGE
    hashes, places = [], []
    for size in (None, *PREFIXES):
        some = np.flatnonzero(ends - starts > size) if size else np.arange(len(starts))
        hashes.append(_feature_hashes(data, starts[some], ends[some], size))
        places.append(place[some])
    h, p = np.concatenate(hashes), np.concatenate(places)
    order = np.lexsort((h, p))
    h, p = h[order], p[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (p[1:] != p[:-1])]
    h, p = h[new], p[new]
    return np.split(h, np.searchsorted(p, np.arange(1, int(p[-1]) + 1)))


def feature_counts(rows: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, and in how many toxic and clean texts each is."""
    held = [np.unique(np.concatenate(ps)) if (ps := passages(t)) else np.zeros(0, np.uint64) for t, _ in rows]
    every = np.concatenate(held) if held else np.zeros(0, np.uint64)
    features, at = np.unique(every, return_inverse=True)
    y = np.repeat([bool(y) for _, y in rows], [len(h) for h in held]) if held else np.zeros(0, bool)
    toxic = np.bincount(at, weights=y, minlength=len(features)).astype(np.int64)
    return features, toxic, np.bincount(at, minlength=len(features)) - toxic


@dataclass
class Vocabulary:
    """Hashes of the features, sorted, and whether each marks toxic text."""

    hashes: np.ndarray
    marked: np.ndarray

    @staticmethod
    def of(features: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n: tuple[int, int], size: int) -> Vocabulary:
        """The features whose log-odds are furthest from 0 by their standard errors."""
        odds, z = _odds(toxic, clean, n)
        best = np.flatnonzero(z >= LEAST_Z)
        best = best[np.lexsort((features[best], -z[best]))][:size]
        best = best[np.argsort(features[best])]
        return Vocabulary(features[best], odds[best] > MARKED)

    def worst(self, text: bytes) -> tuple[np.ndarray, float]:
        """The passage with the most marked features: its features of the vocabulary, and the share of marked ones in all of its."""
        found, most, share = np.zeros(0, np.int64), -1, 0.0
        for p in passages(text):
            at = np.minimum(np.searchsorted(self.hashes, p), max(0, len(self.hashes) - 1))
            at = at[self.hashes[at] == p] if len(self.hashes) else np.zeros(0, np.int64)
            marked = int(self.marked[at].sum())
            if marked > most:
                found, most, share = at, marked, marked / len(p)
        return found, share


def _odds(toxic, clean, n):
    odds = np.log((toxic + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1))
    return odds, np.abs(odds) / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def solve(worst: list[np.ndarray], share: np.ndarray, toxic: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights and thresholds of the ordinal regression on the rows' worst passages."""
    third = np.quantile(share[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + np.searchsorted(third, share, side="left"), 0)
    owner, column = np.repeat(np.arange(len(worst)), [len(x) for x in worst]), np.concatenate(worst)
    w, t = np.zeros(size), np.array([0.0, 1.0, 2.0])
    above = (grade[:, None] > np.arange(GRADES - 1)[None, :]).astype(float)
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    for step in range(1, 401):  # Adam on the sum of the thresholds' log losses, with a ridge on the weights
        s = np.bincount(owner, weights=w[column], minlength=len(worst))
        error = (_sigmoid(s[:, None] - t[None, :]) - above) / len(worst)
        gw = np.bincount(column, weights=error.sum(axis=1)[owner], minlength=len(w)) + 2e-5 * w
        gt = -error.sum(axis=0)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mt, vt = 0.9 * mt + 0.1 * gt, 0.999 * vt + 0.001 * gt * gt
        a, b = 1 - 0.9**step, 1 - 0.999**step
        w = w - 0.05 * (mw / a) / (np.sqrt(vw / b) + 1e-9)
        t = np.sort(t - 0.05 * (mt / a) / (np.sqrt(vt / b) + 1e-9))
    return w, t


def _cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """Where the classes part: between the low end of the toxic rows and the high end of the clean ones."""
    low, high = float(np.quantile(p[toxic], MISSED)), float(np.quantile(p[~toxic], 0.999))
    return (low + high) / 2 if high < low else max(0.5, low)


_NOTHING = Model(np.zeros(0, np.uint64), np.zeros(0), np.array([40.0, 41, 42]), 1.0)


def fit_rows(rows: list[tuple[bytes, int]], size: int = VOCABULARY) -> Model:
    """The model of labelled texts (text, toxic) that are here."""
    toxic = np.array([bool(y) for _, y in rows], dtype=bool)
    n = (int((~toxic).sum()), int(toxic.sum()))
    vocabulary = Vocabulary.of(*feature_counts(rows), n, size)
    if not len(vocabulary.hashes) or not all(n):
        return _NOTHING
    worst, share = zip(*[vocabulary.worst(t) for t, _ in rows])
    model = Model(vocabulary.hashes, *solve(list(worst), np.array(share), toxic, len(vocabulary.hashes)), 0.5)
    model.cut = _cut(model.over(model.score([t for t, _ in rows]))[:, 0], toxic)
    return model


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of about `sample` labelled rows at most, half of them from either class, by the hash of the id."""
    want = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in want.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_003)) / 1_000_003
    share = F.when(F.col("toxic") == 1, min(1.0, sample / 2 / max(1, n.get(1, 0)))).otherwise(min(1.0, sample / 2 / max(1, n.get(0, 0))))
    # about `sample` ids, whatever the table's size: small enough to send to every executor
    return id_and_text(docs).filter("text is not null").join(F.broadcast(want.filter(place < share)), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = VOCABULARY) -> Model:
    """The model of the labelled documents; without labelled ones of both kinds, one that calls nothing toxic."""
    rows = written(labelled(docs, labels, sample), "labelled")
    try:
        found = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        n = (found.get(0, 0), found.get(1, 0))
        if not all(n):
            return _NOTHING

        def each(batch: pa.RecordBatch) -> list[tuple[bytes, int]]:
            return list(zip(bytes_of(batch.column(0)), batch.column(1).to_pylist()))

        def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(parts):
                for at in range(0, batch.num_rows, 64):
                    f, toxic, clean = feature_counts(each(batch.slice(at, 64)))
                    yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(toxic), pa.array(clean)], names=["feature", "toxic", "clean"])

        sums = rows.mapInArrow(count, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        # as Vocabulary.of has it, which then sees only the best
        a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
        z = F.abs(F.log(a / (n[1] + 1)) - F.log(b / (n[0] + 1))) / F.sqrt(1 / a + 1 / b)
        best = sums.withColumn("z", z).filter(F.col("z") > LEAST_Z - 1e-6).orderBy(F.desc("z"), "feature").limit(size).toPandas()
        vocabulary = Vocabulary.of(best["feature"].to_numpy().view(np.uint64), best["toxic"].to_numpy(), best["clean"].to_numpy(), n, size)
        if not len(vocabulary.hashes):
            return _NOTHING

        def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(parts):
                worst, share = zip(*[vocabulary.worst(t) for t in bytes_of(batch.column(0))]) if batch.num_rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(worst, pa.list_(pa.int32())), pa.array(share, pa.float64()), batch.column(1)], names=["worst", "share", "toxic"])

        got = rows.mapInArrow(look, "worst array<int>, share double, toxic int").toArrow()
        lists = got.column("worst").combine_chunks()
        worst = np.split(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(np.diff(lists.offsets.to_numpy()))[:-1])
        # in an order of their own, so that a fit doesn't depend on the partitions
        sampled = sorted(zip(got.column("toxic").to_pylist(), got.column("share").to_pylist(), worst), key=lambda r: (r[0], r[1], r[2].tobytes()))
        model = Model(vocabulary.hashes, *solve([r[2] for r in sampled], np.array([r[1] for r in sampled]), np.array([r[0] == 1 for r in sampled]), len(vocabulary.hashes)), 0.5)

        def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(parts):
                yield pa.RecordBatch.from_arrays([pa.array(model.over(model.score(bytes_of(batch.column(0))))[:, 0]), batch.column(1)], names=["p", "toxic"])

        said = rows.mapInArrow(score, "p double, toxic int").toArrow()
        model.cut = _cut(said.column("p").to_numpy(), said.column("toxic").to_numpy() == 1)
        return model
    finally:
        discard(rows)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (the expected grade), grade and toxic of each row.

    toxic: P(grade > 0) is at least the cut. grade is 0 of what isn't toxic, and else the likeliest of the others. A text without words,
    or a null one, has severity 0 and isn't toxic. Repeated rows get a row each; an empty table gives none. Only
    doc_id and text are read.
    """
    schema = arrow_schema({"doc_id": pa.int64(), "severity": pa.float64(), "grade": pa.int32(), "toxic": pa.bool_()})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(parts):
            score = model.score(bytes_of(batch.column(1)))
            over = np.where(np.isfinite(score)[:, None], model.over(score), 0.0)
            toxic = (over[:, 0] >= model.cut) & np.isfinite(score)
            each = over - np.concatenate([over[:, 1:], np.zeros((len(over), 1))], axis=1)  # P(grade = k) for k from 1
            likely = np.where(toxic, 1 + each.argmax(axis=1), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(over.sum(axis=1)), pa.array(likely), pa.array(toxic)], schema=schema)

    return id_and_text(docs).mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")
