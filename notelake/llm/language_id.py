"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams of letters (n from 1 to 3, words padded with a space) by rank.
A document's own profile is compared with each language's by the out-of-place distance: the sum of rank
differences, with the profile's length for an n-gram that the language lacks. The nearest language wins.

Profiles are learned from all labelled documents that aren't held out, whole. A prediction reads the whole text.

A text is accepted as one in a learned language if it is about as near to a profile as labelled documents are that the profiles
weren't made from: no further than NEAR of the score that all but FAR of these reach. For that the labelled documents are
split in halves by their text, and each half is scored by profiles of the other: all of them count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bytes_of, discard, id_and_text, in_batches, small, written

PROFILE = 400
#: Share of labelled documents that may be as far from the profiles as they like, and of the score that all others reach.
FAR, NEAR = 0.001, 0.9
UNDETERMINED = "und"
#: The part of labelled documents that is all of them, beside the halves 0 and 1.
WHOLE = 2
#: Long texts are counted in slices of so many characters.
SLICE = 1 << 18
#: A task adds up the n-grams of documents when it holds so many, and lets go of sums that are half as many.
HELD = 1 << 19
#: Ranges of scores in which a rank is looked up.
RANGES = 1 << 16
_BITS = 21  # of a code point
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Whether a code point is a letter, by code point."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _tables["letters"]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text's letters, as code points packed into integers, and their counts."""
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    tail = ""
    for at in range(0, len(text), SLICE):
        part = tail + text[at : at + SLICE]
        tail = ""
        if at + SLICE < len(text):  # a word isn't cut, unless it is as long as a slice
            cut = part.rfind(" ")
            if cut > 0:
                part, tail = part[:cut], part[cut:]
        c, n = _slice_counts(part)
        if len(codes):
            codes, where = np.unique(np.concatenate([codes, c]), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([counts, n]), minlength=len(codes)).astype(np.int64)
        else:
            codes, counts = c, n
    if tail:
        c, n = _slice_counts(tail)
        codes, where = np.unique(np.concatenate([codes, c]), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([counts, n]), minlength=len(codes)).astype(np.int64)
    return codes, counts


def _slice_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    inside = np.zeros(len(points) + 2, dtype=bool)
    inside[1:-1] = _letters()[points]
    padded = np.zeros(len(inside), dtype=np.int64)
    padded[1:-1] = np.where(inside[1:-1], points, 0)
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one space after each word
    keep[0] = True
    p = padded[keep]  # 0 stands for the space
    if len(p) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = p[p != 0]
    two = (p[:-1] << _BITS) | p[1:]
    three = (p[:-2] << 2 * _BITS) | (p[1:-1] << _BITS) | p[2:]
    # the marks of a space keep their place: no gram crosses from one word into the next
    two, three = two[(p[:-1] != 0) | (p[1:] != 0)] + (1 << 62), three[p[1:-1] != 0]
    return np.unique(np.concatenate([one, two, three | np.int64(-1 << 63)]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, in order; of equal counts the smaller code first."""
    return codes[np.lexsort((codes, -counts))[:size]]


class Profiles:
    """The languages' profiles as one table from n-gram to rank in each language."""

    def __init__(self, by_language: dict[str, list[int]], size: int):
        self.names, self.size = sorted(by_language), size
        self.codes = np.unique(np.array([c for x in by_language.values() for c in x], dtype=np.int64))
        # a last row for what no language has
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, dtype=np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, np.array(by_language[name], dtype=np.int64)), k] = np.arange(len(by_language[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and how near: 1 for the same profile, 0 for nothing in common."""
        codes, counts = ngram_counts(text or "")
        if not len(codes) or not self.names:
            return UNDETERMINED, 0.0
        own = ranked(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at = np.where(self.codes[at] == own, at, len(self.codes))
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(own))[:, None]), self.size)).sum(axis=0)
        best = int(np.argmin(away))  # the first by name where two are as near
        return self.names[best], float(1 - away[best] / (self.size * len(own)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _labelled(docs: DataFrame) -> DataFrame:
    """lang, half and text of all labelled documents that aren't held out. Equal texts are in the same half."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return rows.select("lang", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), "text")


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(where, weights=np.concatenate([n for _, n in found]), minlength=len(codes)).astype(np.int64)


def _counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lang, half and text: the n-grams of each language's halves and how many there are; the same ones may come again."""
    held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, half), found in held.items():
            codes, n = _summed(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array([half] * len(codes), pa.int32()), pa.array(codes), pa.array(n)], names=["lang", "half", "code", "n"])

    for batch in small(parts):
        for lang, half, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch.column(2))):
            codes, n = ngram_counts(text.decode("utf-8", "replace"))
            held.setdefault((lang, half), []).append((codes, n))
            size += len(codes)
            if size >= HELD:
                held = {k: [_summed(found)] for k, found in held.items()}
                size = sum(len(found[0][0]) for found in held.values())
                if size >= HELD // 2:
                    yield from out()
                    held, size = {}, 0
    yield from out()


def _learned(docs: DataFrame, profile: int, parts: Column) -> dict[int, Profiles]:
    """Profiles by part; `parts` is an array of the parts that a half belongs to."""
    from pyspark.sql import Window

    sums = in_batches(_labelled(docs), _counts, "lang string, half int, code long, n long").groupBy("lang", "half", "code").agg(F.sum("n").alias("n"))
    sums = sums.select("lang", F.explode(parts).alias("part"), "code", "n").groupBy("lang", "part", "code").agg(F.sum("n").alias("n"))
    top = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(F.desc("n"), "code"))).filter(F.col("rank") <= profile)
    found: dict[int, dict[str, list[tuple[int, int]]]] = {}
    for r in top.collect():  # at most `profile` rows for each language and part
        found.setdefault(r["part"], {}).setdefault(r["lang"], []).append((r["rank"], r["code"]))
    return {part: Profiles({k: [c for _, c in sorted(v)] for k, v in found.get(part, {}).items()}, profile) for part in (0, 1, WHOLE)}


def learn(docs: DataFrame, profile: int = PROFILE) -> Profiles:
    """Profiles from the text and lang of all labelled documents that aren't held out."""
    return _learned(docs, profile, F.array(F.lit(WHOLE)))[WHOLE]


def learn_with_halves(docs: DataFrame, profile: int = PROFILE) -> tuple[Profiles, tuple[Profiles, Profiles]]:
    """The same, and beside them the profiles of each half of those documents."""
    found = _learned(docs, profile, F.array("half", F.lit(WHOLE)))
    return found[WHOLE], (found[0], found[1])


def identify(docs: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row.

    lang_pred is a learned language, or `und` with score 0 where the text is null or has no letter, or
    nothing could be learned. Rows without an id aren't held out. Repeated rows get a row each; an
    empty table gives none. Only doc_id and text are read for a prediction.
    """
    known = profiles or learn(docs)
    schema = arrow_schema({"doc_id": pa.int64(), "lang_pred": pa.string(), "score": pa.float64()})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(parts):
            got = [known.predict(t.decode("utf-8", "replace")) for t in bytes_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], schema=schema)

    out = in_batches(id_and_text(docs), run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _ranked_score(scores: DataFrame, share: float) -> float | None:
    """The score that all but less than `share` of the scores (0 to 1) reach; None if there are none.

    The driver sees how many scores are in each of RANGES ranges, then the different ones in a single range: as scores are
    fractions with denominators of at most the profiles' length squared, neither grows with the documents.
    """
    counted = written(scores.groupBy("score").agg(F.count(F.lit(1)).alias("n")), "language-scores")
    place = F.floor(F.col("score") * RANGES)
    sizes = sorted((r["place"], r["n"]) for r in counted.groupBy(place.alias("place")).agg(F.sum("n").alias("n")).collect())
    left, found = max(1, math.ceil(share * sum(n for _, n in sizes))), None
    for at, n in sizes:
        if n >= left:
            for r in sorted(counted.filter(place == at).collect()):
                left -= r["n"]
                if left <= 0:
                    found = r["score"]
                    break
            break
        left -= n
    discard(counted)
    return found


def least_score(docs: DataFrame, profiles: Profiles, halves: tuple[Profiles, Profiles] | None = None) -> float:
    """The least score of an accepted text, from all labelled documents that aren't held out; 0 where there are none.

    With halves, a document is scored by the profiles of the half that it isn't in, unless that half lacks its language.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(parts):
            got = []
            for lang, half, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch.column(2))):
                judge = halves[1 - half] if halves and lang in halves[1 - half].names else profiles
                got.append(judge.predict(text.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array([s for name, s in got if name != UNDETERMINED], pa.float64())], names=["score"])

    return NEAR * (_ranked_score(in_batches(_labelled(docs), run, "score double"), FAR) or 0.0)


def accepted(docs: DataFrame, profiles: Profiles | None = None, least: float | None = None) -> DataFrame:
    """The rows of docs in a learned language: those that are `und`, or further than `least` from every profile, go.

    Without labelled documents only texts that share no n-gram with a profile are too far. Null texts, empty ones and those without
    a letter go; repeated rows stay or go together; an empty table gives none. Other columns stay as they are.
    """
    halves = None
    if profiles is None and least is None:
        profiles, halves = learn_with_halves(docs)
    known = profiles or learn(docs)
    least = least_score(docs, known, halves) if least is None and "lang" in docs.columns else least or 0.0
    names = docs.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(parts):
            texts = bytes_of(batch.column(names.index("text")))
            got = [known.predict(t.decode("utf-8", "replace")) for t in texts]
            yield batch.filter(pa.array([name != UNDETERMINED and score > 0 and score >= least for name, score in got], pa.bool_()))

    return in_batches(docs, run, docs.schema)
