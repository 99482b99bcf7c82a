"""Exact top-k search by inner product: runs sorted by norm, rotated partial sums, residual bounds.

Vectors are integers. One pass sums their outer products; its eigenvectors (the right singular vectors
of the table) rotate the coordinates so that the first few hold most of the length. Vectors are range-partitioned by descending norm
and cut into runs, which keep the first rotated coordinates of each vector and the length of the rest beside it.

Blocks of queries go through the runs in tiers, each GROWTH times as many runs as the one before, of smaller norms. Each query
holds the score that its k best so far reach. A block of queries that no product of norms can improve any more drops out;
within a run, read block by block, a vector is looked at only where the partial sum plus the product of the residual
lengths (Cauchy-Schwarz) can reach that score, which rises from block to block and from tier to tier. What is
left is scored exactly in integers. A run returns a query's k best at most.

The query set is stated, so query blocks meet runs; both are of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from .common import discard, written

TOP, SCALE = 20, 64
#: Vectors of a run, blocks that it is read in, queries of a block; runs of a tier for one of the tier before.
RUN, RUN_BLOCKS, QUERY_BLOCK, GROWTH = 16_384, 8, 256, 8
#: Blocks of queries that meet the same copy of a run.
HAND = 2
#: Share of the length that the first rotated coordinates hold.
HEAD = 0.7
#: For the rounding of the bounds, which are floating-point.
SLACK = 1e-6
_INT_LIMIT = 2**62
_FLOOR = -(2**63)


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the floors of scale times each component, without rows that hold no finite vector.

    A component that leaves the range of a long is an error: no score of it could be exact.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), whole.alias("whole")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.col("whole"))
    held = lambda c: F.when(F.abs(c * scale) < float(_INT_LIMIT), F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large for an integer score")).cast("long"))
    return rows.select("vec_id", F.transform("x", held).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows, shorter ones filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Eigenvectors of the sum of outer products, and how many hold HEAD of the squared length."""
    schema = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in parts:
            m = _matrix(batch.column(0), width).astype(np.float64)
            m /= np.maximum(np.linalg.norm(m, axis=1), 1)[:, None]  # directions: no vector outweighs the rest
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], schema=schema)

    sums = vectors.select("v").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s"))
    m = np.zeros((width, width))
    for r in sums.collect():  # width * width numbers
        m[r["i"], r["j"]] = r["s"]
    m = np.nan_to_num((m + m.T) / 2)
    values, v = np.linalg.eigh(m)
    order = np.argsort(-values)
    held = np.cumsum(np.maximum(values[order], 0))
    head = int(np.searchsorted(held, HEAD * held[-1]) + 1) if held[-1] > 0 else width
    return v[:, order], min(head, width)


def _packed(m: np.ndarray) -> tuple[int, bytes]:
    """Integers in the smallest width that holds them, and that width."""
    most = int(np.abs(m).max(initial=0))
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return width, m.astype(f"<i{width}").tobytes()


def _unpacked(data: bytes, width: int, columns: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(-1, columns).astype(np.int64)


_RUN_DDL = "norm double, n int, ids binary, width int, data binary, head binary, rest binary"


def runs(vectors: DataFrame, columns: int, size: int, parts: int, v: np.ndarray, head: int) -> DataFrame:
    """Runs of at most `size` vectors by descending norm: number (from 0), norm (the longest), ids, data, and the rotated head and rest of each."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    rows = vectors.select("vec_id", "v", norm.alias("norm"), F.monotonically_increasing_id().alias("row")).repartitionByRange(parts, F.desc("norm"), F.col("vec_id"), F.col("row")).sortWithinPartitions(F.desc("norm"), "vec_id", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                b = batch.slice(at, size)
                m = _matrix(b.column(1), columns)
                width, data = _packed(m)
                turned = m @ v
                row = (math.sqrt(b.column(2)[0].as_py()), b.num_rows, b.column(0).to_numpy().astype("<i8").tobytes(), width, data, turned[:, :head].astype("<f8").tobytes(), np.sqrt((turned[:, head:] ** 2).sum(axis=1)).astype("<f8").tobytes())
                types = (pa.float64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=["norm", "n", "ids", "width", "data", "head", "rest"])

    made = rows.select("vec_id", "v", "norm").mapInArrow(run, _RUN_DDL).withColumn("place", F.monotonically_increasing_id())
    held = written(made, "runs")
    # places follow the order by norm, with gaps between partitions; only they are sorted to be numbered
    order = held.select(F.col("place").alias("p")).orderBy("p").select(InternalFunction.distributed_sequence_id().alias("number"), "p")
    return held.join(order, F.col("place") == F.col("p")).drop("place", "p")


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; one that leaves 64 bits is an error."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < _INT_LIMIT:
        return np.einsum("ij,ij->i", q, c)
    full = [sum(int(x) * int(y) for x, y in zip(a, b)) for a, b in zip(q, c)]
    if any(not _FLOOR < s < 2**63 for s in full):
        raise OverflowError("a score leaves the range of a long")
    return np.array(full, dtype=np.int64)


class Queries:
    """A block of queries, what each has found so far in a run, and the score that it has to reach."""

    def __init__(self, ids, q, head, rest, least, top: int):
        self.ids, self.q, self.head, self.rest, self.least, self.top = ids, q, head, rest, least.copy(), top
        self.length = np.sqrt((head**2).sum(axis=1) + rest**2)
        self.at, self.found, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def meet(self, ids, c, head, rest) -> None:
        """Take what a block of vectors has to offer, and raise the scores to reach."""
        scale = self.length.max(initial=0) * math.sqrt(float(((head**2).sum(axis=1) + rest**2).max(initial=0)))
        bound = self.head @ head.T + self.rest[:, None] * rest[None, :] + SLACK * (scale + 1)
        a, b = np.nonzero((bound >= self.least[:, None]) & (self.ids[:, None] != ids[None, :]))
        parts = [_exact(self.q[a[i : i + 262144]], c[b[i : i + 262144]]) for i in range(0, len(a), 262144)]
        score = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        good = score >= self.least[a]
        at, found, score = np.r_[self.at, a[good]], np.r_[self.found, ids[b[good]]], np.r_[self.score, score[good]]
        order = np.lexsort((found, -score, at))
        at, found, score = at[order], found[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
        kept = place < self.top
        self.at, self.found, self.score = at[kept], found[kept], score[kept]
        full = place[kept] == self.top - 1
        self.least[self.at[full]] = np.maximum(self.least[self.at[full]], self.score[full])


def _stop(length: np.ndarray, least: np.ndarray) -> float:
    """The norm below which no vector can reach the score of any of the queries."""
    with np.errstate(divide="ignore", invalid="ignore"):
        norm = (least.astype(np.float64) - 1) / (length * (1 + SLACK))
    return float(np.where(length > 0, norm, np.where(least <= 1, -np.inf, np.inf)).min(initial=np.inf))


_TOP_DDL = "q_block long, q int, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, block: int = RUN, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k highest inner products, ties to the smaller vec_id.

    vectors and queries hold (vec_id, v), as `integer_vectors` makes them. A query's own row isn't its
    candidate. Shorter vectors count as filled up with zeros. Fewer candidates give fewer rows; no
    queries or no vectors give none. Of a repeated vec_id each row is a candidate, and a query whose candidates
    are ranked with those of the id's other rows; no row of the id is a candidate of it.
    """
    spark = vectors.sparkSession
    vectors = written(vectors.select("vec_id", "v"), "vectors")
    queries = written(queries.select("vec_id", "v"), "queries")
    stats = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    asked = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not stats["n"] or not asked["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    columns = max(1, stats["width"], asked["width"])
    v, head = rotation(vectors, columns)
    held = written(runs(vectors, columns, block, max(1, math.ceil(stats["n"] / block)), v, head), "runs")
    wanted = runs(queries, columns, query_block, max(1, math.ceil(asked["n"] / query_block)), v, head).withColumnRenamed("number", "q_block").drop("norm", "n")
    n_runs = held.count()
    each = Window.partitionBy("q_block", "q").orderBy(F.desc("score"), "vec_id")
    state_ddl = "q_block long, ids binary, width int, data binary, head binary, rest binary, least binary, stop double"

    def begin(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            n = [len(x) // 8 for x in batch.column("ids").to_pylist()]
            least = pa.array([np.full(m, _FLOOR, np.int64).tobytes() for m in n], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q_block", "ids", "width", "data", "head", "rest")), least, pa.array([-math.inf] * len(n))], names=["q_block", "ids", "width", "data", "head", "rest", "least", "stop"])

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                floats = lambda c, shape: np.frombuffer(r[c], "<f8").reshape(shape)  # noqa: B023, E731
                ids = np.frombuffer(r["ids"], np.int64)
                some = Queries(ids, _unpacked(r["data"], r["width"], columns), floats("head", (len(ids), head)), floats("rest", -1), np.frombuffer(r["least"], np.int64), k)
                c_ids, c = np.frombuffer(r["c_ids"], np.int64), _unpacked(r["c_data"], r["c_width"], columns)
                c_head, c_rest = floats("c_head", (len(c_ids), head)), floats("c_rest", -1)
                step = max(1, -(-len(c_ids) // RUN_BLOCKS))
                for at in range(0, len(c_ids), step):
                    part = slice(at, at + step)
                    if _stop(some.length, some.least) > math.sqrt(float((c_head[at] ** 2).sum() + c_rest[at] ** 2)) * (1 + SLACK) + SLACK:
                        break  # the longest of the rest
                    some.meet(c_ids[part], c[part], c_head[part], c_rest[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some.at), r["q_block"]), pa.int64()), pa.array(some.at.astype(np.int32)), pa.array(some.ids[some.at], pa.int64()), pa.array(some.found), pa.array(some.score)], names=["q_block", "q", "query_id", "vec_id", "score"])

    def rise(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["q_block", "ids", "width", "data", "head", "rest"]
        for batch in parts:
            leasts, stops = [], []
            for ids, rest, first, old, reached in zip(*[batch.column(c).to_pylist() for c in ("ids", "rest", "head", "least", "reached")]):
                least = np.frombuffer(old, np.int64).copy()
                for x in reached or []:
                    least[x["q"]] = max(int(least[x["q"]]), x["score"])
                length = np.sqrt((np.frombuffer(first, "<f8").reshape(len(least), -1) ** 2).sum(axis=1) + np.frombuffer(rest, "<f8") ** 2)
                leasts.append(least.tobytes())
                stops.append(_stop(length, least))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(leasts, pa.binary()), pa.array(stops, pa.float64())], names=[*names, "least", "stop"])

    state = written(wanted.mapInArrow(begin, state_ddl), "queries")
    top, first, size = None, 0, 1
    while first < n_runs:
        last = min(n_runs, first + size) - 1
        longest = held.filter(F.col("number") == first).select("norm").first()[0]
        live = state.filter(F.col("stop") <= longest * (1 + SLACK) + SLACK)
        tier = held.filter(F.col("number").between(first, last)).select("number", F.col("ids").alias("c_ids"), F.col("width").alias("c_width"), F.col("data").alias("c_data"), F.col("head").alias("c_head"), F.col("rest").alias("c_rest"))
        # every block of queries asks for each run: a run is handed out once for so many of them
        hands = max(1, -(-live.count() // HAND))
        pairs = live.select("q_block", F.pmod("q_block", F.lit(hands)).alias("hand"), F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("number"))
        tier = tier.withColumn("hand", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hands - 1).cast("long"))))
        work = pairs.join(live.drop("stop"), "q_block").join(tier, ["number", "hand"]).drop("number", "hand")
        found = work.mapInArrow(meet, _TOP_DDL)
        best = found if top is None else found.unionByName(top)
        best = written(best.withColumn("place", F.row_number().over(each)).filter(F.col("place") <= k).select("q_block", "q", "query_id", "vec_id", "score"), "top")
        if top is not None:
            discard(top)
        top, first, size = best, last + 1, size * GROWTH
        if first < n_runs:
            full = top.groupBy("q_block", "q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).filter(F.col("n") == k)
            reached = full.groupBy("q_block").agg(F.collect_list(F.struct("q", "score")).alias("reached"))  # one for each query of a block
            after = written(live.join(reached, "q_block", "left").mapInArrow(rise, state_ddl), "queries")
            discard(state)
            state = after
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return top.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
