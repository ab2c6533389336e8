"""Nearest neighbours by randomly rotated one-bit codes.

Each vector is scaled to length 1 and turned by one random rotation; its code is the sign of every
coordinate, packed, with one correction scalar: the inner product of the turned vector with its own code
(taken as a unit vector). Divided by that scalar, the inner product of a turned query with a code estimates the
cosine without bias, with an error below EPSILON * sqrt((1 - s^2) / s^2 / (d - 1)), s being the scalar, but for rare
cases. A row goes on to the exact cosine of the original vectors, in doubles, where the
estimate plus that bound reaches the k-th best cosine that its query has so far.

`build` writes every vector with its code. `search` scans the index once per round of queries; a round's
queries (at most ROUND_BYTES) are broadcast, and a task keeps k hits per query, whatever its
share of the index. Hits of all tasks are merged by rank. Nothing is left out before the estimate, so hot directions
cost time, not results; equal vectors of a block are looked at once. Work grows with queries times rows, in blocks.

Vectors that are null, empty or zero, or hold null or non-finite values take no part, nor do rows without id.
Vectors are compared with those of their own length. Repeated ids are rows of their own: a query leaves out its own row
only. Equal scores are ranked by id. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.text import written

SEED = 20
EPSILON = 2.5
ROUND_BYTES = 16 << 20  # vectors of the queries that are searched at a time
BLOCK_ROWS = 16_384
FIRST_ROWS = 256  # of a task, before any cosine is known
TILE = 1 << 22  # estimates held at a time
RERANKED = 1 << 16  # pairs whose cosines are computed at a time


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random rotation of d dimensions, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng((seed, d)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def codes_of(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the turned vectors, and the inner product of each with its own code."""
    turned = unit @ turn
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def unpacked(codes: np.ndarray, d: int) -> np.ndarray:
    """Codes as unit vectors: plus or minus 1 / sqrt(d)."""
    return (np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))


def bound(scalar: np.ndarray, d: int) -> np.ndarray:
    """How far an estimate may be off."""
    return EPSILON * np.sqrt(np.maximum(1 - scalar**2, 0) / scalar**2 / max(d - 1, 1)) + 1e-6


def build(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The index, written: at (a number for the row), id, d, vector (4 or 8 bytes a value, as given), code, scalar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, turns = TaskContext.get().partitionId() << 40, {}
        for batch in batches:
            flat, d = batch.column("vector").flatten().to_numpy(zero_copy_only=False), batch.column("d").to_numpy()
            starts = np.cumsum(d) - d
            for size in np.unique(d).tolist():
                rows = np.flatnonzero(d == size)
                x = flat[starts[rows][:, None] + np.arange(size)]
                scaled, norm = leveled(x)
                if size not in turns:
                    turns[size] = rotation(size)
                code, scalar = codes_of(scaled / norm[:, None], turns[size])
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(at + np.arange(n)),
                        batch.column("id").take(pa.array(rows)),
                        pa.array(np.full(n, size, np.int32)),
                        pa.array([v.tobytes() for v in x], pa.binary()),
                        pa.array([c.tobytes() for c in code], pa.binary()),
                        pa.array(scalar),
                    ],
                    names=["at", "id", "d", "vector", "code", "scalar"],
                )
                at += n

    kind = "array<float>" if dict(vectors.dtypes)[vector_column] == "array<float>" else "array<double>"
    chosen = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast(kind).alias("vector"))
    sound = F.col("id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", _finite) & F.exists("vector", lambda v: v != 0)
    rows = chosen.where(sound).select("id", "vector", F.size("vector").alias("d"))
    return written(rows.mapInArrow(run, "at bigint, id bigint, d int, vector binary, code binary, scalar double"), "onebit")


def stored(vectors: list[bytes], d: int) -> np.ndarray:
    """Vectors of the index as doubles."""
    data = b"".join(vectors)
    return np.frombuffer(data, np.float32 if len(data) == 4 * d * len(vectors) else np.float64).reshape(-1, d).astype(np.float64)


def leveled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector times a power of two, which changes no bit of a cosine but keeps squares finite; and its length."""
    scaled = np.ldexp(x.astype(np.float64), -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return scaled, np.sqrt(np.einsum("ij,ij->i", scaled, scaled))


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


class Queries:
    """A round's queries of one length, and the best hits that a task has found for them."""

    def __init__(self, at: np.ndarray, x: np.ndarray, k: int):
        d = x.shape[1]
        self.at, self.k = at, k
        self.x, self.norm = leveled(x)
        self.turned = (self.x / self.norm[:, None] @ rotation(d)).astype(np.float32)
        n = len(at)
        self.scores, self.ids = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def add(self, at: np.ndarray, ids: np.ndarray, vectors: np.ndarray, code: np.ndarray, scalar: np.ndarray) -> None:
        """Look at more rows of the index."""
        d = vectors.shape[1]
        # equal vectors count once, with as many of their smallest ids as any query can need: k and its own row
        _, group = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * d))).ravel(), return_inverse=True)
        order = np.lexsort((at, ids, group))
        group = group[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        order, group = order[place <= self.k], group[place <= self.k]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        sizes = np.diff(np.append(first, len(group)))
        heads = order[first]
        x, norm = leveled(vectors[heads])
        estimator, off = unpacked(code[heads], d) / scalar[heads, None].astype(np.float32), bound(scalar[heads], d).astype(np.float32)
        low, step = 0, FIRST_ROWS
        while low < len(heads):
            high = min(len(heads), low + step)
            width = max(1, TILE // (high - low))
            for q in range(0, len(self.at), width):
                least = self.scores[q : q + width, -1].astype(np.float32)
                # in single precision, so a little below the k-th best
                mine, rows = np.nonzero(self.turned[q : q + width] @ estimator[low:high].T + off[low:high] >= (least - np.float32(1e-5))[:, None])
                for p in range(0, len(mine), RERANKED):
                    self._rerank(mine[p : p + RERANKED] + q, rows[p : p + RERANKED] + low, x, norm, first, sizes, order, at, ids)
            low, step = high, min(BLOCK_ROWS, step * 4)

    def _rerank(
        self, mine: np.ndarray, rows: np.ndarray, x: np.ndarray, norm: np.ndarray, first: np.ndarray, sizes: np.ndarray, order: np.ndarray, at: np.ndarray, ids: np.ndarray
    ) -> None:
        score = np.einsum("ij,ij->i", self.x[mine], x[rows]) / (self.norm[mine] * norm[rows])
        better = score >= self.scores[mine, -1]
        mine, rows, score = mine[better], rows[better], score[better]
        n = sizes[rows]
        member = order[np.repeat(first[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        mine, score = np.repeat(mine, n), np.repeat(score, n)
        other = at[member] != self.at[mine]
        mine, score, found = mine[other], score[other], ids[member[other]]
        if not len(mine):
            return
        own = np.unique(mine)
        held = self.scores[own] > -np.inf
        mine = np.concatenate([mine, np.repeat(own, held.sum(axis=1))])
        score, found = np.concatenate([score, self.scores[own][held]]), np.concatenate([found, self.ids[own][held]])
        by = np.lexsort((found, -score, mine))
        mine, score, found = mine[by], score[by], found[by]
        place = np.arange(len(mine)) - np.searchsorted(mine, mine)
        top = place < self.k
        self.scores[mine[top], place[top]], self.ids[mine[top], place[top]] = score[top], found[top]


def search(index: DataFrame, wanted: Column, k: int = 5, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """The k nearest other rows of each row of the index where `wanted` (a condition on id) holds: query_id, rank, vec_id, score."""
    spark = index.sparkSession
    asked = index.where(wanted)
    size = asked.agg(F.sum(F.octet_length("vector") + 32)).first()[0] or 0
    rounds = -(-size // round_bytes) or 1
    found = None
    for r in range(rounds):
        share = asked.where(F.pmod(F.xxhash64("at"), F.lit(rounds)) == r) if rounds > 1 else asked
        rows = share.select("at", "d", "vector").toArrow().combine_chunks()
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in sorted(set(rows["d"].to_pylist())):
            of = rows.filter(pc.equal(rows["d"], d))
            own[d] = of["at"].to_numpy(), stored(of["vector"].to_pylist(), d)
        told = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            states = {d: Queries(at, x, k) for d, (at, x) in told.value.items()}
            for batch in batches:
                sizes = batch.column("d").to_numpy()
                for d in set(sizes.tolist()) & states.keys():
                    part = batch.filter(pa.array(sizes == d))
                    at, ids, scalar = (part.column(c).to_numpy() for c in ("at", "id", "scalar"))
                    vectors = stored(part.column("vector").to_pylist(), d)
                    code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(-1, -(-d // 8))
                    for low in range(0, len(at), BLOCK_ROWS):
                        block = slice(low, low + BLOCK_ROWS)
                        states[d].add(at[block], ids[block], vectors[block], code[block], scalar[block])
            for s in states.values():
                held = s.scores > -np.inf
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(s.at, held.sum(axis=1))), pa.array(s.ids[held]), pa.array(s.scores[held])], names=["query", "vec_id", "score"]
                )

        hits = written(index.mapInArrow(run, "query bigint, vec_id bigint, score double"), "onebit-hits")
        told.destroy()
        found = hits if found is None else found.unionByName(hits)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ids = asked.select(F.col("at").alias("query"), F.col("id").alias("query_id"))
    return top.join(ids, "query").select("query_id", "rank", "vec_id", "score")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(build(vectors), F.col("id") % 50 == 0)
