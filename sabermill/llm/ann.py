"""Approximate nearest neighbours by collision counting (query-aware hashing).

Each of ``PROJECTIONS`` random directions gives one sorted array of projections. A query opens a window around its own projection in every array; a vector collides once for each
window that holds it. Virtual rehashing widens all windows by the same factor, adding only the new margins, until enough vectors have collided in at least ``THRESHOLD`` of the arrays;
those vectors are verified by their exact inner product. Inner products become distances by one more component, sqrt(M^2 - |x|^2) with M the largest norm, which is 0 for queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sabermill.llm.kernels import release

PROJECTIONS, THRESHOLD = 96, 0.5
#: Windows are first as wide as START of a block's middle, and grow by WIDEN until at least VERIFY times k vectors and SHARE of the block passed the threshold.
START, WIDEN, VERIFY, SHARE = 0.4, 1.2, 8, 0.2
#: Queries that widen their windows together.
BATCH = 128
#: Rows of a block of vectors, and of a block of queries; smaller inputs get SPREAD blocks at least if they have SMALL rows each.
BLOCK, QUERIES, SMALL, SPREAD = 65_536, 2_048, 8_192, 8


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors without null or non-finite components that are not null, empty or zero."""
    cast = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return cast.where("id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")


class Index:
    """The sorted arrays of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, power: int = 0, query_power: int = 0, seed: int = 7) -> None:
        self.ids, self.vectors, self.query_power = ids, vectors, query_power
        small = np.ldexp(vectors, -power)
        norm2 = (small * small).sum(axis=1)
        largest = math.sqrt(norm2.max()) if len(norm2) else 0.0
        self.length = largest
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        lifted = np.hstack([small, np.sqrt(np.maximum(largest**2 - norm2, 0))[:, None]])
        projected = lifted @ self.directions
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(projected, self.order.T, axis=0).T.copy()
        n = len(ids)
        a, b = int(n * (1 - START) / 2), min(n - 1, int(n * (1 + START) / 2))
        self.half = max(float(np.median(self.sorted[:, b] - self.sorted[:, a])) / 2, 1e-9)

    def windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (query, array) of the windows of width 2 half around the queries' projections."""
        both = [[np.searchsorted(self.sorted[j], at[:, j] + side, where) for j in range(PROJECTIONS)] for side, where in ((-half, "left"), (half, "right"))]
        return np.array(both[0]).T, np.array(both[1]).T

    def candidates(self, queries: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """For each query the rows that collide with it in enough arrays, under the narrowest windows for which there are enough rows."""
        n, need = len(self.ids), int(np.ceil(THRESHOLD * PROJECTIONS))
        enough = min(n, max(VERIFY * k, int(SHARE * n)))
        for first in range(0, len(queries), BATCH):
            some = np.ldexp(queries[first : first + BATCH], -self.query_power)
            length = np.sqrt((some * some).sum(axis=1, keepdims=True))
            at = some / np.where(length > 0, length, 1) * self.length @ self.directions[:-1]
            passed: list = [None] * len(at)
            counts = np.zeros((len(at), n), np.int16)
            left, half, low, high = np.arange(len(at)), self.half, None, None
            while len(left):
                lo, hi = self.windows(at[left], half)
                still = np.zeros(len(left), bool)
                for x, i in enumerate(left):
                    if low is None:
                        new = [self.order[j, a:b] for j, (a, b) in enumerate(zip(lo[x], hi[x]))]
                    else:
                        new = [self.order[j, a:b] for j in range(PROJECTIONS) for a, b in ((lo[x, j], low[x, j]), (high[x, j], hi[x, j]))]
                    counts[i] += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
                    found = np.flatnonzero(counts[i] >= need)
                    if len(found) >= enough or (not lo[x].any() and (hi[x] == n).all()):
                        passed[i] = found
                    else:
                        still[x] = True
                left, low, high, half = left[still], lo[still], hi[still], half * WIDEN
            yield from passed

    def nearest(self, query_ids: list[int], queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, inner products) of each query's best verified candidates, ties to smaller ids."""
        for query_id, query, rows in zip(query_ids, queries, self.candidates(queries, k + 1)):
            rows = rows[self.ids[rows] != query_id]
            with np.errstate(over="ignore", invalid="ignore"):
                score = (self.vectors[rows] * query).sum(axis=1)
            score = np.where(np.isnan(score), -np.inf, score)
            if len(rows) > 4 * k:
                near = np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[score >= near], score[score >= near]
            best = np.lexsort((self.ids[rows], -score))[:k]
            yield self.ids[rows[best]], score[best]


def _scale(vectors: DataFrame) -> int:
    """The exponent of the largest component: components divided by its power of two are at most 1, and exact as long as they are normal numbers."""
    top = vectors.agg(F.max(F.expr("array_max(transform(v, x -> abs(x)))"))).first()[0]
    return math.frexp(top)[1] if top else 0


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest vectors found by inner product, its own id excepted; ties to smaller ids.

    Vectors and queries that are null, zero, or hold null or non-finite components take no part, nor do those whose length is not the most frequent one. Rows that share an
    id count as one, by the least of their vectors in the order of arrays, as vectors and as queries. Empty tables give no rows. Projections are made from vectors scaled by a power of two,
    so that no finite component overflows there; scores are of the original vectors, and where those overflow, infinite ones tie and undefined ones come last (as minus infinity).
    Every row is in one block's index, which is built once; queries stream past it and each block returns their ``k`` best, so no task holds more than BLOCK vectors and a batch of queries.
    """
    base, asked = usable(vectors, id_col, vector_col), usable(queries, query_id_col, vector_col)
    sizes = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes["d"], sizes["n"]
    base, asked = base.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-n // BLOCK), min(SPREAD, -(-n // SMALL)))
    groups = max(1, min(-(-parts // blocks), -(-asked.count() // QUERIES)))  # with few blocks, queries are dealt out too
    base_power, query_power = _scale(base), _scale(asked)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.asarray(batch.column(4).flatten()).reshape(-1, dim)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, group, is query, id, v) in that order: a block's vectors, then the queries that it is asked."""
        now, ids, held, index, last = None, [], [], None, None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)], axis=1)
            cut = np.flatnonzero((np.diff(key[:, :3], axis=0) != 0).any(axis=1)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)]):
                if a == b:
                    continue
                part, own = batch.slice(a, b - a), key[a:b, 3]
                if tuple(key[a, :2]) != now:
                    now, ids, held, index, last = tuple(key[a, :2]), [], [], None, None
                if key[a, 2] and index is None and ids:
                    index, last = Index(np.concatenate(ids), np.concatenate(held), base_power, query_power), None
                new = np.append(last is None or own[0] != last, own[1:] != own[:-1])  # rows that share an id follow each other
                last = own[-1]
                if not key[a, 2]:
                    ids.append(own[new])
                    held.append(matrix(part)[new])
                elif index is not None and new.any():
                    asks, found = own[new], list(index.nearest(own[new].tolist(), matrix(part)[new], k))
                    cols = [np.repeat(asks, [len(x) for x, _ in found]), np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2])], ["query_id", "vec_id", "score"])
        release()

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long")
    left = base.select(block.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(0).alias("kind"), "id", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.pmod(F.hash("id"), F.lit(groups)).alias("g"), F.lit(1).alias("kind"), "id", "v")
    met = left.union(right).repartition(max(parts, min(blocks * groups, 100_000)), "b", "g").sortWithinPartitions("b", "g", "kind", "id", "v")
    found = met.mapInArrow(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(f"rank <= {k}")
