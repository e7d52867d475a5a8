"""Nearest comparable rows within a class."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal, localcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from sabermill.operators.windows import top_k


def _distances(rows: DataFrame, key: str, position: str, vector: str) -> DataFrame:
    """(pos, player, comp, dist) of all pairs of one position, by Euclidean distance."""
    v = rows.select(F.col(key).alias("id"), F.col(position).alias("pos"), F.col(vector).cast("array<double>").alias("v"))
    a, b = v.alias("a"), v.alias("b")
    square = F.aggregate(F.zip_with("a.v", "b.v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = a.join(b, (F.col("a.pos") == F.col("b.pos")) & (F.col("a.id") != F.col("b.id")))
    return pairs.select("a.pos", F.col("a.id").alias("player"), F.col("b.id").alias("comp"), F.sqrt(square).alias("dist"))


#: Rows of a position that meet as many others at a time; pairs that are measured together.
BLOCK, PAIRS = 2048, 1 << 20


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero in the decimal form, as Spark rounds."""
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(x * 10.0**digits)
        part = x * 10.0**digits - whole
        out = np.where(np.isfinite(x), (whole + (part >= 0.5)) / 10.0**digits, x)
        near = np.isfinite(x) & ((np.abs(part - 0.5) < 1e-3) | (x > 1e8) | ~np.isfinite(part))
    for i in np.flatnonzero(near).tolist():
        with localcontext() as c:
            c.prec = 400
            out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _nearest(a: np.ndarray, b: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, distance): the ``k`` nearest of other ids by rounded distance, ties to smaller ids.

    A matrix product rules out what is farther than the k-th by more than its error; the rest is measured term by term, in the order that SQL adds.
    """
    found: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    step = max(1, PAIRS // max(len(b), 1))
    plain = all(np.isfinite(x).all() and np.abs(x).max(initial=0) < 1e100 for x in (a, b))
    square = (b * b).sum(axis=1) if plain else None
    for lo in range(0, len(a), step):
        x = a[lo : lo + step]
        near = own[lo : lo + step, None] != ids[None, :]
        if plain and len(b) > k:
            total = (x * x).sum(axis=1)[:, None] + square[None, :]
            rough, err = total - 2 * (x @ b.T), total.max(axis=1, initial=0) * (x.shape[1] + 8) * 1e-15
            rough[~near] = np.inf
            kth = np.sqrt(np.maximum(np.partition(rough, k - 1, axis=1)[:, k - 1], 0) + err)
            near &= rough <= ((kth + 1.1 * 10.0**-digits) ** 2 * (1 + 1e-12) + err)[:, None]
        i, j = np.nonzero(near)
        dist = np.empty(len(i))
        for at in range(0, len(i), PAIRS):
            p, q, acc = i[at : at + PAIRS], j[at : at + PAIRS], 0.0
            with np.errstate(invalid="ignore", over="ignore"):
                for d in range(x.shape[1]):
                    one = x[p, d] - b[q, d]
                    acc = acc + one * one
                dist[at : at + PAIRS] = np.sqrt(acc)
        order = np.lexsort((ids[j], _rounded(dist, digits), i))
        i, j, dist = i[order], j[order], dist[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        kept = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
        found.append((i[kept] + lo, j[kept], dist[kept]))
    return tuple(map(np.concatenate, zip(*found)))


def comps(rows: DataFrame, key: str, position: str, vector: str, k: int) -> DataFrame:
    """(player, comp, dist): the ``k`` nearest others of the same position by Euclidean distance, ties to smaller keys; last come others without a distance, as of null vectors, null components or other lengths.

    All pairs of a position are compared, block by block, so that blocks of one position lie in many tasks.
    """
    v = rows.select(F.col(key).alias("id"), F.col(position).alias("pos"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND pos IS NOT NULL")
    size = v.groupBy("pos").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = v.join(size, "pos").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asking = dealt.select("pos", F.col("block").alias("a"), every.alias("b"), "id", "v")
    asked = dealt.select(F.col("pos").alias("of"), every.alias("from"), F.col("block").alias("to"), F.col("id").alias("other"), F.col("v").alias("w"))

    def parted(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths (-1: a null within or instead), starts and values."""
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, start = lists.flatten(), np.cumsum(n) - n
        holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        bad = lists.is_null().to_numpy(zero_copy_only=False) | (holes[start + n] > holes[start])
        return np.where(bad, -1, n), start, flat.to_numpy(zero_copy_only=False).astype(float)

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        who = [left.column("id").combine_chunks(), right.column("other").combine_chunks()]
        coded = pa.concat_arrays(who).dictionary_encode()
        rank = np.empty(len(coded.dictionary), np.int64)
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
        codes = rank[coded.indices.to_numpy()]
        own, ids = codes[: len(who[0])], codes[len(who[0]) :]
        (n, start, flat), (m, begin, values) = (parted(x.combine_chunks()) for x in (left.column("v"), right.column("w")))
        out = []
        for d in np.unique(n).tolist():
            at, to = np.flatnonzero(n == d), np.flatnonzero((m == d) & (d >= 0))
            x, y = (z[s[r, None] + np.arange(max(d, 0))] for z, s, r in ((flat, start, at), (values, begin, to)))
            i, j, dist = _nearest(x, y, own[at], ids[to], k, 6)
            out.append((at[i], to[j], dist, np.zeros(len(i), bool)))
            rest = np.flatnonzero((m != d) | (d < 0))
            rest = rest[np.argsort(ids[rest], kind="stable")]
            for r in at.tolist() if len(rest) else ():
                j = rest[ids[rest] != own[r]][:k]
                out.append((np.full(len(j), r), j, np.zeros(len(j)), np.ones(len(j), bool)))
        i, j, dist, none = (np.concatenate(z) for z in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))
        return pa.table({"player": who[0].take(pa.array(i)), "comp": who[1].take(pa.array(j)), "dist": pa.array(dist, mask=none)})

    kind = v.schema["id"].dataType.simpleString()
    both = asking.groupBy("pos", "a", "b").cogroup(asked.groupBy("of", "from", "to")).applyInArrow(met, f"player {kind}, comp {kind}, dist double")
    return top_k(both.select("player", "comp", F.round("dist", 6).alias("dist")), ["player"], [F.col("dist").asc_nulls_last(), F.col("comp")], k)


def comps_within(rows: DataFrame, key: str, position: str, vector: str, least: int = 5, most: int = 20) -> DataFrame:
    """(player, comp, dist): the ``least`` nearest others of the same position and all others inside its radius, at most the ``most`` nearest, ties to smaller keys.

    A position's radius is the median of its players' distances to their ``least``-th nearest (or last) other. Candidates are bounded as in ``comps``.
    """
    order = Window.partitionBy("player").orderBy("dist", "comp")
    near = _distances(rows, key, position, vector).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(least, most))
    last = near.where(F.col("rank") <= least).groupBy("pos", "player").agg(F.max("dist").alias("last"))
    radius = last.groupBy("pos").agg(F.percentile("last", F.lit(0.5)).alias("radius"))
    kept = near.join(radius, "pos").where((F.col("rank") <= most) & ((F.col("rank") <= least) | (F.col("dist") <= F.col("radius"))))
    return kept.select("player", "comp", F.round("dist", 6).alias("dist"))
