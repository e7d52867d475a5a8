"""Group-local searches and simulations: each game, slate or run is one bounded group, so groups run in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


#: Combinations that a task grows at a time, and legs of games that it takes up together.
GROWN, LEGS = 1 << 18, 1 << 16


def _cut(level: tuple[np.ndarray, ...], beam: int) -> tuple[np.ndarray, ...]:
    """The ``beam`` best combinations of each game by prob * payout, ties to smaller places, in that order."""
    game, combo, prob, payout = level
    order = np.lexsort((*combo.T[::-1], -(prob * payout), game))
    own = game[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    order = order[np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own)))) < beam]
    return tuple(x[order] for x in level)


def _grow(level: tuple[np.ndarray, ...], ends: np.ndarray, who: np.ndarray, p: np.ndarray, b: np.ndarray, beam: int) -> tuple[np.ndarray, ...]:
    """Each combination, game by game, with each later leg of its game whose player it lacks; games of more than ``beam`` of these are cut."""
    game, combo, prob, payout = level
    more = ends[game] - combo[:, -1] - 1
    upto, parts, lo = np.cumsum(more), [], 0
    while lo < len(game):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + GROWN, "right")))
        n = more[lo:hi]
        at = np.repeat(np.arange(lo, hi), n)
        leg = combo[at, -1] + 1 + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        fits = (who[combo[at]] != who[leg][:, None]).all(axis=1)
        at, leg = at[fits], leg[fits]
        grown = game[at], np.column_stack((combo[at], leg)), prob[at] * p[leg], payout[at] * b[leg]
        if parts:  # the last game may go on
            grown = tuple(map(np.concatenate, zip(parts.pop(), grown)))
        if len(grown[0]) > beam and np.bincount(grown[0] - grown[0][0]).max() > beam:
            grown = _cut(grown, beam)
        last = int(np.searchsorted(grown[0], game[hi - 1]))
        parts += [tuple(x[:last] for x in grown), tuple(x[last:] for x in grown)]
        lo = hi
    return tuple(map(np.concatenate, zip(*parts))) if parts else (game, np.empty((0, combo.shape[1] + 1), np.int64), prob, payout)


def beam_search(legs: DataFrame, game: str, leg: str, player: str, prob: str, boost: str, size: int = 3, beam: int = 1000, least: float = 1.05) -> DataFrame:
    """(game, legs array<long>, prob, payout, ev): combinations of ``size`` legs of different players, grown level by level with the ``beam`` best kept.

    A game is one row with all its legs, and a task searches many games at a time. A null player is the same as no other; a combination without an ev is left out.
    """
    one = F.struct(F.col(leg).cast("long").alias("leg"), F.col(player).alias("player"), F.col(prob).cast("double").alias("prob"), F.col(boost).cast("double").alias("boost"))
    games = legs.groupBy(F.col(game).cast("long").alias("game")).agg(F.collect_list(one).alias("legs"))

    def found(names: pa.Array, n: np.ndarray, flat: pa.StructArray) -> pa.RecordBatch:
        own, given = np.repeat(np.arange(len(n)), n), flat.field("leg")
        order = np.lexsort((given.fill_null(np.iinfo(np.int64).max).to_numpy(), own))
        flat = flat.take(pa.array(order))
        ids, coded = flat.field("leg"), flat.field("player").dictionary_encode().indices
        p, b = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("prob", "boost"))
        who = np.where(coded.is_null().to_numpy(zero_copy_only=False), -1 - np.arange(len(own)), coded.fill_null(0).to_numpy())
        level = own, np.arange(len(own))[:, None], p, b
        for _ in range(size - 1):
            level = _grow(level, np.cumsum(n), who, p, b, beam)
        kept = level[2] * level[3] >= least
        at, combo, x, y = _cut(tuple(c[kept] for c in level), beam if size > 1 else len(own) + 1)
        taken = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * size, pa.int32()), ids.take(pa.array(combo.ravel())))
        return pa.RecordBatch.from_arrays([names.take(pa.array(at)), taken, pa.array(x), pa.array(y), pa.array(x * y)], ["game", "legs", "prob", "payout", "ev"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lists = batch.column(0), batch.column(1)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat, start, lo = lists.flatten(), np.concatenate([[0], np.cumsum(n)]), 0
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(start, start[lo] + LEGS, "right")) - 1)
                yield found(names.slice(lo, hi - lo), n[lo:hi], flat.slice(start[lo], start[hi] - start[lo]))
                lo = hi

    return games.mapInArrow(run, "game long, legs array<bigint>, prob double, payout double, ev double")


def ranked_greedy(entries: DataFrame, slate: str, key: str, legs: str, value: str, shared: int = 1, top: int = 10) -> DataFrame:
    """Per slate: entries by falling value, skipping those that share more than ``shared`` legs with one kept, up to ``top``."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for r in table.sort_values([value, key], ascending=[False, True]).itertuples():
            own = set(getattr(r, legs))
            if all(len(own & other) <= shared for *_, other in kept):
                kept.append((getattr(r, slate), getattr(r, key), len(kept) + 1, own))
            if len(kept) == top:
                break
        return pd.DataFrame([x[:3] for x in kept], columns=["slate", "entry", "rank"])

    return entries.groupBy(slate).applyInPandas(run, "slate long, entry long, rank int")


def joint_kelly(bets: DataFrame, slate: str, key: str, prob: str, payout: str, budget: float = 0.25, cap: float = 0.05) -> DataFrame:
    """Fractions that maximise the sum of expected log growth under a joint budget and a cap per bet: one multiplier by bisection."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        p, b = table[prob].to_numpy(float), table[payout].to_numpy(float)

        def fractions(m: float) -> np.ndarray:
            lo, hi = np.zeros(len(p)), np.full(len(p), cap)
            for _ in range(50):
                f = (lo + hi) / 2
                up = p * b / (1 + f * b) - (1 - p) / (1 - f) > m
                lo, hi = np.where(up, f, lo), np.where(up, hi, f)
            return lo

        lo, hi = 0.0, float(np.max(p * b, initial=0)) + 1
        if fractions(0.0).sum() > budget:
            for _ in range(50):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if fractions(mid).sum() > budget else (lo, mid)
            lo = hi
        return pd.DataFrame({"slate": table[slate], "bet": table[key], "fraction": fractions(lo)})

    return bets.groupBy(slate).applyInPandas(run, "slate long, bet long, fraction double")


def simulate(bets: DataFrame, run_col: str, day: str, prob: str, payout: str, stake: float = 0.02, start: float = 5000.0, seed: int = 11) -> DataFrame:
    """(run, day, bankroll): a bankroll that stakes a share of itself on each bet of a day in turn, with a seeded outcome per run."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        r, money, rows = int(table[run_col].iloc[0]), start, []
        rng = np.random.default_rng((seed, r))
        for d, own in table.sort_values([day, prob, payout]).groupby(day, sort=True):
            won = rng.random(len(own)) < own[prob].to_numpy(float)
            money += money * stake * float(np.where(won, own[payout].to_numpy(float), -1.0).sum())
            money = max(money, 0.0)
            rows.append((r, str(d), money))
        return pd.DataFrame(rows, columns=["run", "day", "bankroll"])

    return bets.groupBy(run_col).applyInPandas(run, "run long, day string, bankroll double")
