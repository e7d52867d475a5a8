"""Mixture-controlled packing of documents into fixed windows.

Every source is a queue of tokens, its documents in input order. Deficit round-robin at token grain: in each window a queue earns
``window * share`` tokens of credit, is served the whole part of its credit and carries the rest into the next window. Served
counts are those of the Webster rule: after R tokens the R smallest of (c + 1/2) / share over all queues' tokens c have been served,
so the counts of a window are a pure function of its number, every partition can compute the credits that it starts with, and no queue
is ever more than about a token away from its share. A queue that runs dry leaves its share to the others.

Beyond ``QUEUES`` sources, the QUEUES ones with the most tokens are queues of their own. All others share one more queue, in which whole documents come by the share of their source that is
served by their middle: so each source progresses evenly there too, and is at most one document away from its share of that queue. Every piece keeps its true source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sabermill.llm.kernels import release
from sabermill.llm.shared import Scratch
from sabermill.llm.tokens import encoder, load_spec

#: Sources that are queues of their own at most, so that the table of totals stays bounded; the rest share a queue.
QUEUES = 1024
#: Cells (window or token, queue) of served counts that are worked out at a time.
CELLS = 1 << 20


class Mixture:
    """Served counts per window of queues with ``totals`` tokens and ``weights`` (default: their totals, so that all end together)."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray | None, window: int) -> None:
        self.totals = np.asarray(totals, np.int64)
        self.p = np.asarray(self.totals if weights is None else weights, np.float64)
        if (self.p[self.totals > 0] <= 0).any():
            raise ValueError("every queue with tokens needs a positive weight")
        self.window, self.sum = window, int(self.totals.sum())
        self.p = np.where(self.p > 0, self.p, 1.0)
        ends = self.totals / self.p  # the time at which each queue runs dry
        self.times = np.concatenate([[0.0], np.unique(ends)])
        self.fluid = np.array([np.minimum(self.totals, self.p * t).sum() for t in self.times])

    @property
    def windows(self) -> int:
        return -(-self.sum // self.window)

    def served(self, windows: np.ndarray) -> np.ndarray:
        """Tokens that each queue has given before each of ``windows``: an array (window, queue) whose rows sum to the tokens before it."""
        rank = np.clip(np.asarray(windows, np.int64) * self.window, 0, self.sum)
        time = np.interp(rank, self.fluid, self.times)[:, None]
        c = np.clip(np.floor(time * self.p + 0.5).astype(np.int64), 0, self.totals)
        for _ in range(2):  # the floor may be off by one
            c -= (c > 0) & ((c - 0.5) / self.p > time)
            c += (c < self.totals) & ((c + 0.5) / self.p <= time)
        short = rank - c.sum(axis=1)
        row = np.flatnonzero(short > 0)
        while len(row):
            k = np.argmin(np.where(c[row] < self.totals, (c[row] + 0.5) / self.p, np.inf), axis=1)
            c[row, k] += 1
            short[row] -= 1
            row = row[short[row] > 0]
        row, last = np.flatnonzero(short < 0), len(self.p) - 1
        while len(row):
            k = last - np.argmax(np.where(c[row] > 0, (c[row] - 0.5) / self.p, -np.inf)[:, ::-1], axis=1)
            c[row, k] -= 1
            short[row] += 1
            row = row[short[row] < 0]
        return c

    def rank(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Tokens of all queues that are served before each given token of a queue."""
        time = ((token + 0.5) / self.p[queue])[:, None]
        before = np.arange(len(self.p))[None, :] < queue[:, None]  # equal times go by queue
        c = np.clip(np.floor(time * self.p + 0.5).astype(np.int64), 0, self.totals)
        for _ in range(2):  # the floor may be off by one
            last, now = (c - 0.5) / self.p, (c + 0.5) / self.p
            c = c - ((c > 0) & ((last > time) | ((last == time) & ~before))) + ((c < self.totals) & ((now < time) | ((now == time) & before)))
        c[np.arange(len(queue)), queue] = token
        return c.sum(axis=1)

    def window_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        step = max(1, CELLS // len(self.p))
        found = [self.rank(queue[i : i + step], token[i : i + step]) // self.window for i in range(0, len(queue), step)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def starts(self, windows: np.ndarray, queue: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each (window, queue): the queue's first token there, and that token's place in the window (queues follow each other)."""
        step, first, place = max(1, CELLS // len(self.p)), [], []
        for i in range(0, len(windows), step):
            w, q = windows[i : i + step], queue[i : i + step]
            known = np.unique(np.concatenate([w, w + 1]))
            served = self.served(known)
            row = np.searchsorted(known, w)
            first.append(served[row, q])
            ahead = np.concatenate([np.zeros((len(known), 1), np.int64), np.cumsum(served, axis=1)], axis=1)  # tokens of the queues before
            place.append(ahead[np.searchsorted(known, w + 1), q] - ahead[row, q])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, place))

    def begins(self, windows: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """For each (window, queue): the queue's tokens served before it."""
        step, out = max(1, CELLS // len(self.p)), []
        for i in range(0, len(windows), step):
            known, row = np.unique(windows[i : i + step], return_inverse=True)
            out.append(self.served(known)[row, queue[i : i + step]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def cuts(self, queue: int, first: int, end: int) -> np.ndarray:
        """Tokens of a queue in first + 1 .. end - 1 with which a window begins: by windows or by tokens, whichever are fewer, so the work never exceeds the tokens given."""
        q = np.array([queue, queue])
        low, high = self.window_of(q, np.array([first, end - 1])).tolist()
        if low == high:
            return np.zeros(0, np.int64)
        step, out = max(1, CELLS // len(self.p)), []
        if high - low <= end - first:
            for w in range(low + 1, high + 1, step):
                out.append(np.unique(self.served(np.arange(w, min(w + step, high + 1)))[:, queue]))
            found = np.unique(np.concatenate(out))
            return found[(found > first) & (found < end)]
        was = low
        for t in range(first, end, step):
            token = np.arange(t, min(t + step, end))
            w = self.window_of(np.full(len(token), queue), token)
            out.append(token[np.diff(w, prepend=was) > 0])
            was = w[-1]
        return np.concatenate(out)


def tokenized(docs: DataFrame, spec: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, queue, pid, row, start, n, ids): per document its ids, its number in its partition, and its place in its source within it."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pid, at, row = encoder(shared.value).encode, TaskContext.get().partitionId(), {}, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [encode(t) + end if t else end for t in part.column(2).to_pylist()]
                lens, starts = [len(x) // 4 for x in ids], []
                for q, n in zip(part.column(1).to_pylist(), lens):
                    starts.append(at.get(q, 0))
                    at[q] = starts[-1] + n
                if (narrow := [np.frombuffer(x, "<u4") for x in ids]) and all(x.max() < 65536 for x in narrow):
                    ids = [x.astype("<u2").tobytes() for x in narrow]
                rows = pa.array(np.arange(row, row + len(ids)))
                row += len(ids)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([pid] * len(ids), pa.int32()), rows, pa.array(starts, pa.int64()), pa.array(lens, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "queue", "pid", "row", "start", "n", "ids"])
        release()

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("queue"), F.col(text_col).alias("text"))
    return cols.mapInArrow(run, "doc_id long, queue string, pid int, row long, start long, n long, ids binary")


def _places(tokens: DataFrame, rest: DataFrame, scratch: Scratch) -> DataFrame:
    """(pid, row, at): places in their common queue of the documents of the sources in ``rest`` (queue, pid, base, weight), by the share of their source served at their middle."""
    n = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.col("base") + F.col("start")
    timed = tokens.select("queue", "pid", "row", "start", "n").join(rest, ["queue", "pid"]).select(((at + F.col("n") / 2) / F.col("weight")).alias("time"), "queue", at.alias("at"), "pid", "row", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = np.asarray(batch.column(2))
            ends = before + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(size), part), pa.int32()), pa.array(ends - size), pa.array(size)], ["pid", "row", "part", "within", "n"])
            before = int(ends[-1]) if len(ends) else before

    ordered = timed.repartitionByRange(n, "time", "queue", "at").sortWithinPartitions("time", "queue", "at").select("pid", "row", "n")
    ranked = scratch.write(ordered.mapInArrow(run, "pid int, row long, part int, within long, n long"), "ranked")
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    bases = ranked.groupBy("part").agg(F.sum("n").alias("n")).select("part", base.alias("base"))
    return ranked.join(F.broadcast(bases), "part").select("pid", "row", (F.col("base") + F.col("within")).alias("at"))


def pack(docs: DataFrame, scratch: Scratch, window: int = 2048, weights: dict[str, float] | None = None, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: (doc_id, source, start, length, ids binary of little-endian u32, doc_tokens, sequence_id, offset).

    Each id of each document, its ``end_id`` included, lies in exactly one piece; all sequences but the last are full. ``weights``: target
    proportions by source (default: as in the data); a source that has documents and no positive weight there is a ValueError, one without documents is ignored. Null or empty text: the end id
    alone; null source: the queue named ''. Repeated rows and repeated ids are documents of their own; a null id is returned as null; an empty table gives no pieces; other columns are not read.
    Tokens are written once, as they come, and then only read: per partition and source one sum is shuffled, and the tokens themselves move only if those sums outgrow
    Spark's broadcast limit, or if there are more than QUEUES sources.
    """
    tokens = scratch.write(tokenized(docs, load_spec(tokenizer), end_id, id_col, text_col, source_col), "tokens")
    sums = scratch.write(tokens.groupBy("queue", "pid").agg(F.sum("n").alias("n")), "sums")
    totals = sums.groupBy("queue").agg(F.sum("n").alias("total"))
    if weights is not None:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items() if v is not None], "queue string, weight double")
        totals = totals.join(F.broadcast(given), "queue", "left")
        if (bad := totals.where("NOT coalesce(weight > 0, false)").first()) is not None:
            raise ValueError(f"the source {bad['queue']!r} needs a positive weight")
    else:
        totals = totals.withColumn("weight", F.col("total").cast("double"))
    largest = totals.orderBy(F.desc("total"), "queue").limit(QUEUES).collect()
    large = sorted((r["queue"], r["total"], r["weight"]) for r in largest)
    base = F.sum("n").over(Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("queue", "pid", F.coalesce(base, F.lit(0)).alias("base"))
    queues = [(n, w) for _, n, w in large]
    rank = {q: i for i, (q, _, _) in enumerate(large)}
    own = docs.sparkSession.createDataFrame([(q,) for q in rank], "queue string")
    rest = totals.join(F.broadcast(own), "queue", "left_anti") if len(large) == QUEUES else None
    more = rest.agg(F.sum("total"), F.sum("weight")).first() if rest is not None else (None, None)
    if more[0] is None:
        placed = tokens.join(bases, ["queue", "pid"]).select("doc_id", "queue", (F.col("base") + F.col("start")).alias("at"), "n", "ids")
    else:
        queues.append((more[0], more[1]))
        direct = tokens.join(bases.join(F.broadcast(own), "queue", "left_semi"), ["queue", "pid"]).select("doc_id", "queue", (F.col("base") + F.col("start")).alias("at"), "n", "ids")
        common = _places(tokens, bases.join(rest.select("queue", "weight"), "queue"), scratch)
        placed = direct.union(tokens.join(common, ["pid", "row"]).select("doc_id", "queue", "at", "n", "ids"))
    mixture = Mixture(np.array([n for n, _ in queues], np.int64), np.array([w for _, w in queues], np.float64), window) if queues else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                if len(part := batch.slice(lo, 512)):
                    yield from _pieces(part, mixture, rank)

    return placed.mapInArrow(run, "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


#: Pieces of long documents are handed on in batches of about so many.
PIECES = 20_000


def _pieces(batch: pa.RecordBatch, mixture: Mixture, rank: dict[str, int]) -> Iterator[pa.RecordBatch]:
    queue = np.array([rank.get(q, len(rank)) for q in batch.column(1).to_pylist()])
    at, n = np.asarray(batch.column(2)), np.asarray(batch.column(3))
    end = at + n
    split = mixture.window_of(np.concatenate([queue, queue]), np.concatenate([at, end - 1])).reshape(2, -1)
    raw = batch.column(4)

    def out(row: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        size = np.where(np.append(row[1:] != row[:-1], True), end[row], np.append(first[1:], 0)) - first
        w = mixture.window_of(queue[row], first)
        begin, place = mixture.starts(w, queue[row])
        start, last, ids, wide = first - at[row], -1, [], b""
        for i, s, k in zip(row.tolist(), start.tolist(), size.tolist()):
            if i != last:
                wide, last = _wide(raw[i].as_py(), int(n[i])), i
            ids.append(wide[4 * s : 4 * (s + k)])
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(start), pa.array(size), pa.array(ids, pa.binary()), batch.column(3).take(take), pa.array(w), pa.array(place + first - begin)],
            ["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    # documents that span few windows have their cuts worked out together; the windows of the others outnumber their tokens
    spans = split[1] - split[0]
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(np.minimum(spans[lo:], n[lo:])), PIECES, "right")) + lo)
        few = np.flatnonzero(spans[lo:hi] <= n[lo:hi]) + lo
        row = np.repeat(few, spans[few])
        w = np.arange(len(row)) - np.repeat(np.cumsum(spans[few]) - spans[few], spans[few]) + split[0][row] + 1
        token = mixture.begins(w, queue[row])
        on = (token > at[row]) & (token < end[row])
        rows, tokens = [np.arange(lo, hi), row[on]], [at[lo:hi], token[on]]
        for i in (np.flatnonzero(spans[lo:hi] > n[lo:hi]) + lo).tolist():
            tokens.append(mixture.cuts(int(queue[i]), int(at[i]), int(end[i])))
            rows.append(np.full(len(tokens[-1]), i))
        row, first = np.concatenate(rows), np.concatenate(tokens)
        order = np.lexsort((first, row))
        row, first = row[order], first[order]
        new = np.append(True, (row[1:] != row[:-1]) | (first[1:] != first[:-1]))  # a window without a token of the queue begins where the next one does
        yield out(row[new], first[new])
        lo = hi


def _wide(ids: bytes, n: int) -> bytes:
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if len(ids) == 2 * n else ids


def sequences(pieces: DataFrame, end_id: int = 1, window: int = 2048) -> DataFrame:
    """(sequence_id, ids array<int>, documents): the packed windows, the last one padded with ``end_id``; a window has at most ``window`` pieces."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table["offset"].combine_chunks()), kind="stable")
        ids = np.frombuffer(b"".join(table["ids"].take(pa.array(order)).to_pylist()), "<u4").astype(np.int32)
        ids = np.concatenate([ids, np.full(window - len(ids), end_id, np.int32)])
        return pa.table({"sequence_id": table["sequence_id"].slice(0, 1), "ids": pa.array([ids.tolist()], pa.list_(pa.int32())), "documents": [len(order)]})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(run, "sequence_id long, ids array<int>, documents long")
