"""A Katz back-off bigram model over a whole corpus, and its log probability of every text.

Counts of up to TOP occurrences are discounted by Good-Turing; the mass so freed in a context goes to the words not seen there in proportion to their unigram probability, with back-off
weights that make every context sum to one exactly. At the unigram level the freed mass is the probability of the one unknown word. Contexts are the word before, or the start of the text.

Counts live in tables partitioned by key range: words by their hash, bigrams by their context. Each chunk of texts sends its distinct keys once to each table, and is answered
with what its tokens need: word counts and numbers, then bigram counts and each context's statistics. Contexts of over 1/HOT of all tokens are split over SPLIT parts by their second word, and
their statistics added up where they are used. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from sabermill.llm.chunks import bucket_count, chunked, cuts, read_chunk
from sabermill.llm.kernels import LOWER, SPACES, mix64, slices, squeeze, xxh64
from sabermill.llm.shared import Scratch

TOP, HOT, SPLIT = 5, 1024, 16
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: The hash that stands for the end of a text, and the number of the start as a context.
END, START = np.uint64(0), np.uint64(1 << 56)


def _send(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([np.ascontiguousarray(a) for a in arrays], protocol=5))


def _got(blob: bytes) -> list[np.ndarray]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers in the least unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def discounts(n: list[int]) -> np.ndarray:
    """d[r] for r = 0 .. TOP from the numbers n[r] of types seen r times, r up to TOP + 1; d[0] is unused."""
    d = np.ones(TOP + 1)
    cut = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        good = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        d[r] = good if 0 < good < 1 else (r - 0.5) / r
    return d


class Unigrams:
    """Discounted unigram probabilities from N and the counts of counts."""

    def __init__(self, total: int, n: list[int]) -> None:
        self.total, self.d = total, discounts(n)
        freed = sum((1 - self.d[r]) * r * n[r] for r in range(1, TOP + 1))
        self.scale = 1.0 if freed > 0 else total / (total + 1)
        self.unknown = freed / total if freed > 0 else 1 / (total + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        seen = self.scale * self.d[np.minimum(c, TOP) * (c <= TOP)] * c / max(self.total, 1)
        return np.where(c > 0, seen, self.unknown)


class _Tokens:
    """A chunk's tokens as positions in its sorted distinct hashes."""

    def __init__(self, blob: bytes, parts: int, held: int) -> None:
        ids, buf, offs = read_chunk(blob)
        self.ids = ids
        self.held = np.array([i is not None and zlib.crc32(str(i).encode()) % parts == held for i in ids.to_pylist()], bool)
        hashes, counts = [], []
        for a, b in slices(offs, 2 << 20):
            text, starts, ends, first, _ = squeeze(LOWER[buf[offs[a] : offs[b]]], offs[a : b + 1] - offs[a], SPACES)
            h = xxh64(text, starts, ends - starts)
            hashes.append(np.insert(np.where(h == END, np.uint64(1), h), first[1:], END))
            counts.append(np.diff(first) + 1)
        tokens = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.size = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.words, self.token = np.unique(tokens, return_inverse=True)
        self.train = np.repeat(~self.held, self.size)
        self.before = np.concatenate([[0], self.token[:-1]]) if len(tokens) else self.token
        self.before[self.first[:-1]] = len(self.words)

    def numbered(self, replies: list[tuple[int, bytes]], buckets: int) -> None:
        """Global numbers and training counts of the words."""
        at, self.count, self.number = cuts(self.words, buckets), np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.uint64)
        for b, blob in replies:
            rank, count = _got(blob)
            self.count[at[b] : at[b + 1]] = count
            self.number[at[b] : at[b + 1]] = rank.astype(np.uint64) * np.uint64(buckets) + np.uint64(b)

    def bigrams(self, buckets: int, total: int, texts: int) -> None:
        """Distinct (context, word) pairs, in the order bucket, context, word; hot contexts have a row in each of their parts."""
        n = len(self.words)
        pair, self.pair_of = np.unique(self.before * np.int64(n + 1) + self.token, return_inverse=True)
        context, word = pair // (n + 1), pair % (n + 1)
        number = np.append(self.number, START)
        self.context_count = np.append(self.count, texts)
        hot = self.context_count * HOT >= max(total, 1)
        part = np.where(hot[context], (self.number[word] % np.uint64(SPLIT)).astype(np.int64), 0) if len(pair) else context
        # every part of every hot context is asked, so that its statistics come back whole
        used = np.unique(context)
        rows = [np.stack([used[~hot[used]], np.zeros((~hot[used]).sum(), np.int64)])] + [np.stack([used[hot[used]], np.full(hot[used].sum(), s)]) for s in range(SPLIT)]
        row = np.concatenate(rows, axis=1) if len(used) else np.zeros((2, 0), np.int64)
        code = np.sort(row[0] * SPLIT + row[1])
        self.row_context = code // SPLIT
        self.row_key = number[self.row_context] * np.uint64(SPLIT) + (code % SPLIT).astype(np.uint64)
        self.row_bucket = (mix64(self.row_key) % np.uint64(buckets)).astype(np.int64)
        self.pair_row = np.searchsorted(code, context * SPLIT + part)
        counts = np.bincount(self.pair_of[self.train], minlength=len(pair)).astype(np.int64) if len(pair) else np.zeros(0, np.int64)
        self.order = np.lexsort((word, self.pair_row, self.row_bucket[self.pair_row]))
        self.rows_by = np.argsort(self.row_bucket, kind="stable")
        self.pair_bucket = self.row_bucket[self.pair_row[self.order]]
        self.fields = word, counts

    def requests(self, buckets: int) -> tuple[list[int], list[bytes]]:
        word, counts = self.fields
        to, blobs = [], []
        row_at, pair_at = (np.searchsorted(x, np.arange(buckets + 1)) for x in (self.row_bucket[self.rows_by], self.pair_bucket))
        per_row = np.bincount(self.pair_row, minlength=len(self.row_context))
        for b in range(buckets):
            rows = self.rows_by[row_at[b] : row_at[b + 1]]
            if len(rows):
                pairs = self.order[pair_at[b] : pair_at[b + 1]]
                w = word[pairs]
                to.append(b)
                blobs.append(_send(_narrow(self.row_key[rows]), _narrow(per_row[rows]), _narrow(self.number[w]), _narrow(counts[pairs]), _narrow(self.count[w])))
        return to, blobs

    def answered(self, replies: list[tuple[int, bytes]], buckets: int) -> None:
        """Counts of the pairs, and each context's kinds by count, larger counts' sum, and unigram mass of the words seen there."""
        self.pair_count = np.zeros(len(self.pair_row), np.int64)
        self.kinds, self.mass = np.zeros((len(self.words) + 1, TOP + 2)), np.zeros(len(self.words) + 1)
        row_at, pair_at = (np.searchsorted(x, np.arange(buckets + 1)) for x in (self.row_bucket[self.rows_by], self.pair_bucket))
        for b, blob in replies:
            kinds, mass, count = _got(blob)
            context = self.row_context[self.rows_by[row_at[b] : row_at[b + 1]]]
            np.add.at(self.kinds, context, kinds.reshape(-1, TOP + 2))
            np.add.at(self.mass, context, mass)
            self.pair_count[self.order[pair_at[b] : pair_at[b + 1]]] = count

    def score(self, uni: Unigrams, d: np.ndarray, total: int, kinds: int) -> dict[str, np.ndarray]:
        c = self.context_count.astype(np.float64)
        freed = ((1 - d[1:]) * np.arange(1, TOP + 1) * self.kinds[:, 1 : TOP + 1]).sum(axis=1) if len(c) else c
        some = freed > 0
        left = np.where(c > 0, np.where(some, freed / np.maximum(c, 1), 1 / (c + 1)), 1.0)
        scale = np.where(some, 1.0, c / (c + 1))
        alpha = np.where(c > 0, left / np.maximum(1 - self.mass, 1e-12), 1.0)
        p1 = uni.p(self.count)
        k = self.pair_count[self.pair_of]
        seen = scale[self.before] * d[np.minimum(k, TOP) * (k <= TOP)] * k / np.maximum(c[self.before], 1)
        log = np.log10(np.where(k > 0, seen, alpha[self.before] * p1[self.token]))
        base = np.log10((self.count + 0.1) / (total + 0.1 * (kinds + 1)))[self.token]
        add = lambda x: np.add.reduceat(x, self.first[:-1]) if len(self.size) else np.zeros(0)
        return {"n_tokens": self.size, "n_known": add((self.count > 0)[self.token].astype(np.int64)), "base_score": add(base), "score": add(log)}


def _words(table: pa.Table) -> pa.Table:
    """One range of words: their counts and ranks for each chunk; and, as chunk -1, the range's tokens, types and types by count."""
    got = [_got(x) for x in table["blob"].to_pylist()]
    keys, inverse = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    count = np.bincount(inverse, np.concatenate([g[1] for g in got]).astype(np.float64), len(keys)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum([len(g[0]) for g in got])])
    blobs = [_send(_narrow(inverse[a:b]), _narrow(count[inverse[a:b]])) for a, b in zip(at, at[1:])]
    stats = [int(count.sum()), int((count > 0).sum()), *np.bincount(count[(count > 0) & (count <= TOP + 1)], minlength=TOP + 2)[1:].tolist()]
    return _reply(table, blobs, stats)


def _reply(table: pa.Table, blobs: list[bytes], stats: list[int]) -> pa.Table:
    b = table["bucket"][0].as_py()
    chunk = [*table["chunk"].to_pylist(), -1]
    return pa.table([pa.array(chunk, pa.int64()), pa.array([b] * len(chunk), pa.int32()), pa.array([*blobs, b""], pa.binary()), pa.array([None] * len(blobs) + [stats], pa.list_(pa.int64()))], names=["chunk", "bucket", "blob", "stats"])


def _pairs(uni: Unigrams):
    def run(table: pa.Table) -> pa.Table:
        got = [_got(x) for x in table["blob"].to_pylist()]
        rows, contexts = [len(g[0]) for g in got], np.concatenate([g[0].astype(np.uint64) for g in got])
        names, of = np.unique(contexts, return_inverse=True)
        context = np.repeat(of, np.concatenate([g[1].astype(np.int64) for g in got]))
        word = np.concatenate([g[2].astype(np.uint64) for g in got])
        sent = np.concatenate([g[3].astype(np.int64) for g in got])
        known = np.concatenate([g[4].astype(np.int64) for g in got])
        order = np.lexsort((word, context))
        c, w = context[order], word[order]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])]) if len(c) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        count = np.add.reduceat(sent[order], first) if len(first) else np.zeros(0, np.int64)
        kinds, mass = np.zeros((len(names), TOP + 2)), np.zeros(len(names))
        own, on = c[first], count > 0
        np.add.at(kinds, (own[on], np.minimum(count[on], TOP + 1)), np.where(count[on] > TOP, count[on], 1).astype(float))
        np.add.at(mass, own[on], uni.p(known[order][first][on]))
        total = np.zeros(len(order), np.int64)
        total[order] = count[np.cumsum(new) - 1] if len(first) else 0
        row_at = np.concatenate([[0], np.cumsum(rows)])
        pair_at = np.concatenate([[0], np.cumsum([len(g[2]) for g in got])])
        blobs = [_send(_narrow(kinds[of[a:b]].ravel().astype(np.uint64)), mass[of[a:b]], _narrow(total[x:y])) for a, b, x, y in zip(row_at, row_at[1:], pair_at, pair_at[1:])]
        stats = np.bincount(count[on & (count <= TOP + 1)], minlength=TOP + 2)[1:].tolist()
        return _reply(table, blobs, stats)

    return run


_REPLY, _REQUEST = "chunk long, bucket int, blob binary, stats array<bigint>", "bucket int, chunk long, blob binary"


def _sums(replies: DataFrame, size: int) -> list[int]:
    row = replies.where("chunk = -1").agg(*[F.sum(F.col("stats")[i]) for i in range(size)]).first()
    return [int(x or 0) for x in row]


def katz_scores(docs: DataFrame, scratch: Scratch, parts: int = 10, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text; log10 probabilities.

    Learns from the documents whose CRC-32 of the id as text modulo ``parts`` is not ``held``. Tokens are lower-cased words and the end of the text. ``base_score``: the unigram model with 0.1
    added to each count. Null text: empty, so the end alone; null ids are learned from; repeated rows count as often as they stand; without anything to learn from, every
    token is the unknown word. An empty table gives no rows.
    """
    chunks = chunked(docs, scratch, id_col, text_col, CHUNK_BYTES).select("chunk", "size", "blob")
    buckets = bucket_count(chunks, BUCKET_BYTES)

    def words(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = _Tokens(blob.as_py(), parts, held)
                count = np.bincount(own.token[own.train], minlength=len(own.words))
                at = cuts(own.words, buckets)
                some = np.flatnonzero(np.diff(at))  # buckets of which the chunk has words
                blobs = [_send(own.words[at[b] : at[b + 1]], _narrow(count[at[b] : at[b + 1]])) for b in some]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([chunk] * len(some), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "blob"])

    sent = chunks.select("chunk", "blob").mapInArrow(words, _REQUEST)
    numbered = scratch.write(sent.groupBy("bucket").applyInArrow(_words, _REPLY), "words")
    total, kinds, *n = _sums(numbered, TOP + 3)
    uni = Unigrams(total, [0, *n])

    def read(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
        return sorted((b, x) for k, b, x in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["blob"].to_pylist()) if k == kind)

    def prepared(left: pa.Table, right: pa.Table) -> _Tokens:
        own = _Tokens(left["blob"][0].as_py(), parts, held)
        own.numbered(read(right, 0), buckets)
        own.bigrams(buckets, total, texts)
        return own

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        to, blobs = prepared(left, right).requests(buckets)
        return pa.table([pa.array(to, pa.int32()), pa.array([left["chunk"][0].as_py()] * len(to), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])

    held_out = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == held
    texts = docs.where(~F.coalesce(held_out, F.lit(False))).count()
    first = numbered.where("chunk >= 0").select("chunk", "bucket", "blob", F.lit(0).alias("kind"))
    plain = chunks.select("chunk", "blob")
    asked = plain.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(ask, _REQUEST)
    counted = scratch.write(asked.groupBy("bucket").applyInArrow(_pairs(uni), _REPLY), "bigrams")
    d = discounts([0, *_sums(counted, TOP + 1)])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        own = prepared(left, right)
        own.answered(read(right, 1), buckets)
        x = own.score(uni, d, total, kinds)
        return pa.table([own.ids, pa.array(own.held), pa.array(x["n_tokens"]), pa.array(x["n_known"]), pa.array(np.full(len(own.size), total)), pa.array(x["base_score"]), pa.array(x["score"])], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    both = first.unionByName(counted.where("chunk >= 0").select("chunk", "bucket", "blob", F.lit(1).alias("kind")))
    out = plain.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
