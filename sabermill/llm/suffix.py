"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Where two documents share such a string, they share its smallest
hash of ``FILTER`` bytes, so only windows whose smallest hash stands in two documents are looked at again; these are dealt out by the smallest hash of ``ANCHOR`` bytes, which equal
strings share too, as segments of text. Each bucket builds the suffix array of its segments by prefix doubling, the common prefixes of neighbouring suffixes, and from them the longest previous factor of every
place: the longer of the common prefixes with the nearest suffix of a smaller document before it and after it in suffix order. Where that factor has LENGTH bytes, the string at the place has an
earlier copy, and what such factors cover goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sabermill.llm.chunks import bucket_count, chunked, cuts, pack_arrays, read_chunk, unpack
from sabermill.llm.kernels import mix64, release, slices, utf8
from sabermill.llm.shared import Scratch

LENGTH, FILTER, ANCHOR = 50, 32, 12
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _loads(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as little-endian numbers; ``raw`` ends with 8 spare bytes."""
    return np.ndarray(len(raw) - 8, "<u8", raw.data, strides=(1,)).copy()


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def _windows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with equal hashes: (start, windows, filter hash, anchor hash, text) of each."""
    parts = []
    for lo, hi in slices(offs, 1 << 20):
        base, o = offs[lo], offs[lo : hi + 1] - offs[lo]
        n = int(o[-1])
        if n < LENGTH:
            continue
        raw = np.concatenate([buf[base : base + n], np.zeros(8, np.uint8)])
        load = _loads(raw)
        with np.errstate(over="ignore"):
            wide = mix64(sum((load[8 * k : n - FILTER + 1 + 8 * k] * _ODD[k] for k in range(4)), np.zeros(n - FILTER + 1, np.uint64)))
            slim = mix64(load[: n - ANCHOR + 1] * _ODD[0] + load[4 : n - ANCHOR + 5] * _ODD[1])
        a, b = _smallest(wide, LENGTH - FILTER + 1), _smallest(slim, LENGTH - ANCHOR + 1)
        edge = np.ones(len(a) + 1, bool)
        edge[1:-1] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        edge[o[:-1][o[:-1] < len(a)]] = True
        ends = o[1:] - LENGTH + 1  # windows from here on reach into the next text
        edge[ends[(ends > 0) & (ends < len(a))]] = True
        start = np.flatnonzero(edge[:-1])
        count = np.diff(np.append(start, len(a)))
        doc = np.searchsorted(o, start, "right") - 1
        ok = start + LENGTH <= o[doc + 1]
        parts.append((start[ok] + base, count[ok], a[start[ok]], b[start[ok]], doc[ok] + lo))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _keys(runs: tuple[np.ndarray, ...], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's sorted filter hashes in texts with an id, and whether several of its texts have each."""
    ok = known[runs[4]]
    key, doc = runs[2][ok], runs[4][ok]
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(first):
        return key, np.zeros(0, bool)
    return key[first], np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)


class _Chunk:
    """One chunk's texts, and its segments once it is known which hashes other chunks have."""

    def __init__(self, blob: bytes) -> None:
        ids, self.buf, self.offs = read_chunk(blob)
        self.ids = ids
        self.known = np.asarray(ids.is_valid())
        self.id = np.asarray(ids.fill_null(0))
        self.runs = _windows(self.buf, self.offs)
        self.keys, self.several = _keys(self.runs, self.known)

    def segments(self, replies: dict[int, bytes], buckets: int) -> None:
        at = cuts(self.keys, buckets)
        flags = self.several.copy()
        for b, bits in replies.items():
            flags[at[b] : at[b + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=int(at[b + 1] - at[b])).view(bool)
        start, count, key, anchor, doc = self.runs
        place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        on = self.known[doc] & flags[place] if len(self.keys) else np.zeros(len(start), bool)
        start, count, anchor, doc = start[on], count[on], anchor[on], doc[on]
        joined = np.concatenate([[True], (start[1:] != start[:-1] + count[:-1]) | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]) if len(start) else np.zeros(0, bool)
        first = np.flatnonzero(joined)
        self.start, self.doc = start[first], doc[first]
        self.count = np.add.reduceat(count, first) if len(first) else count
        self.bucket = (mix64(anchor[first]) % np.uint64(buckets)).astype(np.int64)
        # equal segments of the chunk are sent once, for the smallest of their documents
        view, index, self.which = memoryview(np.ascontiguousarray(self.buf)), {}, np.zeros(len(first), np.int64)
        for i, (s, c) in enumerate(zip(self.start.tolist(), self.count.tolist())):
            self.which[i] = index.setdefault(view[s : s + c + LENGTH - 1].tobytes(), len(index))
        self.texts = list(index)
        self.least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.which, self.id[self.doc])
        owner, self.part = np.zeros(len(index), np.int64), np.zeros(len(index), np.uint16)
        owner[self.which] = self.bucket
        self.part[self.which] = (mix64(anchor[first]) >> np.uint64(48)).astype(np.uint16)
        self.sent = [np.flatnonzero(owner == b) for b in np.unique(owner)]
        self.sent_to = np.unique(owner)

    def removed(self, replies: dict[int, bytes]) -> np.ndarray:
        """Whether each byte goes."""
        size = np.array([len(t) - LENGTH + 1 for t in self.texts], np.int64)
        base = np.concatenate([[0], np.cumsum(size)])
        gone = np.zeros(int(base[-1]), bool)
        for b, own in zip(self.sent_to.tolist(), self.sent):
            bits = np.unpackbits(np.frombuffer(replies[b], np.uint8), count=int(size[own].sum())).view(bool)
            gone[np.repeat(base[own], size[own]) + _ranges(size[own])] = bits
        later = self.id[self.doc] > self.least[self.which]
        place = np.repeat(self.start, self.count) + _ranges(self.count)
        hit = np.repeat(later, self.count) | gone[np.repeat(base[self.which], self.count) + _ranges(self.count)]
        cover = np.zeros(len(self.buf) + 1, np.int32)
        np.add.at(cover, place[hit], 1)
        np.add.at(cover, place[hit] + LENGTH, -1)
        return np.cumsum(cover[:-1]) > 0


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for each c, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def _sorted_by(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of two 32-bit keys, equal ones as they stand; a number for each place, equal for equal keys), all of 32 bits.

    Keys are sorted with the place behind them as plain numbers, in place, as such sorts are vectorised: both keys at once where all three fit into 64 bits, else one key after the other.
    """
    n = len(high)
    at, wide = n.bit_length(), int(low.max(initial=0)).bit_length()
    rank = np.empty(n, np.uint32)
    new = np.zeros(n, np.uint32)
    if int(high.max(initial=0)).bit_length() + wide + at <= 64:
        key = high.astype(np.uint64)
        key <<= np.uint64(wide)
        key |= low
        key <<= np.uint64(at)
        key |= np.arange(n, dtype=np.uint32)
        key.sort()
        order = (key & np.uint64((1 << at) - 1)).astype(np.uint32)
        key >>= np.uint64(at)
        new[1:] = key[1:] != key[:-1]
    else:

        def places(key: np.ndarray) -> np.ndarray:
            both = key.astype(np.uint64)
            both <<= np.uint64(32)
            both |= np.arange(n, dtype=np.uint32)
            both.sort()
            return both.astype("<u8", copy=False).view("<u4")[::2].copy()

        order = places(low)
        order = order[places(high[order])]
        for key in (high, low):
            now = key[order]
            new[1:] |= now[1:] != now[:-1]
    rank[order] = np.cumsum(new, dtype=np.uint32)
    return order, rank


class SuffixArray:
    """Suffixes of segments (bytes, offsets) by their first REACH bytes or up to their segment's end, by prefix doubling from 7 bytes on; equal ones in the order of their places."""

    REACH = 56

    def __init__(self, raw: np.ndarray, offs: np.ndarray) -> None:
        n = len(raw)
        self.raw = np.concatenate([raw, np.zeros(8, np.uint8)])
        left = np.repeat(offs[1:], np.diff(offs)) - np.arange(n)
        self.left = np.minimum(left, 255).astype(np.uint8)  # bytes up to the segment's end, 255 for more
        del left
        # 7 bytes, zeros beyond the segment's end, then how many of them are inside: an end comes before every byte
        key = self.load(slice(None)).astype(np.uint64)
        near = np.flatnonzero(self.left < 7)
        over = (8 - self.left[near]).astype(np.uint64) * np.uint64(8)
        key[near] = key[near] >> over << over
        key &= np.uint64(2**64 - 256)
        key |= np.minimum(self.left, 7)
        halves = key.astype("<u8", copy=False).view("<u4").reshape(-1, 2)
        low, high = halves[:, 0].copy(), halves[:, 1].copy()
        del key, halves
        self.order, rank = _sorted_by(high, low)
        self.levels: list[tuple[int, np.ndarray]] = [(7, rank)]
        size = 7
        while size < self.REACH:
            later = np.zeros(n, np.uint32)
            on = self.left[: n - size] > size
            later[: n - size][on] = rank[size:][on] + np.uint32(1)
            self.order, rank = _sorted_by(rank, later)
            size *= 2
            self.levels.append((size, rank))

    def load(self, at) -> np.ndarray:
        """The 8 bytes from places on, as big-endian numbers."""
        return np.ndarray(len(self.raw) - 8, ">u8", self.raw.data, strides=(1,))[at]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at places ``a`` and ``b``, up to REACH bytes."""
        most = np.minimum(np.minimum(self.left[a], self.left[b]), self.REACH)
        rank = self.levels[-1][1]
        unequal = np.flatnonzero(rank[a] != rank[b])
        out, a, b = most.copy(), a[unequal].astype(np.int64), b[unequal].astype(np.int64)
        limit, done = most[unequal].astype(np.int64), np.zeros(len(unequal), np.int64)
        for size, rank in self.levels[-2::-1]:
            on = np.flatnonzero(done + size <= limit)
            on = on[rank[a[on] + done[on]] == rank[b[on] + done[on]]]
            done[on] += size
        rest = np.flatnonzero(done < limit)
        diff = (self.load(a[rest] + done[rest]) ^ self.load(b[rest] + done[rest])).astype(np.uint64)
        for k in range(1, 9):
            done[rest] += diff >> np.uint64(64 - 8 * k) == 0
        out[unequal] = np.minimum(done, limit)
        return out


#: Neighbours in suffix order that are compared at a time, and bytes that one suffix array holds if no part is larger: with fewer, two ranks and a place fit into one number.
STEP, BATCH = 1 << 20, 1 << 21


def previous_factors(raw: np.ndarray, offs: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The longest previous factor of every byte of the segments: how many bytes from it on also start in a segment of a smaller document, up to SuffixArray.REACH; under LENGTH counts as 0.

    ``docs``: each segment's document, never falling. In suffix order, the longest such string is shared with the nearest suffix of a smaller document on one of both sides; how much is the least
    common prefix of neighbours in between. Nearest smaller ones are found by pointer jumping, all suffixes at once, which stops where too little is in common.
    """
    suffixes = SuffixArray(raw, offs)
    out = np.zeros(len(raw), np.uint8)
    order = suffixes.order[suffixes.left[suffixes.order] >= LENGTH]
    m = len(order)
    lcp = np.zeros(m + 1, np.uint8)  # lcp[i]: with the suffix before
    for i in range(1, m, STEP):
        j = min(i + STEP, m)
        lcp[i:j] = suffixes.common(order[i - 1 : j - 1], order[i:j])
    del suffixes
    number = np.cumsum(np.concatenate([[0], docs[1:] != docs[:-1]]), dtype=np.int32)
    doc = np.repeat(number, np.diff(offs))[order]
    factor = np.zeros(m, np.uint8)
    for step in (-1, 1):
        to = np.arange(step, m + step, dtype=np.int32)
        least = lcp[:m].copy() if step < 0 else lcp[1:].copy()  # the least common prefix on the way to ``to``
        on = np.flatnonzero(least >= LENGTH).astype(np.int32)
        while len(on):
            met = doc[to[on]] < doc[on]
            factor[on[met]] = np.maximum(factor[on[met]], least[on[met]])
            on = on[~met]
            via = to[on]
            # whoever stands between ``via`` and its own pointer is no smaller than ``via``, and so no smaller than we are
            further, shared = to[via], np.minimum(least[on], least[via])
            to[on], least[on] = further, shared
            on = on[shared >= LENGTH]
    out[order] = factor
    return out


_REPLY = "chunk long, bucket int, bits binary"


def _seen_in_several(table: pa.Table) -> pa.Table:
    """One bucket's filter hashes: for each chunk, which of its hashes another chunk has too."""
    chunk, blobs = table["chunk"].to_pylist(), table["blob"].to_pylist()
    keys = [np.frombuffer(x, np.uint8).reshape(-1, 5) for x in blobs]
    wide = np.zeros((sum(map(len, keys)), 8), np.uint8)
    wide[:, :5] = np.concatenate(keys)
    flat = wide.view("<u8").ravel()
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    bits = [np.packbits(twice[a:b]).tobytes() for a, b in zip(at, at[1:])]
    return pa.table([pa.array(chunk, pa.int64()), pa.array([table["bucket"][0].as_py()] * len(chunk), pa.int32()), pa.array(bits, pa.binary())], names=["chunk", "bucket", "bits"])


def _factors(table: pa.Table) -> pa.Table:
    """One bucket's segments: for each chunk, which of its windows start in a smaller document."""
    chunk, texts, docs, parts, sizes = table["chunk"].to_pylist(), [], [], [], []
    for blob in table["blob"]:
        batch = unpack(blob.as_py())
        texts.append(batch.column(0).cast(pa.large_binary()))
        docs.append(np.asarray(batch.column(1)))
        parts.append(np.asarray(batch.column(2)))
        sizes.append(batch.num_rows)
    segments, doc, part = pa.concat_arrays(texts), np.concatenate(docs), np.concatenate(parts)
    del texts, docs, parts
    lens = np.diff(utf8(segments)[1])
    starts = lens - LENGTH + 1  # places of each segment at which a string of LENGTH bytes fits
    of = np.concatenate([[0], np.cumsum(starts)])
    gone = np.zeros(int(of[-1]), bool)
    # equal strings have equal parts, so parts are sorted one batch after the other
    by = np.lexsort((doc, part))
    last = np.append(np.flatnonzero(np.diff(part[by])) + 1, len(by))
    size = np.cumsum(lens[by])
    lo = 0
    while lo < len(by):
        fit = last[(last > lo) & (size[last - 1] - size[lo] + lens[by[lo]] < BATCH)]
        hi = int(fit[-1]) if len(fit) else int(last[last > lo][0])
        own = by[lo:hi]
        own = own[np.argsort(doc[own], kind="stable")]
        raw, offs = utf8(segments.take(pa.array(own)))
        factor = previous_factors(raw, offs, doc[own])
        gone[np.repeat(of[own], starts[own]) + _ranges(starts[own])] = factor[np.repeat(offs[:-1], starts[own]) + _ranges(starts[own])] >= LENGTH
        lo = hi
    edge = of[np.concatenate([[0], np.cumsum(sizes)])]
    bits = [np.packbits(gone[a:b]).tobytes() for a, b in zip(edge, edge[1:])]
    del gone, segments
    release()
    return pa.table([pa.array(chunk, pa.int64()), pa.array([table["bucket"][0].as_py()] * len(chunk), pa.int32()), pa.array(bits, pa.binary())], names=["chunk", "bucket", "bits"])


def remove_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans array<struct<start,end>>, kept binary): each text as UTF-8 without the bytes that an earlier document has in a string of LENGTH bytes.

    ``spans``: the maximal removed runs as byte offsets; matches are judged on the input and never cross documents. Null text: empty; texts under LENGTH bytes stay; documents
    with a null id stay and are nobody's earlier copy; rows that share an id don't match each other. An empty table gives no rows. Hashes only pick windows and places: what is
    removed is compared byte by byte.
    """
    chunks = chunked(docs, scratch, id_col, text_col, CHUNK_BYTES)
    buckets = bucket_count(chunks, BUCKET_BYTES)

    def keys(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = _Chunk(blob.as_py()).keys
                at = cuts(own, buckets)
                low = np.ascontiguousarray(own).view(np.uint8).reshape(-1, 8)[:, :5]
                some = [b for b in range(buckets) if at[b + 1] > at[b]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([low[at[b] : at[b + 1]].tobytes() for b in some], pa.binary())], ["bucket", "chunk", "blob"])

    sent = chunks.select("chunk", "blob").mapInArrow(keys, "bucket int, chunk long, blob binary")
    seen = scratch.write(sent.groupBy("bucket").applyInArrow(_seen_in_several, _REPLY), "seen")

    def segments(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = left["chunk"][0].as_py()
        own = _Chunk(left["blob"][0].as_py())
        own.segments(dict(zip(right["bucket"].to_pylist(), right["bits"].to_pylist())), buckets)
        blobs = [pack_arrays(pa.array([own.texts[i] for i in rows.tolist()], pa.binary()), own.least[rows], own.part[rows]) for rows in own.sent]
        release()
        return pa.table([pa.array(own.sent_to, pa.int32()), pa.array([chunk] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])

    parts = chunks.select("chunk", "blob").groupBy("chunk").cogroup(seen.groupBy("chunk")).applyInArrow(segments, "bucket int, chunk long, blob binary")
    found = scratch.write(parts.groupBy("bucket").applyInArrow(_factors, _REPLY), "factors")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _Chunk(left["blob"][0].as_py())
        both = list(zip(right["kind"].to_pylist(), right["bucket"].to_pylist(), right["bits"].to_pylist()))
        own.segments({b: x for k, b, x in both if k == 0}, buckets)
        gone = own.removed({b: x for k, b, x in both if k == 1})
        spans, kept = [], []
        for a, b in zip(own.offs[:-1].tolist(), own.offs[1:].tolist()):
            g = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]]))) if g.any() else []
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])])
            kept.append(own.buf[a:b][~g].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([own.ids, pa.array(np.diff(own.offs)), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    replies = seen.withColumn("kind", F.lit(0)).unionByName(found.withColumn("kind", F.lit(1)))
    out = chunks.select("chunk", "blob").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(cut, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
