"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming links, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sabermill.llm.components import connected_components
from sabermill.llm.kernels import mix64, release, shingle_hashes, slices, utf8
from sabermill.llm.shared import Scratch

#: Fingerprints that share a block key are compared inside one task up to this many; larger groups go another, equally exact way.
BUCKET = 8192


def fingerprint(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Per text: bit b is set if it is set in over half of the text's hashes; no hashes: zero."""
    n = np.diff(before)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, before[some], axis=0, dtype=np.int32)
        packed = np.packbits(2 * sums > n[some, None], axis=1, bitorder="little")
        out[some] = np.ascontiguousarray(packed).view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the 64-bit SimHash of each whole text's ``words``-word shingles (XXH64, seed 42, repeats included).

    Null or wordless text: zero. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = utf8(batch.column(1))
            parts = [fingerprint(*shingle_hashes(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], words)[:2]) for a, b in slices(offs)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _masks(distance: int, blocks: int) -> list[int]:
    """For each choice of ``blocks - distance`` blocks, the bits that it covers: differing in at most ``distance`` bits leaves one choice equal."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(block, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _star(members: np.ndarray, reps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning links of the graph of members within ``distance`` bits: breadth first, each member left at most once."""
    left, out = np.arange(len(members)), []
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            node, frontier = frontier[0], frontier[1:]
            near = np.bitwise_count(members[left] ^ members[node]) <= distance
            if near.any():
                found = left[near]
                out += [(int(reps[node]), int(reps[i])) for i in found]
                frontier, left = np.concatenate([frontier, found]), left[~near]
    return out


def _bucket_links(distance: int):
    """mapInArrow over rows sorted by (t, key): spanning links of each bucket, buckets being streamed one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def linked(t, key, fp, rep) -> pa.RecordBatch:
            cut = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0)) + 1
            at, to = np.concatenate([[0], cut]), np.concatenate([cut, [len(t)]])
            links = [x for a, b in zip(at, to) if b - a > 1 for x in _star(fp[a:b], rep[a:b], distance)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = tuple(np.asarray(batch.column(i)) for i in range(4))
            rows = tuple(np.concatenate(x) for x in zip(*held, new)) if held else new
            t, key = rows[0], rows[1]
            last = np.flatnonzero((t != t[-1]) | (key != key[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield linked(rows[0][:cut], rows[1][:cut], rows[2][:cut].view(np.uint64), rows[3][:cut])
            held = [tuple(x[cut:] for x in rows)]
        if held:
            yield linked(held[0][0], held[0][1], held[0][2].view(np.uint64), held[0][3])

    return run


def hamming_links(prints: DataFrame, distance: int, scratch: Scratch, blocks: int | None = None) -> DataFrame:
    """(a, b): links between representatives whose distinct fingerprints differ in at most ``distance`` bits.

    ``prints``: (fp long, rep long), fp unique. The links connect exactly what the all-pairs graph connects, with at most
    one link per member of a bucket and key, so a group of near copies never becomes all its pairs. Buckets of over
    ``BUCKET`` fingerprints are not gathered: their members emit every value within distance/2 bits of theirs, rounded up, outside
    the key, and meet on equal values; see ``_hot_links``.
    """
    blocks = blocks or distance + 2
    masks = _masks(distance, blocks)
    keyed = prints.select(F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.expr(f"fp & {_signed(m)}L" if _signed(m) != -(1 << 63) else "fp & (-9223372036854775807L - 1L)").alias("key")) for i, m in enumerate(masks)])).alias("k"), "fp", "rep").select("k.t", "k.key", "fp", "rep")
    sizes = scratch.write(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(f"n > {BUCKET}"), "hot")
    if sizes.isEmpty():
        cool, links_hot = keyed, None
    else:
        cool = keyed.join(sizes, ["t", "key"], "left_anti")
        hot = keyed.join(sizes.select("t", "key"), ["t", "key"], "left_semi")
        links_hot = _hot_links(hot, masks, distance)
    n = prints.sparkSession.conf.get("spark.sql.shuffle.partitions")
    links = cool.repartition(int(n), "t", "key").sortWithinPartitions("t", "key").mapInArrow(_bucket_links(distance), "a long, b long")
    return links if links_hot is None else links.union(links_hot)


def _hot_links(hot: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """Links through values near the fingerprints: two of them differ in at most ``distance`` bits if and only if some value is within half of it, rounded up, of one and rounded down of the other.

    At a value, whoever is within the lower half (inner) is within ``distance`` of everybody there, so the smallest inner member is linked with all; without an inner member there is nothing to link.
    """
    radius = (distance + 1) // 2
    flips = [[0] + [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations([b for b in range(64) if not m >> b & 1], r)] for m in masks]
    table = F.array(*[F.array(*[F.lit(_signed(f)) for f in fs]) for fs in flips])
    ball = hot.select("t", "key", "fp", "rep", F.explode(table[F.col("t")]).alias("flip"))
    ball = ball.select("t", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), "rep", (F.bit_count("flip") <= distance // 2).alias("inner"))
    centre = ball.where("inner").groupBy("t", "key", "value").agg(F.min("rep").alias("b"))
    return ball.join(centre, ["t", "key", "value"]).where("rep <> b").select(F.col("rep").alias("a"), "b")


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = 3, distance: int = 2, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): documents whose fingerprints link at ``distance`` or fewer bits share the smallest id reachable.

    Equal fingerprints are one vertex, so exact copies cost one row each. Repeated rows keep one result row each; a null id takes
    no part and is returned with its own fingerprint and a null component. An empty table gives an empty result.
    """
    if distance % 2:
        blocks_ok = blocks or distance + 2
        if blocks_ok <= distance:
            raise ValueError("blocks must exceed distance")
    fps = scratch.write(fingerprints(docs, words, id_col, text_col), "fingerprints")
    reps = scratch.write(fps.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    comps = connected_components(hamming_links(reps, distance, scratch, blocks), scratch)
    classes = reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    joined = fps.join(classes, "fp", "left")
    return joined.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


#: Words of 64 bits of a wide fingerprint; its blocks have BLOCK bits.
WIDE, BLOCK = 8, 16
BLOCKS = WIDE * 64 // BLOCK
#: Standard deviations of the Hamming distance that candidates may be beyond the distance expected at the similarity asked for.
MARGIN = 3.5
_SALTS = [np.uint64(k * 0x9E3779B97F4A7C15 % 2**64) for k in range(WIDE)]


def bits_for(similarity: float) -> float:
    """Differing bits of wide fingerprints expected at a Jaccard similarity of equally long texts."""
    return 64 * WIDE * math.acos(2 * similarity / (1 + similarity)) / math.pi


def candidate_limit(similarity: float) -> int:
    """Differing bits up to which a pair is verified."""
    bits = bits_for(similarity)
    return math.ceil(bits + MARGIN * math.sqrt(bits * (1 - bits / (64 * WIDE))))


def key_bits(vertices: int) -> int:
    """Bits of a block key: BLOCK, and more as vertices grow, so that a key's share of unlike ones stays about 512."""
    return min(max(BLOCK, math.ceil(math.log2(max(vertices, 1))) - 9), 2 * BLOCK)


def rounds_for(bits: int, similarity: float) -> int:
    """How often each block is combined with bits of another one, so that nine in ten pairs at the similarity itself share a key."""
    if bits == BLOCK:
        return 1
    return min(math.ceil(2.303 / (1 - bits_for(similarity) / (64 * WIDE)) ** bits / BLOCKS), BLOCKS - 1)


def _distinct(hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes, every one once and in order, as similarity is one of sets."""
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((hashes, doc))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(before) - 1))])


def wide_fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, f0 .. f7, shingles): 512-bit SimHash, number and set of the distinct shingles (upper halves of their hashes, sorted) of each whole text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = utf8(batch.column(1))
            for a, b in slices(offs, 1 << 20):
                hashes, before, _ = shingle_hashes(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], words)
                hashes, before = _distinct(hashes, before)
                some = np.flatnonzero(np.diff(before))
                prints = [fingerprint(mix64(hashes ^ salt) if salt else hashes, before)[some] for salt in _SALTS]
                ids = batch.column(0).slice(a, b - a).take(pa.array(some))
                high = (hashes >> np.uint64(32)).astype("<u4")
                ends = np.concatenate([[0], before[some + 1]]).astype(np.int64) * 4  # texts without words add nothing
                sets = pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(high)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(before)[some]), *[pa.array(f.view(np.int64)) for f in prints], sets], ["id", "n", *(f"f{k}" for k in range(WIDE)), "shingles"])
        release()

    kind = "id long, n long, " + ", ".join(f"f{k} long" for k in range(WIDE)) + ", shingles binary"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, kind)


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / max(len(both) - common, 1)


class _Compare:
    """Who of a band counts as near a member: within the limit, first met under this key, and, where sets are at hand, of the similarity asked for."""

    def __init__(self, limit: int, extra: int, rounds: int, similarity: float) -> None:
        self.limit, self.extra, self.rounds, self.similarity = limit, extra, rounds, similarity

    def first_key(self, one: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Number of the first key that each of ``others`` shares with ``one`` (both as blocks)."""
        same = others == one
        if not self.extra:
            return same.argmax(axis=1)
        top = (others >> (BLOCK - self.extra)) == (one >> (BLOCK - self.extra))
        out = np.full(len(others), -1)
        for k in range(self.rounds):
            both = same & np.roll(top, -k - 1, axis=1)
            out = np.where((out < 0) & both.any(axis=1), k * BLOCKS + both.argmax(axis=1), out)
        return out

    def near(self, node: int, left: np.ndarray, t: int, prints: np.ndarray, sets: list[np.ndarray] | None) -> np.ndarray:
        out = np.bitwise_count(prints[left] ^ prints[node]).sum(axis=1, dtype=np.int32) <= self.limit
        if out.any():
            at = np.flatnonzero(out)
            blocks = prints.view("<u2")
            out[at] = self.first_key(blocks[node], blocks[left[at]]) == t
            if sets is not None:
                for i in np.flatnonzero(out):
                    out[i] = similarity_of(sets[node], sets[left[i]]) >= self.similarity - 1e-9
        return out


def _wide_star(t: int, prints: np.ndarray, sets: list[np.ndarray] | None, compare: _Compare) -> list[tuple[int, int]]:
    """Spanning links (places) of the graph of near members: breadth first, each member left at most once."""
    left, out = np.arange(len(prints)), []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            node = frontier.pop()
            near = compare.near(node, left, t, prints, sets)
            if near.any():
                found = left[near]
                out += [(int(node), int(i)) for i in found]
                frontier += found.tolist()
                left = left[~near]
    return out


def _wide_links(compare: _Compare, verified: bool):
    """mapInArrow over rows (t, key, s, rep, words[, shingles]) sorted by the first three, within each band s of a key and between it and the next band.

    Not verified: the rows that have a near one, as (t, key, s, rep, f0). Verified: spanning links (a, b). At most two bands and one batch are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sets: list[np.ndarray] | None = [] if verified else None

        def linked(edges: list[int], complete: int) -> pa.RecordBatch:
            prints, links, met = np.ascontiguousarray(np.stack(held[4 : 4 + WIDE], axis=1)).view(np.uint64), set(), set()
            for i in range(complete):
                at, to = edges[i], edges[i + 1]
                if i + 1 < complete and held[0][at] == held[0][to] and held[1][at] == held[1][to] and held[2][at] + 1 == held[2][to]:
                    to = edges[i + 2]
                if to - at > 1:
                    for a, b in _wide_star(int(held[0][at]), prints[at:to], sets[at:to] if sets is not None else None, compare):
                        met.update((at + a, at + b))
                        links.add((int(held[3][at + a]), int(held[3][at + b])))
            if verified:
                found = sorted(links)
                return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])
            place = np.array(sorted(met), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(held[i][place]) for i in range(5)], ["t", "key", "s", "rep", "f0"])

        def edges_of() -> list[int]:
            return [0, *(np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)) + 1).tolist(), len(held[0])]

        for batch in batches:
            if batch.num_rows:
                new = [np.asarray(batch.column(i)) for i in range(4 + WIDE)]
                held = [np.concatenate(x) for x in zip(held, new)] if held else new
                if sets is not None:
                    sets += [np.frombuffer(x, "<u4") for x in batch.column(4 + WIDE).to_pylist()]
                edges = edges_of()
                if len(edges) > 3:  # the last band may go on, and the one before may meet it
                    yield linked(edges, len(edges) - 2)
                    held = [x[edges[-3] :] for x in held]
                    if sets is not None:
                        del sets[: edges[-3]]
        if held:
            edges = edges_of()
            yield linked(edges, len(edges) - 1)
        release()

    return run


def near_copies(docs: DataFrame, scratch: Scratch, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """(id, component) of texts with words: near copies, of ``similarity`` or more in their distinct ``words``-word shingles, share the smallest id reachable.

    Fingerprints of 512 bits are split into 32 blocks. Texts that share a block key, and whose numbers of distinct shingles allow the similarity, are candidates if their Hamming
    distance is at most MARGIN deviations over the one that the similarity makes likely. Candidates meet once more, under the first key that they share, with their whole sets of shingles, and
    only a pair that has the similarity is linked; the search inside a key follows verified links alone, so a pair that fails costs no other pair its link. At 0.8 about one pair in eleven
    shares no key, at 0.85 one in 45. ``bits``: width of the keys (default by the number of fingerprints: a block, and bits of a second one beyond 33 million).
    Numbers of shingles fall into bands as wide as the similarity, so partners stand in the same or the next band. Equal fingerprints are one vertex. A band of a key that
    holds BUCKET / 2 vertices or more is dealt out with its neighbours as pairs of parts, so no task holds it whole, and every pair still meets. Null ids and texts without words take no part.
    Rows that share an id are one vertex. An empty table gives no rows; other columns are not read.
    """
    cols = [f"f{k}" for k in range(WIDE)]
    fps = scratch.write(wide_fingerprints(docs, words, id_col, text_col), "wide")
    reps = scratch.write(fps.groupBy(*cols).agg(F.min("id").alias("rep"), F.min("n").alias("n")), "reps")
    bits = bits or key_bits(reps.count())
    extra, rounds = bits - BLOCK, rounds_for(bits, similarity)
    compare = _Compare(candidate_limit(similarity), extra, rounds, similarity)
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / similarity) + F.lit(1e-9)).cast("long")
    per = 64 // BLOCK

    def block(i: int):
        return F.shiftrightunsigned(cols[i // per], BLOCK * (i % per)).bitwiseAND(F.lit((1 << BLOCK) - 1))

    def key(k: int, i: int):
        return F.shiftleft(block(i), extra).bitwiseOR(F.shiftrightunsigned(block((i + k + 1) % BLOCKS), BLOCK - extra)) if extra else block(i)

    keys = F.array(*[F.struct(F.lit(k * BLOCKS + i).cast("long").alias("t"), key(k, i).alias("key")) for k in range(rounds) for i in range(BLOCKS)])
    keyed = reps.withColumn("s", size).select(F.explode(keys).alias("k"), "s", "rep", *cols).select("k.t", "k.key", "s", "rep", *cols)
    big = scratch.write(keyed.groupBy("t", "key", "s").agg(F.count("*").alias("n")).where(f"n * 2 >= {BUCKET}"), "hot")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(rows: DataFrame) -> DataFrame:
        return rows.select("t", "key", "s", "rep", *cols).repartition(n, "t", "key").sortWithinPartitions("t", "key", "s").mapInArrow(_wide_links(compare, False), "t long, key long, s long, rep long, f0 long")

    if big.isEmpty():
        pairs = met(keyed)
    else:
        hot = big.select("t", "key", F.explode(F.array("s", F.col("s") - 1)).alias("low"), "n").groupBy("t", "key", "low").agg(F.sum("n").alias("n"))
        parts = F.ceil((F.col("n") * 2 + BUCKET) / BUCKET).cast("int")
        near = big.select("t", "key", F.explode(F.array("s", F.col("s") - 1, F.col("s") + 1)).alias("s")).distinct()
        both = keyed.join(near, ["t", "key", "s"], "left_semi").select("t", "key", F.explode(F.array("s", F.col("s") - 1)).alias("low"), "rep", *cols)
        dealt = both.join(hot.select("t", "key", "low", parts.alias("p")), ["t", "key", "low"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("p")).cast("int"))
        dealt = dealt.select("t", "key", "low", "own", F.explode(F.expr("sequence(0, p - 1)")).alias("other"), "rep", *cols)
        dealt = dealt.select("t", F.xxhash64("key", "low", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.lit(-1).cast("long").alias("s"), "rep", *cols)
        pairs = met(keyed.join(big, ["t", "key", "s"], "left_anti")).union(met(dealt))
    pairs = scratch.write(pairs.distinct(), "candidates")
    wanted = pairs.select(F.col("rep").alias("id"), "f0").distinct()
    sets = fps.join(wanted, ["id", "f0"], "left_semi").dropDuplicates(["id", "f0"]).withColumnRenamed("id", "rep")
    whole = pairs.join(sets, ["rep", "f0"]).select("t", "key", "s", "rep", *cols, "shingles")
    links = whole.repartition(n, "t", "key").sortWithinPartitions("t", "key", "s").mapInArrow(_wide_links(compare, True), "a long, b long")
    comps = connected_components(links, scratch).withColumnRenamed("node", "rep")
    classes = reps.join(comps, "rep", "left").select(*cols, F.coalesce("component", "rep").alias("component"))
    return fps.join(classes, cols).select("id", "component")
