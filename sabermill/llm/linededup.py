"""Line dedup by content-defined chunks of lines, whole passages or chunks alone.

A rolling hash over each line and the one before puts a boundary after about every ``LINES``-th line, so the same passage is cut alike wherever it stands. Chunks of two or more
non-blank lines are compared; shorter ones, and those at a passage's ends, are not.

``line_dedup`` stops there. ``passage_dedup`` then carries each passage on to its ends: every two neighbouring non-blank lines, with the blank ones between them, that lie in no chunk
which a smaller document has are compared too. A passage of two or more non-blank lines is the union of such pairs, so each line of one that an earlier document has, byte for byte, is
removed wherever the passage begins and ends. No pair is lost by leaving out those in repeated chunks: the smallest document that has a pair has it outside of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sabermill.llm.kernels import mix64, release
from sabermill.llm.shared import Scratch

#: A boundary follows a line with chance 1 / LINES, and every MOST lines in any case.
LINES, MOST = 3, 64
#: Rows that a task takes up at a time, and bytes of passages that it gathers before it hands them on.
ROWS, FLUSH = 256, 4 << 20


def chunks(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, lines, hash) of each chunk; ``end`` excludes the line end after the last line. Hash 0: under two non-blank lines."""
    parts = text.split(b"\n")
    hashes = np.array([xxhash.xxh64_intdigest(p) for p in parts], np.uint64)
    rolled = hashes.copy()
    with np.errstate(over="ignore"):
        rolled[1:] += hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)
    cut = mix64(rolled) % np.uint64(LINES) == 0
    cut[-1] = True
    last = np.flatnonzero(cut)
    gap = np.diff(np.concatenate([[-1], last]))
    if (gap > MOST).any():  # even cuts inside long runs without a boundary
        since = np.arange(len(cut)) - np.repeat(np.concatenate([[0], last[:-1] + 1]), gap)
        cut |= since % MOST == MOST - 1
        last = np.flatnonzero(cut)
    ends = np.cumsum([len(p) + 1 for p in parts])
    out, at, line = [], 0, 0
    for i in last.tolist():
        stop = int(ends[i]) - 1
        full = sum(1 for p in parts[line : i + 1] if p.strip())
        out.append((at, stop, i + 1 - line, (xxhash.xxh64_intdigest(text[at:stop]) or 1) if full > 1 else 0))
        at, line = stop + 1, i + 1
    return out


def pairs(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, lines, hash) of each two neighbouring non-blank lines, blank lines between them included."""
    out, at, before = [], 0, None
    for i, p in enumerate(text.split(b"\n")):
        if p and not p.isspace():
            if before is not None:
                a, first = before
                out.append((a, at + len(p), i + 1 - first, xxhash.xxh64_intdigest(text[a : at + len(p)]) or 1))
            before = at, i
        at += len(p) + 1
    return out


def chunk_pairs(text: bytes) -> tuple[dict[int, set[int]], set[int]]:
    """The hashes of the chunks of two or more non-blank lines, each with those of the pairs inside it, and the hashes of the pairs that lie in no such chunk."""
    whole = [c for c in chunks(text) if c[3]]
    inside, loose, k = {h: set() for *_, h in whole}, set(), 0
    for a, b, _, h in pairs(text):
        while k < len(whole) and whole[k][1] < b:
            k += 1
        (inside[whole[k][3]] if k < len(whole) and whole[k][0] <= a else loose).add(h)
    return inside, loose


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def added_columns(columns: list[str]) -> list[str]:
    """What the columns removed_chunks, removed_lines and total_lines are called beside ``columns``: a name that is taken gets underscores at its end."""
    taken, out = {c.lower() for c in columns}, []
    for name in ("removed_chunks", "removed_lines", "total_lines"):
        while name in taken:
            name += "_"
        out.append(name)
    return out


def line_dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each text's repeated chunks removed, and three columns more: removed_chunks, removed_lines, total_lines (long; see ``added_columns`` where ``docs`` has such columns).

    A chunk is removed if a document with a smaller id has the same bytes as a chunk, or if it stands earlier in the same text. Kept chunks keep their bytes; what remains
    is joined as it stood. Null texts stay null and count no lines; rows that share an id never count as earlier copies of each other; rows with a null id only lose
    repeats inside themselves. All columns are carried whatever their names. Hashes alone are grouped, map-side first; the bytes of chunks whose hash
    several documents have are then compared by a join in which AQE splits hot hashes.
    """
    return _dedup(docs, scratch, id_col, text_col, False)


def passage_dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``line_dedup``, but each line goes that stands in a passage of two or more non-blank lines which a document with a smaller id has, or which ended earlier in the same text.

    removed_chunks counts the runs of lines that go. Of each line that goes, an equal one stays in a smaller document or further up.
    """
    return _dedup(docs, scratch, id_col, text_col, True)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(lo, ROWS) for batch in batches for lo in range(0, batch.num_rows, ROWS))


def _dedup(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, passages: bool) -> DataFrame:
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    rows = plain.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            ids, hashes, within = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                inside, loose = chunk_pairs(t.encode()) if passages else ({h: () for *_, h in chunks(t.encode()) if h}, ())
                ids += [i] * (len(inside) + bool(loose))
                hashes += map(_signed, inside)
                within += [list(map(_signed, sorted(x))) for x in inside.values()]
                if loose:
                    hashes.append(None)
                    within.append(list(map(_signed, sorted(loose))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(within, pa.list_(pa.int64()))], ["id", "hash", "pairs"])
        release()

    found = scratch.write(rows.where("id IS NOT NULL AND instr(text, '\n') > 0").mapInArrow(own, "id long, hash long, pairs array<long>"), "chunks")
    whole = found.where("hash IS NOT NULL")
    # a chunk that a smaller document has speaks for the pairs inside it; all other pairs are compared by themselves
    known = whole.join(_repeated(whole, scratch), "hash", "left").select("id", "hash", "first", "pairs").unionByName(found.where("hash IS NULL").withColumn("first", F.lit(None).cast("long")))
    unit = "named_struct('whole', {}, 'hash', {}, 'first', {})"
    chunk = f"IF(first IS NULL, array(), array({unit.format('true', 'hash', 'first')}))"
    inner = f"IF(first < id, array(), transform(pairs, p -> {unit.format('false', 'p', 'cast(null AS long)')}))"
    units = scratch.write(known.selectExpr("id", f"inline(concat({chunk}, {inner}))"), "units")
    loose = units.where("NOT whole").drop("first")
    wanted = units.where("whole").unionByName(loose.join(_repeated(loose, scratch), "hash")).groupBy("id").agg(F.collect_set(F.struct("whole", "hash", "first")).alias("wanted"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())

        def taken(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["id", "whole", "hash", "first", "bytes"])

        for batch in _parts(batches):
            out: list[tuple] = []
            size = 0
            for i, t, wants in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = t.encode()
                for kind, cut in ((True, chunks), (False, pairs)):
                    first = {w["hash"]: w["first"] for w in wants if w["whole"] == kind}
                    for a, b, _, h in cut(raw) if first else ():
                        if h and (s := _signed(h)) in first:
                            out.append((i, kind, s, first.pop(s), raw[a:b]))
                            size += b - a
                            if size > FLUSH:
                                yield taken(out)
                                out, size = [], 0
            yield taken(out)
        release()

    held = scratch.write(rows.join(wanted, "id").select("id", "text", "wanted").mapInArrow(texts, "id long, whole boolean, hash long, first long, bytes binary"), "bytes")
    later, first = held.where("id <> first").alias("l"), held.where("id = first").alias("f")
    same = later.join(first, F.expr("l.hash = f.hash AND l.bytes = f.bytes AND l.whole = f.whole"), "left_semi")
    gone = same.groupBy("id").agg(*[F.collect_set(F.expr(f"IF({kind}, hash, null)")).alias(name) for name, kind in (("whole", "whole"), ("ends", "NOT whole"))]).withColumnRenamed("id", "gone_id")
    joined = plain.join(gone, F.col(key).cast("long") == F.col("gone_id"), "left").select(*[F.col(c) for c in plain.columns], "whole", "ends")
    cols = plain.columns
    at = cols.index(text)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            kept, counts = [], []
            for t, whole, ends in zip(*(batch.column(k).to_pylist() for k in (at, len(cols), len(cols) + 1))):
                kept.append(None if t is None else (done := _cut_passages(t, set(whole or ()), set(ends or ())) if passages else _cut(t, set(whole or ())))[0])
                counts.append((0, 0, 0) if t is None else done[1:])
            arrays = [batch.column(i) if i != at else pa.array(kept, pa.string()) for i in range(len(cols))]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))], [*cols, "removed_chunks", "removed_lines", "total_lines"])
        release()

    return joined.mapInArrow(cut, f"{schema}, removed_chunks long, removed_lines long, total_lines long").toDF(*names, *added_columns(names))


def _repeated(units: DataFrame, scratch: Scratch) -> DataFrame:
    """(hash, first): the hashes that rows with different ids have, and the smallest of these ids. Written, so that a join to it is broadcast while small, and AQE splits its hot hashes else."""
    return scratch.write(units.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("hash", "first"), "repeated")


def _cut(text: str, gone: set[int]) -> tuple[str, int, int, int]:
    raw, seen = text.encode(), {}
    if b"\n" not in raw:
        return text, 0, 0, 1
    keep, chunks_gone, lines_gone, total = [], 0, 0, 0
    for a, b, lines, h in chunks(raw):
        total += lines
        if h and (_signed(h) in gone or raw[a:b] in seen.get(h, ())):
            chunks_gone += 1
            lines_gone += lines
        else:
            keep.append(raw[a:b])
            if h:
                seen.setdefault(h, []).append(raw[a:b])
    return b"\n".join(keep).decode(), chunks_gone, lines_gone, total


def _cut_passages(text: str, whole: set[int], ends: set[int]) -> tuple[str, int, int, int]:
    raw, seen = text.encode(), {}
    parts = raw.split(b"\n")
    spans = [(a, b) for a, b, _, h in chunks(raw) if h and _signed(h) in whole] if whole else []
    drop, line, at, k = bytearray(len(parts)), 0, 0, 0
    for a, b, lines, h in pairs(raw):
        while at < a:
            at += len(parts[line]) + 1
            line += 1
        while k < len(spans) and spans[k][1] < b:
            k += 1
        if _signed(h) not in ends and not (k < len(spans) and spans[k][0] <= a):
            first = next((e for s, e in seen.get(h, ()) if raw[s:e] == raw[a:b]), None)
            if first is None:
                seen.setdefault(h, []).append((a, b))
            if first is None or first > a:
                continue
        drop[line : line + lines] = b"\1" * lines
    if not any(drop):
        return text, 0, 0, len(parts)
    kept = b"\n".join(p for p, d in zip(parts, drop) if not d).decode()
    return kept, drop.count(b"\0\1") + drop[0], sum(drop), len(parts)
