"""Benchmark decontamination by one Aho-Corasick automaton over normalised item windows.

Its letters are words: each word of the benchmark has a number, every other word is 0, so that the automaton has a node a word and not a node a byte. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sabermill.llm.kernels import LOWER, release, slices, squeeze, utf8, xxh64
from sabermill.llm.rows import keep_rows

#: The automaton is built in every Python worker, at about half a kilobyte a window (measured); a test set of more distinct windows is refused, not cut.
MAX_WINDOWS = 800_000

#: After lower-casing A-Z, words are runs of 0-9, a-z and bytes of code points over U+007F.
BREAKS = np.ones(256, dtype=bool)
BREAKS[0x30:0x3A] = False
BREAKS[0x61:0x7B] = False
BREAKS[0x80:] = False

_BUILT: dict[str, tuple] = {}


@dataclass
class Windows:
    """The distinct windows of a benchmark, in flat arrays."""

    words: np.ndarray  # sorted hashes of its words; a word's number is its place + 1
    numbers: np.ndarray  # the windows' numbers, one window after the other
    starts: np.ndarray  # where each window starts there, and the end
    owners: np.ndarray  # places of the items that have each window, one window after the other
    owned: np.ndarray  # where each window's owners start, and the end
    items: list[str]
    key: str


def item_windows(items: list[tuple[str, str | None]], size: int) -> Windows:
    """Each window of ``size`` consecutive words, or an item's whole sequence if shorter, with the items that have it."""
    names = sorted({i for i, _ in items})
    at = {n: k for k, n in enumerate(names)}
    buf, offs = utf8(pa.array([t or "" for _, t in items], pa.large_string()))
    joined, starts, ends, first, _ = squeeze(LOWER[buf], offs, BREAKS)
    hashes = xxh64(joined, starts, ends - starts)
    words, number = np.unique(hashes, return_inverse=True)
    number = (number + 1).astype(np.int32)
    found: dict[bytes, set[int]] = {}
    for k, (item, _) in enumerate(items):
        a, b = int(first[k]), int(first[k + 1])
        for i in range(a, max(b - size + 1, min(a + 1, b))):
            found.setdefault(number[i : min(i + size, b)].tobytes(), set()).add(at[item])
    order = sorted(found)
    owners = [sorted(found[w]) for w in order]
    flat = np.frombuffer(b"".join(order), np.int32)
    begin = np.concatenate([[0], np.cumsum([len(w) // 4 for w in order])]).astype(np.int64)
    owned = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
    who = np.array([x for o in owners for x in o], np.int32)
    key = hashlib.sha256(b"|".join([words.tobytes(), flat.tobytes(), begin.tobytes(), who.tobytes(), owned.tobytes(), repr(names).encode()])).hexdigest()
    return Windows(words, flat, begin, who, owned, names, key)


_BUILT: dict[str, object] = {}


def _automaton(windows: Windows):
    """One automaton per worker."""
    if windows.key not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        trie = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, (a, b) in enumerate(zip(windows.starts[:-1].tolist(), windows.starts[1:].tolist())):
            trie.add_word(tuple(windows.numbers[a:b].tolist()), k)
        if len(windows.starts) > 1:
            trie.make_automaton()
        _BUILT[windows.key] = trie
    return _BUILT[windows.key]


def _shared(docs: DataFrame, benchmark: DataFrame, size: int, item_col: str, item_text_col: str):
    """The benchmark's windows, broadcast."""
    table = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    most = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if most > 40 * MAX_WINDOWS:  # no test set of so many bytes is worth collecting
        raise ValueError(f"the benchmark has {most} bytes; one automaton takes {MAX_WINDOWS} windows")
    windows = item_windows([tuple(r) for r in table.collect()], size)
    if len(windows.starts) > MAX_WINDOWS:
        raise ValueError(f"the benchmark has {len(windows.starts) - 1} windows; one automaton takes {MAX_WINDOWS}")
    return docs.sparkSession.sparkContext.broadcast(windows)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows without any hit word; see ``contamination``."""
    shared = _shared(docs, benchmark, size, item_col, item_text_col)

    def keep(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = [np.zeros(0, bool)]
        for a, b in slices(offs):
            ids = pa.nulls(b - a, pa.int64())
            out.append(~np.asarray(_scan(ids, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], shared.value).column(5)))
        return np.concatenate(out)

    return keep_rows(docs, text_col, keep)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: (doc_id, n_words, n_hit, spans array<struct<start,end>>, items array<string>, contaminated).

    A word is hit inside any occurrence of an item's window of ``size`` words. ``spans`` are the maximal runs of hit words, as code point
    offsets into the original text; ``items``: ids as text, sorted, each once. Null or wordless text: no words, clean. Items with a null id or without words
    have no windows; repeated items count once. Repeated documents keep a row each; a null id is returned. The whole text is scanned once, without a shuffle.
    """
    shared = _shared(docs, benchmark, size, item_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = utf8(batch.column(1))
            for a, b in slices(offs):
                yield _scan(batch.column(0).slice(a, b - a), buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], shared.value)
        release()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>, contaminated boolean").withColumnRenamed("id", id_col)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _occurrences(number: np.ndarray, first: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence in texts of numbered words; ``first``: words before each text."""
    if not len(windows.words) or not number.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a text's end is an unknown word, and unknown words that follow each other are one
    begins = first[:-1][np.diff(first) > 0]
    spaced = np.insert(number, begins, 0)
    place = np.insert(np.arange(len(number)), begins, -1)
    keep = spaced > 0
    keep[1:] |= keep[:-1]
    word = place[keep]
    found = list(_automaton(windows).iter(tuple(spaced[keep].tolist())))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end, which = (np.array(x, np.int64) for x in zip(*found))
    return word[end] - np.diff(windows.starts)[which] + 1, which


def _scan(ids: pa.Array, buf: np.ndarray, offs: np.ndarray, windows: Windows) -> pa.RecordBatch:
    n = len(offs) - 1
    joined, starts, ends, first, origin = squeeze(LOWER[buf], offs, BREAKS)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    hashes = xxh64(joined, starts, ends - starts)
    number = np.zeros(len(hashes), np.int64)
    if len(windows.words):
        at = np.minimum(np.searchsorted(windows.words, hashes), len(windows.words) - 1)
        number = np.where(windows.words[at] == hashes, at + 1, 0)
    word, which = _occurrences(number, first, windows)
    hit = np.zeros(len(starts) + 1, np.int64)
    items: list[list[str]] = [[] for _ in range(n)]
    if len(word):
        np.add.at(hit, word, 1)
        np.add.at(hit, word + np.diff(windows.starts)[which], -1)
        pairs = np.unique(np.stack([doc[word], which]), axis=1)
        for d, w in pairs.T.tolist():
            items[d].extend(windows.owners[windows.owned[w] : windows.owned[w + 1]].tolist())
        items = [sorted({windows.items[i] for i in x}) if x else x for x in items]
    inside = np.cumsum(hit[:-1]) > 0
    hits = np.add.reduceat(np.append(inside, False), np.minimum(first[:-1], len(inside)), dtype=np.int64) * (words > 0) if n else np.zeros(0, np.int64)
    spans: list[list] = [[] for _ in range(n)]
    if inside.any():
        chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        edge_doc = np.flatnonzero(np.diff(doc)) + 1  # a run ends with its document
        cut = edge_doc[inside[edge_doc] & inside[edge_doc - 1]]
        begins = np.union1d(np.flatnonzero(edge == 1), cut)
        stops = np.union1d(np.flatnonzero(edge == -1), cut) - 1
        for s, e in zip(begins.tolist(), stops.tolist()):
            d = int(doc[s])
            spans[d].append({"start": int(chars[origin[s]] - chars[offs[d]]), "end": int(chars[origin[e] + ends[e] - starts[e]] - chars[offs[d]])})
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(words.astype(np.int64)), pa.array(hits), pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string())), pa.array(hits > 0)],
        ["id", "n_words", "n_hit", "spans", "items", "contaminated"],
    )
