"""Language identification by prediction by partial matching over bytes.

For each language a context tree of orders 0 to ``ORDER`` is counted on a bounded sample of labelled rows, whole texts each, and then frozen: in a context seen n times with q
distinct successors, a successor seen c times has probability c / (n + q), and the escape probability q / (n + q) is shared by the unseen bytes in proportion to their
probability in the context that is one byte shorter; under order 0 lie equal chances for all 256 bytes. So every context's probabilities sum to one, and a text's code length under
a language is an exact sum of logarithms. Every context and every byte seen is kept.

The trees of a group of languages are laid out together: a context is a row, and the successors that any of the languages has seen there are entries of one long array, in which the rows are
pushed into each other so that a row's entries stand at its offset plus the byte (row displacement). A byte without an entry costs the row's escape and is looked up again in the row of
the context that is one byte shorter. Beyond ``GROUP`` languages there is one such table for each group of them, and texts are scored by one table after the other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from sabermill.llm.kernels import slices, utf8
from sabermill.llm.rows import keep_rows

ORDER = 3
#: The fit: so many labelled rows of each language, those with the smallest hash of their id first; their texts are whole.
SAMPLE_DOCS = 400
#: Languages of a table.
GROUP = 4

_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray  # class of each byte; bytes never seen share the last one
    rows: np.ndarray  # row of the longest known part of each context of ORDER classes
    offset: np.ndarray  # place of each row's entries
    shorter: np.ndarray  # row of the context that is one byte shorter; -1 under the shortest
    owner: np.ndarray  # row whose entry stands at each place, or -1
    cost: np.ndarray  # (place, language): bits of the entry's byte, or NaN where the language has not seen it there
    escape: np.ndarray  # (row, language): bits of an escape
    floor: np.ndarray  # bits of a byte under order 0, by class
    prior: np.ndarray  # bits of each language


@dataclass
class Groups:
    """More than GROUP languages: a broadcast model of each group of them, of which a worker holds one at a time."""

    languages: list[str]
    parts: list[Broadcast]
    prior: np.ndarray  # bits of each language

    @property
    def value(self) -> Groups:
        return self


def _prior(languages: list[str], counts: dict[str, int]) -> np.ndarray:
    shares = np.array([counts.get(x, 0) + 1 for x in languages], np.float64)
    return -np.log2(shares / shares.sum())


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each byte with the ORDER bytes before it (the latest lowest but one; line ends before the start), and how often each stands in the text."""
    s = np.frombuffer(b"\n" * ORDER + text, np.uint8).astype(np.int64)
    code = np.zeros(len(text), np.int64)
    for k in range(ORDER + 1):
        code = code << 8 | s[k : len(s) - ORDER + k]
    return np.unique(code, return_counts=True)


def _displaced(row: np.ndarray, symbol: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the rows of a sparse table (entries sorted by row) such that no two entries share a place, and each place's row or -1.

    The fullest rows first; a row goes to the first fit after the last row with as many entries, and rows of one entry fill the gaps.
    """
    at = np.searchsorted(row, np.arange(rows + 1))
    offset, owner, step = np.zeros(rows, np.int64), np.full(len(row) + 4 * width, -1, np.int32), 1024
    singles: list[int] = []
    after: dict[int, int] = {}
    for r in np.argsort(-np.diff(at), kind="stable").tolist():
        own = symbol[at[r] : at[r + 1]].tolist()
        if len(own) == 1:
            singles.append(r)
        elif own:
            o = after.get(len(own), 0)
            while True:
                if o + step + width >= len(owner):
                    owner = np.append(owner, np.full(len(owner) + step, -1, np.int32))
                taken = owner[o + own[0] : o + own[0] + step] >= 0
                for x in own[1:]:
                    taken |= owner[o + x : o + x + step] >= 0
                if not taken.all():
                    break
                o += step
            o += int(taken.argmin())
            offset[r], after[len(own)] = o, o
            owner[o + np.array(own)] = r
    if singles:  # rows of one entry fill the gaps
        if (short := len(singles) + width - int((owner[width:] < 0).sum())) > 0:
            owner = np.append(owner, np.full(short, -1, np.int32))
        r = np.array(singles)
        place = width + np.flatnonzero(owner[width:] < 0)[: len(r)]
        offset[r] = place - symbol[at[r]]
        owner[place] = r
    used = int(np.flatnonzero(owner >= 0)[-1]) + 1 if (owner >= 0).any() else 0
    return offset, np.append(owner[:used], np.full(width + max(int(offset.max(initial=0)) - used, 0), -1, np.int32))


def fit(texts: dict[str, list[bytes]], prior: dict[str, int]) -> Model:
    """The model of whole texts by language; ``prior``: documents by language."""
    counts = {}
    for lang, own in texts.items():
        codes, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*map(grams, own)) if own else ((), ())))
        u, back = np.unique(codes, return_inverse=True)
        counts[lang] = u, np.bincount(back, n, len(u)).astype(np.int64)
    return fit_counts(counts, prior)


def fit_counts(grams_of: dict[str, tuple[np.ndarray, np.ndarray]], prior: dict[str, int]) -> Model:
    """The model of counted ``grams`` by language."""
    languages = sorted(grams_of)
    seen = np.zeros(256, bool)
    seen[10] = True
    for codes, _ in grams_of.values():
        seen[codes & 255] = True
    classes = np.full(256, seen.sum(), np.int64)
    classes[seen] = np.arange(seen.sum())
    a = int(seen.sum()) + 1
    weight = np.ones(a)
    weight[-1] = 256 - seen.sum()
    # (context, byte) codes in classes by order, and counts by language
    tables: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(ORDER + 1):
        parts = []
        for j, lang in enumerate(languages):
            codes, n = grams_of[lang]
            code = np.zeros(len(codes), np.int64)
            for back in range(k, -1, -1):
                code = code * a + classes[codes >> 8 * back & 255]
            parts.append((code, np.full(len(code), j), n))
        code, j, n = (np.concatenate(x) for x in zip(*parts))
        entry, back = np.unique(code, return_inverse=True)
        table = np.zeros((len(entry), len(languages)))
        np.add.at(table, (back, j), n)
        tables.append((entry, table))
    # rows by order; p: probability of each byte class, of one row's children at a time
    shorter, escape, all_rows, all_symbols, all_bits = [], [], [], [], []
    index = np.zeros(1, np.int64)  # row of each context of the order before
    first = 0
    lower_of = None
    for k, (entry, count) in enumerate(tables):
        context = entry // a
        names, row = np.unique(context, return_inverse=True) if k else (np.zeros(1, np.int64), np.zeros(len(entry), np.int64))
        total = np.zeros((len(names), len(languages)))
        kinds = np.zeros_like(total)
        np.add.at(total, row, count)
        np.add.at(kinds, row, count > 0)
        up = index[names % a ** (k - 1)] if k else np.array([-1])
        # chances that the shorter context gives the bytes seen here: what is left is for the unseen
        if k == 0:
            chance = np.repeat((1 / 256 * weight)[entry % a][:, None], len(languages), axis=1)
        else:
            chance = lower_of(up[row], entry % a)
        taken = np.zeros_like(total)
        np.add.at(taken, row, np.where(count > 0, chance, 0.0))
        rest = 1 - taken
        full = rest <= 1e-9  # every byte was seen: nothing to escape to
        n = total[row]
        q = np.where(full, 0, kinds)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(count > 0, count / (n + q[row]), np.nan)
            factor = np.where(total == 0, 1.0, np.where(full, 1e-300, q / (total + q) / np.where(full, 1.0, rest)))
            bits, out = -np.log2(p), -np.log2(factor)
        shorter.append(up)
        escape.append(out)
        all_rows.append(row + first)
        all_symbols.append(entry % a)
        all_bits.append(bits)
        index = np.full(a**k, -1, np.int64) if k else np.zeros(1, np.int64)
        if k:
            index[names] = first + np.arange(len(names))
        below, base = lower_of, first

        def lower_of(rows, symbols, entry=entry, names=names, p=p, factor=factor, below=below, up=up, base=base, k=k):
            """Probability of byte classes in rows of this order."""
            r = rows - base
            code = names[r] * a + symbols
            at = np.minimum(np.searchsorted(entry, code), len(entry) - 1)
            here = (entry[at] == code)[:, None] & ~np.isnan(p[at])
            deeper = np.repeat((1 / 256 * weight)[symbols][:, None], len(languages), axis=1) if below is None else below(up[r], symbols)
            return np.where(here, np.nan_to_num(p[at]), factor[r] * deeper)

        first += len(names)
    # the longest known part of every context of ORDER classes
    reach = np.zeros(1, np.int64)
    at = 0
    for k, up in enumerate(shorter):
        if k:
            reach = np.tile(reach, a)  # the oldest class is highest, so a context's shorter one repeats
            names = np.unique(tables[k][0] // a)
            reach[names] = at + np.arange(len(names))
        at += len(up)
    offset, owner = _displaced(np.concatenate(all_rows), np.concatenate(all_symbols), first, a)
    cost = np.full((len(owner), len(languages)), np.nan, np.float32)
    cost[offset[np.concatenate(all_rows)] + np.concatenate(all_symbols)] = np.concatenate(all_bits)
    return Model(languages, classes.astype(np.int32), reach.astype(np.int32), offset.astype(np.int32), np.concatenate(shorter).astype(np.int32), owner, cost, np.concatenate(escape).astype(np.float32), np.full(a, 8.0, np.float32), _prior(languages, prior))


def byte_bits(model: Model, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """(byte, language): code length of each byte class in the row of its context, escapes to shorter contexts included."""
    place = model.offset[row] + symbol
    out = model.cost[place]
    out[model.owner[place] != row] = np.nan
    left = np.flatnonzero(np.isnan(out).any(axis=1))  # a language that lacks the byte goes on alone
    if len(left):
        escaped, row, symbol = np.zeros((len(left), out.shape[1]), np.float32), row[left], symbol[left]
        need = np.isnan(out[left])
        while len(left):
            escaped += np.where(need, model.escape[row], 0)
            row = model.shorter[row]
            low = row < 0
            place = model.offset[row] + symbol
            got = np.where((model.owner[place] == row)[:, None], model.cost[place], np.nan)
            got[low] = model.floor[symbol[low], None]
            done = need & ~np.isnan(got)
            at, lang = np.nonzero(done)
            out[left[at], lang] = escaped[done] + got[done]
            need &= ~done
            more = need.any(axis=1)
            left, row, symbol, escaped, need = left[more], row[more], symbol[more], escaped[more], need[more]
    return out


def code_lengths(model: Model, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(text, language): bits of each whole text."""
    n, a = len(offs) - 1, len(model.floor)
    out = np.zeros((n, len(model.languages)))
    start = int(model.classes[10])
    for lo, hi in slices(offs, 1 << 18):
        b, o = model.classes[buf[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo]
        at = 0
        while at < len(b):  # a very long text goes in parts
            to = min(at + (1 << 19), len(b))
            code = np.zeros(to - at, np.int32)
            for k in range(1, ORDER + 1):
                prev = np.full(to - at, start, np.int32)
                have = max(k - at, 0)
                prev[have:] = b[at + have - k : to - k]
                for j in range(k):
                    cut = o[:-1] + j
                    cut = cut[(cut < o[1:]) & (cut >= at) & (cut < to)] - at
                    prev[cut] = start
                code += prev * a ** (k - 1)
            cost = byte_bits(model, model.rows[code], b[at:to])
            first = int(np.searchsorted(o, at, "right")) - 1
            last = int(np.searchsorted(o, to, "left"))
            docs = np.arange(first, last)
            docs = docs[o[docs + 1] > o[docs]]
            if len(docs):
                out[lo + docs] += np.add.reduceat(cost, np.maximum(o[docs], at) - at, axis=0, dtype=np.float64)
            at = to
    return out


def train(docs: DataFrame, labelled: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | Groups | None:
    """Fits on at most SAMPLE_DOCS rows of each language where ``labelled`` holds and language and text are not null.

    None without any such row. Languages are counted over all labelled rows. Only ids and languages are ranked, and of these a few times SAMPLE_DOCS by a bound on the hash; the whole texts
    of the ranked rows alone are then counted where they lie, ORDER + 1 bytes at a time, and added up by language. The driver holds the distinct strings of ORDER + 1 bytes of one group of at
    most GROUP languages at a time, however long the texts are. Rows that share an id and a language all count.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(labelled).where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    prior = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not prior:
        return None
    spark = docs.sparkSession
    hashed = rows.select("id", "lang", F.xxhash64("id").alias("h"))

    def ranked(part: DataFrame) -> list:
        order = Window.partitionBy("lang").orderBy("h", "id")
        return part.withColumn("k", F.row_number().over(order)).where(f"k <= {SAMPLE_DOCS}").select("id", "lang").collect()

    # of a language's hashes only so many of the smallest that the sample is among them are ranked; where many rows share few ids that may fail, and then all are
    bounds = spark.createDataFrame([(x, -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 4 * SAMPLE_DOCS // n)) for x, n in prior.items()], "lang string, bound long")
    first = ranked(hashed.join(F.broadcast(bounds), "lang").where("h <= bound").drop("bound"))
    got = Counter(r["lang"] for r in first)
    if any(got[x] < min(SAMPLE_DOCS, n) for x, n in prior.items()):
        first = ranked(hashed)
    chosen = spark.createDataFrame(sorted({(r["id"], r["lang"]) for r in first}), rows.select("id", "lang").schema)
    part = rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi").select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                codes, n = grams(text.as_py().encode())
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    found = part.mapInArrow(counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))

    def own_counts(found: DataFrame, languages: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        table = found.toArrow()
        lang, code, n = np.asarray(table["lang"]), np.asarray(table["code"]), np.asarray(table["n"])
        out = {}
        for x in languages:
            on = np.flatnonzero(lang == x)
            on = on[np.argsort(code[on])]
            out[x] = code[on], n[on]
        return out

    languages = sorted(prior)
    if len(languages) <= GROUP:
        return fit_counts(own_counts(found, languages), prior)
    n = -(-len(languages) // GROUP)
    cuts = [len(languages) * i // n for i in range(n + 1)]
    found, parts = found.persist(StorageLevel.DISK_ONLY), []
    for lo, hi in zip(cuts, cuts[1:]):
        own = languages[lo:hi]
        parts.append(docs.sparkSession.sparkContext.broadcast(fit_counts(own_counts(found.where(F.col("lang").isin(own)), own), prior)))
    found.unpersist()
    return Groups(languages, parts, _prior(languages, prior))


def _shared(docs: DataFrame, model: Model | Groups) -> Broadcast | Groups:
    return model if isinstance(model, Groups) else docs.sparkSession.sparkContext.broadcast(model)


def _all_lengths(model: Model | Groups, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(text, language): bits of each whole text, by one group's table after the other."""
    if isinstance(model, Model):
        return code_lengths(model, buf, offs)
    found = []
    for part in model.parts:
        found.append(code_lengths(part.value, buf, offs))
        part.__dict__.pop("_value", None)  # a worker would keep every table that it has read
    return np.concatenate(found, axis=1)


def identify(docs: DataFrame, model: Model | Groups | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: (id, lang_pred, score, bits_per_byte) from its whole text alone.

    ``score``: the posterior of the language from code lengths and the learned shares of languages. Null texts and texts without a letter: 'und', score 0.
    Without a model, as nothing was labelled, every row is 'und'. Ties go to the language first in code point order. Repeated rows keep a row each. One pass without a shuffle; the size of a table
    is bounded by what SAMPLE_DOCS rows of GROUP languages hold, and the number of tables and the work grow with the languages.
    """
    if model is None:
        return docs.select(F.col(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, rate = predict(shared.value, *utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rate)], ["id", "lang_pred", "score", "bits_per_byte"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, bits_per_byte double").withColumnRenamed("id", id_col)


def predict(model: Model | Groups, buf: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, posterior, bits a byte) of each text."""
    size, bits = np.diff(offs), _all_lengths(model, buf, offs)
    letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf])])
    ok = letters[offs[1:]] > letters[offs[:-1]]
    for i in np.flatnonzero(~ok & (size > 0)):
        ok[i] = _LETTER.search(buf[offs[i] : offs[i + 1]].tobytes().decode()) is not None
    total = bits + model.prior
    best = total.argmin(axis=1) if len(total) else np.zeros(0, np.int64)
    least = total[np.arange(len(total)), best]
    score = np.where(ok, 1 / np.exp2(least[:, None] - total).sum(axis=1), 0.0)
    rate = np.where(size > 0, bits[np.arange(len(total)), best] / np.maximum(size, 1), 0.0)
    return [model.languages[b] if k else "und" for b, k in zip(best, ok)], score, rate


def identified(docs: DataFrame, model: Model | Groups, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose language is found with a posterior of ``least`` or more; null texts and texts without a letter go."""
    shared = _shared(docs, model)
    return keep_rows(docs, text_col, lambda buf, offs: predict(shared.value, buf, offs)[1] >= least)
