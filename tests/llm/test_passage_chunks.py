"""Passages are found by content-defined chunks first, and by pairs of lines only where no chunk repeats."""

import random

import corpus_pipeline as p
from test_passages import brute, corpus
from texts import SCHEMA

from sabermill.llm import linededup
from sabermill.llm.shared import Scratch


def few_lines():
    """Many texts of few different lines, so that chunks and pairs repeat in every way, inside a text and across."""
    rng = random.Random(21)
    lines = ["a b", "c", "d e f", "g", "", " ", "h i j", "k"]
    return [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 14)))) for i in range(150)] + [(i, "\n".join(rng.choices(lines, k=9))) for i in (3, 3, 40, None, None)]


def rows_of(found):
    return [(i, t, "en", "s", 0, "x", "y") for i, t in found]


def test_line_stage_of_the_pipeline_compares_chunks(spark, monkeypatch):
    """The chunks that a smaller document has are compared whole, in bytes; pairs inside them aren't looked at, and what stays is as by brute force."""
    rng = random.Random(22)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(300)]
    long = [(5000 + i, "\n".join(" ".join(rng.choices(vocab, k=6)) for _ in range(60))) for i in range(4)]
    cut = [(i + 100, "own first line of this\n" + t[t.index("\n", 200) + 1 :] + "\nown last line " + str(i)) for i, t in long]
    rows = [(i, t) for i, t in corpus() if i is not None and t] + long + cut
    written = {}
    write = Scratch.write

    def spy(self, df, name):
        written[name] = write(self, df, name)
        return written[name]

    monkeypatch.setattr(Scratch, "write", spy)
    out = p.line_dedup_stage(spark, spark.createDataFrame(rows_of(rows), SCHEMA).repartition(3), "")
    kept = dict(brute(rows))
    assert {r.doc_id: r.text for r in out.collect()} == {i: kept[i] for i, t in rows if kept[i] == t or kept[i].strip()}

    held, first = {i: {t.encode()[a:b] for a, b, _, h in linededup.chunks(t.encode()) if h} for i, t in rows}, {}
    for i in sorted(held):
        for c in held[i]:
            first.setdefault(c, i)
    want = {(i, c) for i, found in held.items() for c in found if first[c] < i}
    assert {(r.id, bytes(r.bytes)) for r in written["bytes"].where("whole AND id <> first").collect()} == want and len(want) > 50
    looked = {(r.id, r.hash) for r in written["units"].where("NOT whole").collect()}
    spoken = 0
    for i, t in rows:
        inside, loose = linededup.chunk_pairs(t.encode())
        raw = {h: t.encode()[a:b] for a, b, _, h in linededup.chunks(t.encode()) if h}
        apart = loose.union(*(x for h, x in inside.items() if (i, raw[h]) not in want))
        assert {h for j, h in looked if j == i} == {linededup._signed(h) for h in apart}
        spoken += len(set().union(*inside.values()) - apart)
    assert spoken > 100


def test_chunks_and_pairs_together_lose_no_line(spark):
    rows = few_lines()
    out = linededup.passage_dedup(spark.createDataFrame(rows_of(rows), SCHEMA).repartition(5), Scratch(spark)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.text) for r in out], key=key) == sorted(brute(rows), key=key)


def test_each_pair_is_inside_one_chunk_or_in_none():
    for _, t in [*corpus(), *few_lines()]:
        raw = (t or "").encode()
        inside, loose = linededup.chunk_pairs(raw)
        whole = [c for c in linededup.chunks(raw) if c[3]]
        assert set(inside) == {h for *_, h in whole}
        for a, b, _, h in linededup.pairs(raw):
            around = [c for x, y, _, c in whole if x <= a and b <= y]
            assert len(around) <= 1 and (h in inside[around[0]] if around else h in loose)
