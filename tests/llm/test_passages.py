"""Line dedup by passages, against a brute force over runs of lines that knows neither chunks nor pairs."""

import random

from test_dedup import passages
from texts import SCHEMA

from sabermill.llm import linededup, queries
from sabermill.llm.shared import Scratch


def runs(lines):
    """(first, last) of each run of lines that begins and ends with a non-blank one and has two of them at least."""
    full = [i for i, p in enumerate(lines) if p.strip()]
    return [(a, b) for k, a in enumerate(full) for b in full[k + 1 :]]


def brute(rows):
    """The text that each (id, text) keeps: a line goes if it lies in a run that a smaller id has, or that ended earlier in its own text."""
    of = [None if t is None else t.split("\n") for _, t in rows]
    first = {}
    for (i, _), lines in zip(rows, of):
        for a, b in runs(lines or []) if i is not None else []:
            key = tuple(lines[a : b + 1])
            first[key] = min(i, first.get(key, i))
    out = []
    for (i, t), lines in zip(rows, of):
        gone, ended = set(), {}
        for a, b in runs(lines or []):
            key = tuple(lines[a : b + 1])
            ended[key] = min(b, ended.get(key, b))
        for a, b in runs(lines or []):
            key = tuple(lines[a : b + 1])
            if ended[key] < a or (i is not None and first[key] < i):
                gone |= set(range(a, b + 1))
        out.append((i, t if t is None else "\n".join(p for k, p in enumerate(lines) if k not in gone)))
    return out


def corpus():
    rng = random.Random(11)
    line = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps", "zêta", "eta"], k=rng.randint(5, 12)))
    short = [(r[0], "\n".join((r[1] or "").split("\n")[:40]) if r[1] else r[1]) for r in passages()]
    shared = [[line() for _ in range(n)] for n in (2, 3, 4, 7, 20)]
    shared[3][2:2] = ["", " \t"]
    for k in range(30):
        own = [line() for _ in range(rng.randint(0, 4))]
        at = rng.randint(0, len(own))
        own[at:at] = shared[k % 5]
        short.append((1000 + k, "\n".join(own)))
    short += [(2000 + k, "\n".join(shared[k])) for k in range(5)] + [(3000, "a b\nsame\nsame\nsame\nend"), (3001, "x\ny\nz\nx\ny\n\nz\nx\ny")]
    return short


def test_whole_passages_go(spark):
    rows = corpus()
    full = [(i, t, "en", "s", 0, "x", "y") for i, t in rows]
    out = linededup.passage_dedup(spark.createDataFrame(full, SCHEMA).repartition(3).withColumnRenamed("id", "hash"), Scratch(spark)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted([(r.doc_id, r.text) for r in out], key=key) == sorted(brute(rows), key=key)
    for r in out:
        if r.text is not None and r.removed_lines < r.total_lines:
            assert r.text.count("\n") + 1 == r.total_lines - r.removed_lines and (r.removed_chunks > 0) == (r.removed_lines > 0)
    assert all(r.text == "" for r in out if r.doc_id is not None and 2000 <= r.doc_id < 2005)


def test_query_removes_whole_passages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.kept_bytes) for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(i, None if t is None else len(t.encode())) for i, t in brute(rows)}
