import hashlib
import random

import numpy as np
from texts import SCHEMA, documents

from sabermill.llm import linededup, suffix
from sabermill.llm.shared import Scratch


def passages():
    rng = random.Random(9)
    line = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps", "zêta"], k=rng.randint(3, 12)))
    shared = [line() for _ in range(12)]
    out = [[line() for _ in range(rng.randint(1, 9))] for _ in range(30)]
    for i in range(0, 30, 3):
        at = rng.randint(0, len(out[i]))
        out[i][at:at] = shared if i % 2 else [*shared, *shared]
    texts = ["\n".join(x) for x in out] + ["same\n" * 300, "", None, "\n\n\n", "x", "é" * 70, "é" * 70 + "!"]
    rows = [(i, t, "en", "s", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return rows + [(len(rows), texts[4], "en", "s", 1, "x", "y"), (None, texts[3], "en", "s", 1, "x", "y")]


def line_brute(rows):
    """Chunks by document; a chunk goes if a smaller id has the same bytes, or if it stood earlier in the same text."""
    first = {}
    for i, t in rows:
        if i is not None and t and "\n" in t:
            for a, b, _, h in linededup.chunks(t.encode()):
                if h:
                    c = t.encode()[a:b]
                    first[c] = min(i, first.get(c, i))
    out = []
    for i, t in rows:
        if t is None or "\n" not in t:
            out.append((i, t))
            continue
        kept, seen = [], set()
        for a, b, _, h in linededup.chunks(t.encode()):
            c = t.encode()[a:b]
            if not h or (c not in seen and (i is None or first[c] == i)):
                kept.append(c)
            seen.add(c)
        out.append((i, b"\n".join(kept).decode()))
    return out


def test_line_dedup(spark):
    rows = passages()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumnRenamed("id", "hash").withColumnRenamed("fp", "text2")
    out = linededup.line_dedup(docs, Scratch(spark))
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=key) == sorted(line_brute([(r[0], r[1]) for r in rows]), key=key)
    assert out.columns[:-3] == docs.columns and out.where("removed_chunks > 0").count() > 5
    assert linededup.line_dedup(docs.where("false"), Scratch(spark)).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b\nc d\ne f", 7, 8, 9), (2, "x\na b\nc d\ny", 7, 8, 9)], "doc_id long, text string, removed_chunks long, Removed_Lines long, total_lines long")
    assert linededup.added_columns(docs.columns) == ["removed_chunks_", "removed_lines_", "total_lines_"]
    for way in (linededup.line_dedup, linededup.passage_dedup):
        out = way(docs, Scratch(spark))
        assert out.columns == [*docs.columns, "removed_chunks_", "removed_lines_", "total_lines_"]
        assert all((r.removed_chunks, r.Removed_Lines, r.total_lines) == (7, 8, 9) for r in out.collect())
    assert {r.doc_id: (r.text, r.removed_lines_) for r in out.collect()} == {1: ("a b\nc d\ne f", 0), 2: ("x\ny", 2)}


def test_query_takes_clashing_names(spark, tmp_path):
    from sabermill.llm.queries import op7_line_dedup

    spark.createDataFrame([(1, "a b\nc d", 7, 8)], "doc_id long, text string, total_lines long, removed_chunks long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.total_lines for r in op7_line_dedup(spark, str(tmp_path)).collect()] == [2]


def test_chunks_cover_the_text_and_resist_shifts():
    for t in [r[1].encode() for r in passages() if r[1]]:
        parts = linededup.chunks(t)
        assert b"\n".join(t[a:b] for a, b, _, _ in parts) == t and sum(n for _, _, n, _ in parts) == t.count(b"\n") + 1
        assert all(n <= linededup.MOST for _, _, n, _ in parts)
        own, moved = {h for *_, h in parts if h}, {h for *_, h in linededup.chunks(b"one more line\n" + t) if h}
        assert len(own - moved) <= 1


def suffix_brute(rows):
    """The contract by plain look-up of every string: (n_bytes, n_removed, n_spans, kept_sha256) by id."""
    least, raw, out, size = {}, {i: (t or "").encode() for i, t in rows}, {}, suffix.LENGTH
    for i, b in raw.items():
        for s in range(len(b) - size + 1):
            w = b[s : s + size]
            least[w] = min(i, least.get(w, i))
    for i, b in raw.items():
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if least[b[s : s + size]] < i:
                gone[s : s + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()
    return out


def test_longest_previous_factors_match_brute_force():
    rng = random.Random(3)
    for _ in range(25):
        base = bytes(rng.choices(b"ab\0", k=150))
        segments = []
        for _ in range(6):
            x = bytearray(rng.choice([base, bytes(rng.choices(b"ab", k=60)) + base[:80], b"a" * rng.randint(50, 120), base[20:]]))
            if rng.random() < 0.5:
                x[rng.randrange(len(x))] = 120
            segments.append(bytes(x))
        docs = sorted(rng.randint(0, 4) for _ in segments)
        want = []
        for s, d in zip(segments, docs):
            for i in range(len(s)):
                best = 0
                for other in (o for o, e in zip(segments, docs) if e < d):
                    for j in range(len(other)):
                        k = 0
                        while k < 56 and i + k < len(s) and j + k < len(other) and s[i + k] == other[j + k]:
                            k += 1
                        best = max(best, k)
                want.append(best if best >= suffix.LENGTH else 0)
        offs = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
        assert suffix.previous_factors(np.frombuffer(b"".join(segments), np.uint8), offs, np.array(docs)).tolist() == want


def test_suffix_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 3000)
    rows = [*passages()[:-1], *[(100 + r[0], *r[1:]) for r in documents()[:-1]]]
    want = suffix_brute([(r[0], r[1]) for r in rows])
    got = suffix.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), Scratch(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id]
    lone = spark.createDataFrame([(None, "z" * 80, "", "", 0, "", ""), (1, "z" * 80, "", "", 0, "", "")], SCHEMA)
    assert all(len(r.kept) == 80 for r in suffix.remove_repeats(lone, Scratch(spark)).collect())
    assert suffix.remove_repeats(lone.where("false"), Scratch(spark)).count() == 0
