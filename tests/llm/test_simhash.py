import re

import numpy as np
import pytest
import xxhash
from texts import SCHEMA, documents

from sabermill.llm import simhash
from sabermill.llm.shared import Scratch


def fingerprint(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, distance):
    """Brute force over all pairs of (id, fingerprint)."""
    comp = {i: i for i, _ in values}
    changed = True
    while changed:
        changed = False
        for i, a in values:
            for j, b in values:
                if (a ^ b).bit_count() <= distance and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return comp


def test_documents_match_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = simhash.near_duplicates(docs, Scratch(spark), words=3, distance=2).collect()
    prints = {i: fingerprint(t, 3) for i, t, *_ in rows}
    want = classes(list(prints.items()), 2)
    assert len(got) == len(rows)
    for r in got:
        assert r.fp & (2**64 - 1) == prints[r.id] and r.component == want[r.id]


@pytest.mark.parametrize(("distance", "bucket"), [(1, 8192), (2, 8192), (2, 4), (3, 8192), (3, 4)])
def test_links_match_brute_force(spark, monkeypatch, distance, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 2**63, 6).tolist()
    values = {0, 2**64 - 1, 1 << 63}
    for b in base:
        for _ in range(15):
            values.add(b)
            for bit in rng.choice(64, rng.integers(1, 3), replace=False).tolist():
                b ^= 1 << bit
    values = [(i, v) for i, v in enumerate(sorted(values))]
    prints = spark.createDataFrame([(v - 2**64 if v >> 63 else v, i) for i, v in values], "fp long, rep long")
    links = simhash.hamming_links(prints, distance, Scratch(spark)).collect()
    by = dict(values)
    assert all((by[r.a] ^ by[r.b]).bit_count() <= distance for r in links)
    comp = {i: i for i in by}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for r in links:
        a, b = root(r.a), root(r.b)
        comp[max(a, b)] = min(a, b)
    assert {i: root(i) for i in by} == classes(values, distance)


def test_empty_table_and_null_id(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    assert simhash.near_duplicates(docs.where("false"), Scratch(spark)).count() == 0
    lone = simhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "a b c")], "doc_id long, text string"), Scratch(spark)).collect()
    assert {(r.id, r.component) for r in lone} == {(None, None), (4, 4)}


@pytest.mark.parametrize("bucket", [8192, 4, 2])
@pytest.mark.parametrize("distance", [1, 3])
def test_odd_distances_lose_no_link(spark, monkeypatch, distance, bucket):
    """Members that meet at a value beside a smaller one that is too far from one of them."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    far = 0 if distance == 1 else (1 << 40) | (1 << 50)
    values = [0, 0b111] + [1 << i for i in range(3)] + [(1 << i | 1 << j) ^ far for i in range(3) for j in range(i)] if distance == 3 else [0, 3, 2, 7, 1 << 20, 1 << 20 | 1]
    rows = list(enumerate(sorted(set(values))))
    prints = spark.createDataFrame([(v, i) for i, v in rows], "fp long, rep long")
    links = [(r.a, r.b) for r in simhash.hamming_links(prints, distance, Scratch(spark)).collect()]
    comp = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert comp == classes(rows, distance)


def jaccard(a, b, size=5):
    sets = []
    for t in (a, b):
        words = t.split()
        sets.append({" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("bits", [None, 20])
def test_near_copies_against_brute_force(spark, bits):
    """Verified: no group without similar documents. Recall of pairs at 0.80 to 0.85, the hardest, is at least 0.9, with wide keys as with blocks."""
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(3000)]
    rows, pairs = [], 0
    for g in range(300):
        words = rng.choice(vocab, 200).tolist()
        changed = list(words)
        for at in rng.choice(180, int(rng.integers(3, 7)), replace=False) + 5:
            changed[at] = "changed"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(changed))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: r.component for r in simhash.near_copies(docs, Scratch(spark), bits=bits).collect()}
    found = 0
    for g in range(300):
        s = jaccard(rows[2 * g][1], rows[2 * g + 1][1])
        assert got[2 * g] == 2 * g and (got[2 * g + 1] == 2 * g + 1 or s >= 0.8)
        if s >= 0.8:
            pairs += s < 0.85
            found += s < 0.85 and got[2 * g + 1] == 2 * g
    assert pairs > 60 and found >= 0.9 * pairs


def test_near_copies_keep_nulls_and_repeated_ids_apart(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, " \t"), (5, text + " end"), (6, "one two three four five six")]
    got = sorted((r.id, r.component) for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect())
    assert got == [(1, 1), (1, 1), (5, 1), (6, 6)]
