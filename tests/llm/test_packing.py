import zlib

import numpy as np
import public_tokenizers
import pytest
from texts import SCHEMA, documents
from tokenizers import Tokenizer

from sabermill.llm.packing import Mixture, pack, sequences
from sabermill.llm.shared import Scratch


def ids_of(text):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*whole.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("weights", [None, {"s0": 0.2, "s1": 0.5, "s2": 0.2, "": 0.1}])
def test_pieces_cover_every_id_once(spark, weights):
    rows = documents()
    pieces = pack(spark.createDataFrame(rows, SCHEMA).repartition(3), Scratch(spark), window=64, weights=weights).collect()
    want = {i: ids_of(t) for i, t, *_ in rows}
    got = {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append(p)
    assert got.keys() == want.keys()
    for doc, ids in want.items():
        copies = 2 if doc == rows[22][0] else 1
        have = sorted(got[doc], key=lambda p: p.start)
        assert sum(p.length for p in have) == copies * len(ids)
        for p in have:
            part = np.frombuffer(p.ids, "<u4").tolist()
            assert part == ids[p.start : p.start + p.length] and p.doc_tokens == len(ids) and p.length > 0
    filled = {}
    for p in pieces:
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    total = sum(len(want[i]) for i, *_ in rows)
    assert sorted(filled) == list(range(-(-total // 64)))
    for s, parts in filled.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == (64 if s < len(filled) - 1 else total - 64 * (len(filled) - 1))


def test_windows_hold_the_target_proportions():
    totals = np.array([100_000, 50_000, 7, 30_000])
    mix = Mixture(totals, None, 256)
    served = mix.served(np.arange(mix.windows + 1))
    assert (served[-1] == totals).all() and (np.diff(served, axis=0) >= 0).all()
    credit = np.outer(np.minimum(np.arange(mix.windows + 1) * 256, totals.sum()), totals / totals.sum()) - served
    assert abs(credit).max() <= 2
    given = Mixture(totals, np.array([1.0, 1.0, 1.0, 2.0]), 256)
    served = given.served(np.arange(given.windows + 1))
    assert served[40].tolist() == pytest.approx([(10240 - 7) / 4, (10240 - 7) / 4, 7, (10240 - 7) / 2], abs=2)
    assert (served[-1] == totals).all() and (np.diff(served, axis=0) >= 0).all()


def test_sequences_and_empty_table(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = sequences(pack(docs, Scratch(spark), window=64), window=64).collect()
    assert all(len(r.ids) == 64 for r in out)
    assert pack(docs.where("false"), Scratch(spark)).count() == 0


def test_digest_matches_contract(spark, tmp_path):
    from sabermill.llm.queries import op1_packing

    rows = documents()[:-1]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: ids_of(t) for i, t, *_ in rows}
    for p in op1_packing(spark, str(tmp_path)).collect():
        assert p.ids_crc32 == zlib.crc32(np.array(want[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())


def check_windows(pieces, window, total):
    filled = {}
    for p in pieces:
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(filled) == list(range(-(-total // window)))
    for s, parts in filled.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end == (window if s < len(filled) - 1 else total - window * (len(filled) - 1))


def test_two_thousand_sources_keep_their_names_and_shares(spark, monkeypatch):
    from sabermill.llm import packing

    monkeypatch.setattr(packing, "QUEUES", 8)
    rows = [(i, "some words here", f"s{i % 500}" if i % 2 else f"big{i % 3}") for i in range(4000)]
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), Scratch(spark), window=256).collect()
    total = sum(p.length for p in pieces)
    check_windows(pieces, 256, total)
    of, size, covered = {i: s for i, _, s in rows}, pieces[0].doc_tokens, {}
    for p in pieces:
        assert p.source == of[p.doc_id]
        covered.setdefault(p.doc_id, []).append((p.start, p.length))
    for own in covered.values():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == size
    by = {}
    for p in pieces:
        if p.source == "s77":
            by[p.sequence_id] = by.get(p.sequence_id, 0) + p.length
    half = max(p.sequence_id for p in pieces) // 2
    assert abs(sum(n for s, n in by.items() if s < half) - sum(by.values()) / 2) <= 2 * size


@pytest.mark.parametrize("share", [1e-9, 1e-3])
def test_a_rare_source_takes_memory_of_its_tokens_alone(share):
    totals = np.array([int(2000 / share), 2000, 10**6])
    mix = Mixture(totals, None, 2048)
    first = mix.cuts(1, 0, 2000)
    w = mix.window_of(np.full(2000, 1), np.arange(2000))
    assert (np.diff(w) >= 0).all() and first.tolist() == (np.flatnonzero(np.diff(w) > 0) + 1).tolist()
    begin, place = mix.starts(w, np.full(2000, 1))
    assert (begin <= np.arange(2000)).all() and (place < 2048).all()
    low, high = mix.served(w)[:, 1], mix.served(w + 1)[:, 1]
    assert ((low <= np.arange(2000)) & (np.arange(2000) < high)).all()


def test_ranks_are_a_permutation():
    mix = Mixture(np.array([5, 5, 3, 0, 11]), np.array([1.0, 1.0, 2.0, 1.0, 1.0]), 4)
    ranks = np.concatenate([mix.rank(np.full(n, q), np.arange(n)) for q, n in enumerate([5, 5, 3, 0, 11])])
    assert sorted(ranks.tolist()) == list(range(24))


def test_weights_must_name_every_source_with_documents(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "doc_id long, text string, source string")
    for bad in ({"x": 1.0}, {"x": 1.0, "": 0.0}, {"x": None, "": 1.0}):
        with pytest.raises(ValueError, match="positive weight"):
            pack(docs, Scratch(spark), weights=bad)
    assert pack(docs, Scratch(spark), weights={"x": 1.0, "": 2.0, "absent": None}).count() == 2
