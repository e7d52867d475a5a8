import math
import re
import zlib
from collections import Counter

import pytest
from texts import SCHEMA, documents

from sabermill.llm import katz
from sabermill.llm.shared import Scratch


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), "\n"]


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


class Brute:
    def __init__(self, rows):
        self.c, self.b, self.ctx = Counter(), Counter(), Counter()
        for i, t in rows:
            if not held(i):
                w = tokens(t)
                self.c.update(w)
                self.b.update(zip(["<s>", *w], w))
                self.ctx.update(["<s>", *w[:-1]])
        self.n = sum(self.c.values())
        kinds = lambda x: [0, *(sum(1 for v in x.values() if v == r) for r in range(1, katz.TOP + 2))]
        self.d1, self.d2, n1 = katz.discounts(kinds(self.c)), katz.discounts(kinds(self.b)), kinds(self.c)
        freed = sum((1 - self.d1[r]) * r * n1[r] for r in range(1, katz.TOP + 1))
        assert freed > 0
        self.unknown = freed / self.n

    def p1(self, w):
        c = self.c[w]
        return (self.d1[c] if c <= katz.TOP else 1) * c / self.n if c else self.unknown

    def p(self, v, w):
        c = self.ctx[v]
        if not c:
            return self.p1(w)
        seen = {x: k for (u, x), k in self.b.items() if u == v}
        dis = lambda k: self.d2[k] if k <= katz.TOP else 1
        left = sum((1 - dis(k)) * k for k in seen.values()) / c
        scale = 1 if left > 0 else c / (c + 1)
        left = left or 1 / (c + 1)
        if w in seen:
            return scale * dis(seen[w]) * seen[w] / c
        return left * self.p1(w) / (1 - sum(map(self.p1, seen)))


@pytest.mark.parametrize("hot", [1024, 20])
def test_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "CHUNK_BYTES", 2000)
    rows = documents()
    model = Brute([(i, t) for i, t, *_ in rows])
    by = {i: t for i, t, *_ in rows}
    got = katz.katz_scores(spark.createDataFrame(rows, SCHEMA).repartition(2), Scratch(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        w = tokens(by[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(model.c[x] > 0 for x in w), model.n)
        assert r.base_score == pytest.approx(sum(math.log10((model.c[x] + 0.1) / (model.n + 0.1 * (len(model.c) + 1))) for x in w))
        assert r.score == pytest.approx(sum(math.log10(model.p(v, x)) for v, x in zip(["<s>", *w], w)))


def test_contexts_sum_to_one():
    model = Brute([(i, t) for i, t, *_ in documents()])
    for v in ["<s>", "the", "never seen", "é", next(iter(model.c))]:
        assert sum(model.p(v, w) for w in model.c) + model.p(v, "unknown word") == pytest.approx(1)


def test_nothing_to_learn_and_empty(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(40) if held(i)], "doc_id long, text string")
    assert docs.count() > 0
    assert all(r.score == pytest.approx(0) and r.train_tokens == 0 for r in katz.katz_scores(docs, Scratch(spark)).collect())
    assert katz.katz_scores(docs.where("false"), Scratch(spark)).count() == 0
