import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sabermill.llm import langid
from sabermill.llm.kernels import utf8

WORDS = {"en": ["the", "thing", "shore", "with"], "de": ["über", "schnell", "nicht", "ein"], "fr": ["où", "être", "les", "çà"]}


def rows():
    rng = random.Random(1)
    out = [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(3, 30))), lang) for i, lang in enumerate(sorted(WORDS) * 40)]
    return out + [(900, None, "en"), (901, "", "fr"), (902, "12 !! 3", "de"), (903, "über " * 40_000, None), (904, "где", None), (None, "the thing", "en")]


def test_held_out_accuracy_and_rejects(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs, F.col("id") % 4 != 2)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    test = [(i, lang) for i, _, lang in rows()[:120] if i % 4 == 2]
    assert all(got[i].lang_pred == lang for i, lang in test)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "de" and got[904].lang_pred in WORDS and all(0 <= r.score <= 1 for r in got.values())
    assert sorted(r.doc_id for r in langid.identified(docs.where("doc_id >= 900"), model).collect() if r.doc_id < 904) == [903]
    assert langid.train(docs.where("lang IS NULL"), F.lit(True)) is None
    assert langid.identify(docs.where("false"), model).count() == 0


def plain_ppm(own):
    """A context's probabilities of all 256 bytes, by counting and recursion alone."""
    seen = defaultdict(Counter)
    for t in own:
        padded = b"\n" * langid.ORDER + t
        for i in range(langid.ORDER, len(padded)):
            for k in range(langid.ORDER + 1):
                seen[padded[i - k : i]][padded[i]] += 1

    def chances(context):
        low, own = chances(context[1:]) if context else [1 / 256] * 256, seen[context]
        n, q, rest = sum(own.values()), len(own), sum(p for b, p in enumerate(low) if b not in own)
        return [own[b] / (n + q) if b in own else q / (n + q) * low[b] / rest for b in range(256)] if n else low

    return chances


def test_code_lengths_match_a_plain_model():
    rng = random.Random(2)
    texts = {k: [" ".join(rng.choices(v, k=20)).encode() for _ in range(5)] + [b""] for k, v in WORDS.items()}
    model = langid.fit(texts, {k: 1 for k in texts})
    sample = ["the être", "", "nicht\x00", "t", "zzz über thing où \U0001f600"]
    got = langid.code_lengths(model, *utf8(pa.array(sample)))
    for j, lang in enumerate(model.languages):
        chances = plain_ppm(texts[lang])
        for i, t in enumerate(sample):
            padded = b"\n" * langid.ORDER + t.encode()
            want = sum(-math.log2(chances(padded[x - langid.ORDER : x])[padded[x]]) for x in range(langid.ORDER, len(padded)))
            assert got[i, j] == pytest.approx(want, rel=1e-4)
        assert sum(chances(b"the")) == pytest.approx(1) and sum(chances(b"\n\n\n")) == pytest.approx(1)


def test_whole_texts_are_learned(spark):
    """What tells the languages apart stands behind the first megabyte of the only labelled text of each."""
    docs = spark.createDataFrame([(0, "ab " * 350_000 + "quix " * 400, "a"), (1, "ab " * 350_000 + "zorn " * 400, "b"), (2, "quix quix quix", None), (3, "zorn zorn", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.train(docs, F.lit(True))).collect()}
    assert (got[2], got[3]) == ("a", "b")


def test_nothing_labelled(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    for rows, want in ((docs, [(1, "und", 0.0), (2, "und", 0.0)]), (docs.where("false"), [])):
        model = langid.train(rows, F.lit(True))
        assert model is None
        assert sorted(tuple(r)[:3] for r in langid.identify(rows, model).collect()) == want
