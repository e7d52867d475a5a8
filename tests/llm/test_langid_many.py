import random

from pyspark.sql import functions as F

from sabermill.llm import langid


def test_every_labelled_language_is_learned(spark):
    rng = random.Random(3)
    words = {f"l{k:02d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(4)] for k in range(100)}
    rows = [(8 * k + j, " ".join(rng.choices(words[lang], k=15)), lang) for k, lang in enumerate(words) for j in range(8 if k < 94 else 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs, F.col("doc_id") % 8 != 2)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    test = [(i, lang) for i, _, lang in rows if i % 8 == 2]
    assert {lang for _, lang in test} == set(words) == set(model.languages)
    assert [lang for i, lang in test if got[i].lang_pred != lang] == []
    assert all(got[i].score > 0.5 for i, _ in test)
    assert langid.identified(docs, model).count() == len(rows)


def test_groups_score_like_their_tables(spark):
    words = {"a": "the thing", "b": "über nicht", "c": "où être", "d": "çà les", "e": "uno due tre"}
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(words.items())], "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    assert [len(p.value.languages) for p in model.parts] == [2, 3] and abs((2.0**-model.prior).sum() - 1) < 1e-9
    got = {r.doc_id: r.bits_per_byte for r in langid.identify(docs, model).collect()}
    alone = langid.fit({k: [words[k].encode()] for k in "ab"}, {"a": 1, "b": 1})
    import pyarrow as pa

    bits = langid.code_lengths(alone, *langid.utf8(pa.array([words["a"]])))[0, 0]
    assert abs(got[0] - bits / len(words["a"])) < 1e-6
