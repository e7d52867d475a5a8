import random

import corpus_pipeline as p
from pyspark.sql import functions as F
from texts import SCHEMA

from sabermill.llm import simhash
from sabermill.llm.shared import Scratch


def corpus():
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    clean = [(i, text(200) + "\n" + text(50)) for i in range(40)]
    near = [(100 + k, " ".join(w if j != 7 * k + 3 else "changed" for j, w in enumerate(clean[0][1].split(" ")))) for k in range(4)]
    leak = "these are ten words of a test item that leaked here"
    rows = clean + near + [(200, clean[5][1]), (201, text(30) + " " + leak.upper() + " " + text(30)), (202, None), (203, "123 ..."), (204, clean[6][1])]
    return [(i, t, "en", "s0", len(t or ""), "x", "y") for i, t in rows], leak, [i for i, _ in clean]


def test_stages(spark, tmp_path):
    rows, leak, clean = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    left = {}
    for name, stage in p.STAGES[:-1]:
        now = Scratch(spark).write(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
        left[name] = {r.doc_id for r in now.collect()}
        assert set(clean) <= left[name]
    assert not left["language_id"] & {202, 203}
    assert not left["simhash"] & {100, 101, 102, 103, 200, 204}
    assert left["decontaminate"] == set(clean)
    assert {r.doc_id for r in p.run(spark, str(tmp_path)).select("doc_id").collect()} == set(clean)
    empty = docs.where("false")
    for name, stage in p.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_hot_bucket_links_like_a_cool_one(spark, monkeypatch):
    rows, _, _ = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, simhash.near_copies(docs, Scratch(spark)).collect()))
    for bucket in (2, 4, 8):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        assert sorted(map(tuple, simhash.near_copies(docs, Scratch(spark)).collect())) == want
    assert simhash.near_copies(docs.where(F.lit(False)), Scratch(spark)).count() == 0


def test_stages_take_clashing_names(spark, tmp_path):
    """Columns named like what the stages add or use on the way are carried through with their values."""
    rows, leak, _ = corpus()
    names = ["removed_chunks", "Removed_Lines", "total_lines", "gone_id", "component", "gone", "c0", "ids"]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)]).drop("id")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in p.STAGES[:-1]:
        now = Scratch(spark).write(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
    found = now.collect()
    assert found and all([r[n] for n in names] == list(range(len(names))) for r in found)
    assert p.STAGES[-1][1](spark, now, str(tmp_path)).count() >= len(found)
