import random

import corpus_pipeline as p
from texts import SCHEMA

from sabermill.llm.shared import Scratch


def test_exact_copies_of_many_lines_go_whole(spark, tmp_path):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    texts = ["\n".join(" ".join(rng.choices(vocab, k=rng.randint(4, 12))) for _ in range(n)) for n in range(3, 51)]
    rows = [(i, t, "en", "s0", len(t), "x", "y") for i, t in enumerate(texts)] + [(100 + i, t, "en", "s0", len(t), "x", "y") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "ten words that stand in none of these texts here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in p.STAGES[:2]:
        now = Scratch(spark).write(stage(spark, now, str(tmp_path)), name)
    assert sorted((r.doc_id, r.text) for r in now.collect()) == [(i, t) for i, t in enumerate(texts)]
    assert {r.doc_id for r in p.run(spark, str(tmp_path)).select("doc_id").collect()} == set(range(len(texts)))
