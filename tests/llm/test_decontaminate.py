import re

from texts import SCHEMA, documents

from sabermill.llm.decontaminate import contamination

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text):
    return [(m.group(), m.start(), m.end()) for m in re.finditer(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]


def brute(text, items, size):
    have = words(text)
    plain, hit, found = [w for w, _, _ in have], set(), set()
    for item, t in items:
        seq = [w for w, _, _ in words(t)]
        for i in range(max(len(seq) - size + 1, min(1, len(seq)))):
            win = seq[i : i + size]
            for j in range(len(plain) - len(win) + 1):
                if plain[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(str(item))
    spans = []
    for j in sorted(hit):
        if spans and j - 1 in hit:
            spans[-1][1] = have[j][2]
        else:
            spans.append([have[j][1], have[j][2]])
    return len(have), len(hit), sorted(found), spans


def test_matches_brute_force(spark):
    rows = documents()
    items = [(7, rows[30][1]), (7, rows[31][1]), (10, "The of"), (2, "x9"), (3, None), (4, "  ?"), (11, "one two three four five six seven eight nine ten eleven twelve one"), (12, rows[25][1].upper())]
    bench = spark.createDataFrame([*items, (None, "and")], "item_id long, text string")
    for size in (3, 10):
        got = contamination(spark.createDataFrame(rows, SCHEMA).repartition(2), bench, size).collect()
        assert len(got) == len(rows)
        by = {i: t for i, t, *_ in rows}
        for r in got:
            assert (r.n_words, r.n_hit, r["items"], [[s.start, s.end] for s in r.spans]) == brute(by[r.doc_id], items, size)
            assert r.contaminated == (r.n_hit > 0)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame(documents(), SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs.where("false"), bench).count() == 0
    assert contamination(docs, bench).where("contaminated").count() == 0
