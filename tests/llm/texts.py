"""Small documents with every awkward case: null, empty, wordless, ties, repeats, long, other scripts, control characters."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string"


def documents():
    rng = random.Random(5)
    words = ["the", "of", "Ünder", "añejo", "don't", "it's", "42", "x9", "éa", "and", "(see)", "naïve", "straße", "世界", "ok!", "ét"]
    texts = [None, "", " \t\n", "!!! ???", "A", "a b", "Ab  C\tD\nE", "x" * 5000, "<|endoftext|> hi", "a\x1cb \x85 c\xa0d", "ΣΑΣ Σ", "İİ", "'s 't're"]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)]
    texts += [texts[20]] * 5 + [texts[21] + " tail"] + ["one two three four five six seven eight nine ten eleven twelve " * 30] * 2
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", "s2", None]), len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return rows + [rows[22]]
