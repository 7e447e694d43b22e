"""Pairs of texts in blocks against brute force."""

import re

import pandas as pd

from kinlink.operators import overlap


def test_pairs_in_blocks_equal_brute_force(spark, monkeypatch):
    texts = ["a b c", "A, b; c!", "c d", "", None, "d", "é ü", "a b c d e", "x"]
    rows = [(i, texts[i % 9], "en" if i % 2 else "de", 3 if i % 5 else 4) for i in range(120)] + [(200, "a", None, 3), (201, "a", "en", None), (202, "a b", "fr", 1), (None, "a", "en", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    words = {i: {w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w} for i, t, _, _ in rows}
    expected = {}
    for i, _, g, n in rows:
        for j, _, h, m in rows:
            if None not in (i, j, g, n) and (g, n) == (h, m) and i < j:
                both, either = len(words[i] & words[j]), len(words[i] | words[j])
                expected[i, j] = both / either if either else 0.0
    held = []
    whole = overlap._block_pairs
    for most in (500, 7):
        found = overlap.jaccard_pairs(docs, ["lang", "n_chars"], "n_chars", most).collect()
        assert len(found) == len(expected) and {(r.a_id, r.b_id): r.jaccard for r in found} == expected
    # equal sets are compared once, however many texts have them
    monkeypatch.setattr(overlap, "_shares", lambda w, a, b, f=overlap._shares: held.append((len(a), len(b))) or f(w, a, b))
    copies = pd.DataFrame({"doc_id": range(50), "words": ["a b", "c"] * 25, "block": 0, "low": 0, "high": 0})
    assert len(whole(copies)) == 50 * 49 / 2 and held == [(2, 2)]
