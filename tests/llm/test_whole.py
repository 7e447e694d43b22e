"""Cases in which an operator once did less than the whole job."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinlink.llm import graph_search, jaccard_join, toxicity
from kinlink.llm.common import hash_words, text_buffers


def lexicon_hits(texts, lexicon, characters):
    """The lexicon words found in each text."""
    keys = np.unique(np.concatenate(hash_words(lexicon, True)))
    name = {int(hash_words([w], True)[0][0]): w for w in lexicon}
    row, place = toxicity.hits(*text_buffers(pa.array(texts)), keys, characters)
    return [{name[int(keys[k])] for k in place[row == i]} for i in range(len(texts))]


def test_toxicity_models_share_no_cache():
    characters = toxicity.Characters.of(np.ones(28**3, np.int64), ["idiot", "moron"])
    for lexicon, found in ((["idiot", "moron"], {"idiot"}), (["moron"], set()), (["clown", "dunce", "idiot", "moron"], {"idiot"}), (["ninny"], set())):
        assert lexicon_hits(["1d10t plain"], lexicon, characters) == [found]


WORDS = ["sun", "tree", "cloud", "river", "of", "stone"]


def character_table(lexicon):
    counts = np.zeros((28, 28, 28), np.int64)
    s = [0, 0, *toxicity._symbols(" ".join(WORDS * 40)), 0]
    np.add.at(counts, (s[:-2], s[1:-1], s[2:]), 1)
    return toxicity.Characters.of(counts.ravel(), lexicon)


def filler(n):
    """Whole words of n letters in all."""
    return "stone" * (n % 4) + "tree" * ((n - 5 * (n % 4)) // 4)


def test_toxicity_finds_spaced_words_at_any_place_of_a_run():
    lexicon = ["idiot", "scumbag", "worthless", "lunatic", "halfwit", "blockhead", "pighead", "numbskull", "airhead"]
    characters = character_table(lexicon)
    for word, after in (("idiot", "stone"), ("worthless", "river"), ("lunatic", "stone")):
        texts = [" ".join(filler(n) + word + after + "stonetree") for n in range(50, 131)]
        found = lexicon_hits(texts, lexicon, characters)
        assert found == [{word}] * len(texts), [n for n, f in zip(range(50, 131), found) if f != {word}]


def test_toxicity_reads_words_over_64_bytes():
    lexicon = ["idiot", "scumbag", "worthless"]
    texts = ["id" + "i" * 60 + "ot", "1d10" + "t" * 500, "w" + "." * 80 + "o.r.t.h.l.e.s.s", ".".join(filler(40) + "idiot" + "treestone"), "--".join("scumbag") + "g" * 90, "s" + "-" * 80 + "cumbag"]
    assert lexicon_hits(texts, lexicon, character_table(lexicon)) == [{"idiot"}, {"idiot"}, {"worthless"}, {"idiot"}, {"scumbag"}, {"scumbag"}]


def test_toxicity_hidden_letters_many_states_at_once(monkeypatch):
    characters = character_table(["idiot", "scumbag"])
    rng = np.random.default_rng(5)
    spans = ["s*#*b*#", "*#*#*#*", "i*#*#t", *("".join(rng.choice(list("idotscumbag*#*#.1"), 12)) for _ in range(40))]
    fast = [toxicity.decode(s, characters, p) for s in spans for p in (False, True)]
    monkeypatch.setattr(toxicity, "_hidden", lambda states, readings, logs, parts, put: slow(states, readings, logs, parts, put))

    def slow(states, readings, logs, parts, put):
        for reading, cost in readings[1:]:
            x = toxicity._symbols(reading)[0]
            for (a, b), (score, text) in states.items():
                put((b, x), score + cost + logs[a, b, x], (text, reading))
                if parts and b:
                    put((0, x), score + cost + logs[a, b, 0] - 2.0 + logs[b, 0, x], (text, " " + reading))

    assert fast == [toxicity.decode(s, characters, p) for s in spans for p in (False, True)]


@pytest.mark.parametrize("parts", [False, True])
def test_toxicity_decode_against_all_readings(parts):
    """The likeliest path through the lattice, by trying all of them."""
    characters = character_table(["idiot", "moron", "scum"])
    logs = characters.logs

    def best(span):
        """(score, text) of every way to read a span, the best of each text."""
        states = {((0, 0), ""): 0.0}
        for c, n in toxicity._segments(span):
            after = {}
            for ((a, b), text), score in states.items():
                for reading, cost in toxicity._readings(c, n):
                    for broken in (False, True) if parts and reading and b else (False,):
                        p, q, t = (b, 0, score + cost + logs[a, b, 0] - 2.0) if broken else (a, b, score + cost)
                        for x in toxicity._symbols(reading):
                            t += logs[p, q, x]
                            p, q = q, x
                        key = (p, q), text + (" " if broken else "") + reading
                        after[key] = max(t, after.get(key, -np.inf))
            states = after
        out = {}
        for ((a, b), text), score in states.items():
            out[text] = max(out.get(text, -np.inf), score + logs[a, b, 0])
        return out

    rng = np.random.default_rng(2)
    spans = ["1d10t", "m0r0n", "s.c", "ii", "i1!t", "a", "", "$cum", "s-c-u"] + ["".join(rng.choice(list("idotmn10!.$-"), int(rng.integers(1, 6)))) for _ in range(40)]
    for span in spans:
        every = best(span)
        found = toxicity.decode(span, characters, parts)
        assert found in every and np.isclose(every[found], max(every.values())), (span, found)


def _components(sets):
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("block", [1024, 16])
def test_jaccard_join_of_large_families(spark, monkeypatch, block):
    """Families of near copies whose members are far from the pivot, with their blocks whole and cut small."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = np.random.default_rng(9)
    data = []
    for f, (size, edits) in enumerate(((60, 6), (40, 9), (30, 3))):
        base = [f"w{f}x{i}" for i in range(90)]
        for _ in range(size):
            w = list(base[: int(rng.integers(70, 91))])
            for k in rng.choice(len(w), int(rng.integers(0, edits)), replace=False):
                w[k] = f"e{rng.integers(10**6)}"
            data.append((len(data), " ".join(w)))
    sets = {}
    for i, t in data:
        w = t.split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    found = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()}
    assert found == _components(sets)


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(4)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 2**63, int(rng.integers(1, 400))).astype(np.uint64)) for _ in range(2))
        both = np.unique(rng.integers(0, 2**63, int(rng.integers(0, 300))).astype(np.uint64))
        x, y = np.union1d(x, both), np.union1d(y, both)
        assert jaccard_join.differing(jaccard_join.sketch(x), jaccard_join.sketch(y)) <= len(np.setxor1d(x, y))
        assert jaccard_join.differing(jaccard_join.sketch(x), jaccard_join.sketch(x)) == 0


def test_graph_search_shards_keep_apart(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.standard_normal(8)]) for i in range(900)]
    index = graph_search.build_index(graph_search.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), 10, 200)
    assert index.count() > 3 and index.select(F.explode("ids")).count() == 900
