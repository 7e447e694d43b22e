"""MinHash near-dedup, collocations, whitening, and what is derived from a pivot, against brute force."""

import math
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.llm import collocations, jaccard_join, minhash, whitening
from kinlink.llm.common import saved

WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def components_of(ids, linked):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def shingles(text, width):
    w = WHITE.findall(lower(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def test_minhash(spark):
    rng = np.random.default_rng(3)
    word = lambda n=500: f"w{rng.integers(n)}"
    texts = [None, "", " \n\t ", "one", "ONE", "one two", "One  two", "two one", "a " * 50, "é ö", "É ö"]
    texts += [" ".join(word() for _ in range(int(rng.integers(3, 120)))) for _ in range(60)]
    base = [word(9000) for _ in range(150)]
    for k in range(70):  # a family: some far from its pivot, some linked by way of others only
        own = list(base)
        for _ in range(int(rng.integers(0, 12))):
            own[int(rng.integers(len(own)))] = word(9000)
        texts.append(" ".join(own))
    chain = list(base)
    for _ in range(15):
        for _ in range(6):
            chain[int(rng.integers(len(chain)))] = word(9000)
        texts.append(" ".join(chain))
    texts += [texts[20], texts[75], texts[75].upper()]
    texts.append(" ".join(word(10**6) for _ in range(60_000)))
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a string, component_id string")
    found = {r.doc_id: r for r in minhash.near_duplicates(df.repartition(5)).collect()}
    sets = {i: shingles(t, 2) for i, t in enumerate(texts)}
    roots = components_of(list(sets), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    for i in sets:
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (len(sets[i]), roots[i], roots[i] == i), i
    doubled = minhash.near_duplicates(df.unionByName(df).unionByName(df.limit(3).withColumn("doc_id", F.lit(None).cast("long"))))
    assert doubled.count() == 2 * len(texts) + 3
    nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "d e f"), (None, "d e f")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in minhash.near_duplicates(nulls).collect()) == [("4", "4"), ("None", "4"), ("None", "None"), ("None", "None")]
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_minima():
    """Minima agree as often as sets are similar; a signature doesn't depend on how a set is sliced."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 9000).astype(np.uint64)
    b = np.concatenate([a[:8000], rng.integers(0, 2**63, 1000).astype(np.uint64)])
    agree = (minhash.signature(a) == minhash.signature(b)).sum()
    assert minhash.least_agreeing(80) <= agree and abs(agree / 128 - 0.8) < 0.15
    assert (minhash.signature(a[::-1].copy()) == minhash.signature(a)).all()
    assert (1 - 0.8**minhash.ROWS) ** minhash.BANDS < 1e-7


def stars_of(spark, pivot, members, reach=None):
    """Rows of verified(): members of one pivot, as sets of numbers."""
    rows = []
    for k, m in enumerate(members):
        own, lack = sorted(m - pivot), sorted(pivot - m)
        rows.append((k, 0, -1, -1, len(m), len(pivot), len(m) if reach is None else reach[k], len(m & pivot), bytearray(np.array(own + lack, np.uint64).tobytes())))
    return spark.createDataFrame(rows, "xa long, xb long, ya long, yb long, nx long, ny long, reach long, overlap long, apart binary")


@pytest.mark.parametrize("percent", [75, 80])
def test_derived(spark, percent):
    """With one tile, and with small blocks, the links found join what is linked; classes linked to the pivot are one component."""
    rng = np.random.default_rng(percent)
    pivot = set(range(1000, 1100))
    members = []
    for k in range(160):
        kind = k % 4
        if kind == 0:  # near the pivot
            m = set(pivot) - {int(x) for x in rng.integers(1000, 1100, 6)} | {int(x) for x in rng.integers(0, 900, 4)}
        elif kind == 1:  # half of it and much of one of three other sets
            other = 5000 + 100 * int(rng.integers(3))
            m = set(range(1000, 1050)) | set(range(other, other + 60)) - {int(x) for x in rng.integers(other, other + 60, 5)} | {int(rng.integers(900))}
        elif kind == 2:  # its rim
            m = set(pivot) - {int(x) for x in rng.integers(1000, 1100, 24)} | {int(x) for x in rng.integers(0, 900, 3)}
        else:
            m = {1000 + int(x) for x in rng.integers(0, 100, 30)} | {int(x) for x in rng.integers(10_000, 99_000, 60)}
        members.append(m)
    sets = [pivot, *members]
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    want = components_of(range(len(sets)), linked)
    for block in (1024, 16, 3):
        links = jaccard_join.derived(saved(stars_of(spark, pivot, members), "stars"), percent, block).collect()
        assert all(linked(r.xa + 1, r.ya + 1) for r in links)
        found = {(r.xa + 1, r.ya + 1) for r in links} | {(0, k) for k in range(1, len(sets)) if linked(0, k)}
        assert components_of(range(len(sets)), lambda a, b, f=found: (a, b) in f or (b, a) in f) == want, block


def test_tiles_of_a_long_list(spark):
    """Loosely related sets of one list: without a shared rare difference none meets; with one, blocks are skipped by reach and size."""
    rng = np.random.default_rng(5)
    pivot = set(range(40))
    loose = [set(range(10)) | {int(x) for x in rng.integers(10**6, 10**9, 30)} for _ in range(5000)]
    assert jaccard_join.derived(saved(stars_of(spark, pivot, loose), "stars"), 75, 64).count() == 0

    def count(n):
        sizes = np.round(10 * 1.3 ** (rng.random(n) * 20)).astype(int)
        rows = [(0, 0, 40, k, 0, int(s), int(s * rng.uniform(0.3, 1.0)), 5, bytearray(8 * int(s)), False) for k, s in enumerate(sizes)]
        members = spark.createDataFrame(rows, jaccard_join._MEMBER)
        blocks, asked = jaccard_join.tiles(saved(members, "members"), 75, 32)
        return blocks.select("block").distinct().count(), asked.count()

    (b1, t1), (b2, t2) = count(2000), count(8000)
    assert b2 > 3 * b1 and t1 < 0.45 * b1 * (b1 + 1) / 2 and t2 < 0.45 * b2 * (b2 + 1) / 2


def phrases_of(rows, least, longest, top=2000, nested=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {g: c for g, c in f.items() if len(g[1]) > 1 and c >= least}
    gone = {(lang, g[i : i + k]) for (lang, g), c in often.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * c >= nested * f[lang, g[i : i + k]]}
    out = []
    for (lang, g), a in often.items():
        if (lang, g) not in gone:
            score, k = min((10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            out.append((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(lang, r, *o[1:]) for r, o in enumerate(own[:top], 1)]
    return sorted(ranked)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("longest", [3, 4])
def test_collocations(spark, longest):
    rng = np.random.default_rng(longest)
    vocabulary = ["the", "Of", "new", "york", "city", "é", "ß", "a\x01b", "x-y", "10", " ", "😀"]
    rows = [(None, "en"), ("", None), ("...,\n", "en"), ("new york", None)]
    for _ in range(150):
        words = [vocabulary[int(x)] for x in np.minimum(rng.geometric(0.25, int(rng.integers(1, 60))) - 1, 11)]
        sep = [" ", "  ", "\t", ", ", ".", "\n", "\r\n", "! ", "new york city ", " "]
        rows.append(("".join(w + sep[int(rng.integers(10))] for w in words), [None, "en", "fr", "und", "e"][int(rng.integers(5))]))
    rows.append(("New York City. " * 30_000, "fr"))
    df = spark.createDataFrame([(t, lang, 0, "p") for t, lang in rows], "text string, lang string, size int, phrase string").repartition(6)
    for bits, least in ((1 << 23, 5), (64, 5), (1 << 23, 1)):  # a filter that lets all through changes nothing
        found = collocations.collocations(df, least=least, longest=longest, per_bucket=5000, filter_bits=bits, top=40)
        assert found.columns == COLUMNS
        assert sorted(tuple(r) for r in found.collect()) == phrases_of(rows, least, longest, 40), (bits, least)
    assert collocations.collocations(df.limit(0)).collect() == [] and collocations.collocations(df.filter("text IS NULL")).collect() == []


def test_exact_scores(spark):
    """Products beyond 64 bits."""
    cases = [(10**14, 10**14, 10**14), (10**14, 10**14 + 1, 10**14), (3 * 10**13, 10**14, 9 * 10**13 + 7), (10, 10, 10**14)]
    df = spark.createDataFrame(cases, "a long, l long, r long")
    found = df.select("a", "l", "r", collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x.s == 10**6 * x.a * x.a // (x.l * x.r) for x in found)


def test_summaries():
    """Whatever is merged in whatever order: who has ``least`` occurrences survives, and counters stay few."""
    rng = np.random.default_rng(2)
    for least in (2, 10, 50):
        parts = []
        for _ in range(30):
            key, n = np.unique(np.minimum(rng.zipf(1.2, 2000), 10**6).astype(np.uint32), return_counts=True)
            parts.append((key, n.astype(np.int64)))
        total = Counter()
        for key, n in parts:
            total.update(dict(zip(key.tolist(), n.tolist(), strict=True)))
        mass = sum(total.values())
        summary = collocations.Summary(mass // least + 1)
        for part in parts:
            summary.add(*part)
            assert len(summary.key) <= mass // least + 1
        survivors = set(summary.over(least).tolist())
        assert summary.taken < least and {k for k, c in total.items() if c >= least} <= survivors and len(survivors) < len(total)


def close(r):
    values, vectors = whitening.right_singular(np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))]))
    exact = np.linalg.svd(r, compute_uv=False) ** 2
    exact = np.concatenate([exact, np.zeros(len(values) - len(exact))])
    real = exact > 1e-14 * exact.max()
    assert np.all(np.abs(values - exact)[real] <= 1e-12 * exact[real])
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(r.T @ (r @ vectors) - vectors * values).max() <= 1e-12 * max(exact.max(), 1e-300)


def test_solver():
    """Singular values to relative accuracy and orthogonal vectors: graded, repeated, without rank, of one entry."""
    rng = np.random.default_rng(0)
    tri = lambda a: np.linalg.qr(a, mode="r")
    x = rng.standard_normal((300, 40))
    q = np.linalg.qr(x)[0]
    close(tri(x))
    close(tri(x * np.logspace(0, -6, 40)))
    close(tri(x[:, ::-1] * np.logspace(0, -6, 40)))
    close(tri(q))
    close(tri(q * np.where(np.arange(40) < 20, 3.0, 1.0)))
    close(tri(np.hstack([x, x[:, :5], np.zeros((300, 2))])))
    close(np.eye(6))
    close(tri(x[:, :1]))
    close(tri(x[:4, :9]))
    close(np.array([[3.0, 1e-160], [0.0, 2.0]]))


def test_whitening(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((700, 12)) * np.linspace(3, 0.2, 12)
    base[:, 7] = base[:, 2]  # no rank of its own
    rows = [(i, [float(v) for v in b]) for i, b in enumerate(base)] + [(5, [float(v) for v in base[5]]), (None, [0.0] * 12)]
    odd = [(900, None), (901, []), (902, [float("nan")] * 12), (903, [None] * 12), (904, [1.0] * 11), (905, [float("inf")] + [0.0] * 11), (906, [-float("inf")] * 12)]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows + odd], "vec_id long, embedding array<double>, whitened double, n int").repartition(40)
    found = whitening.whitened(df, 32).collect()
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 10**6
    n, s = len(x), x.sum(0)
    v = (x - s / n).T @ (x - s / n) / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert {r.component for r in found} == set(range(1, 12)) and len(found) == 11 * n and {r.n for r in found} == {n}
    assert max(r.identity_error for r in found) < 1e-9 and not {r.vec_id for r in found} & set(range(900, 910))
    by = {}
    for r in found:
        if r.vec_id is not None and r.vec_id != 5:
            by[r.vec_id, r.component] = r
    for c in range(1, 12):
        want = (x - s / n) @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        got = np.array([by[i, c].whitened for i in range(700) if i != 5])
        want = np.delete(want[:700], 5)
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert math.isclose(by[1, c].explained, values[c - 1] / np.trace(v), rel_tol=1e-9)
    assert all(r.deviation == Decimal(sum(int(y) ** 2 for y in (n * x[i] - s))) for (i, _), r in by.items())
    few = whitening.whitened(df, 3)
    assert few.count() == 3 * n and [f.name for f in few.schema] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whitened(df.limit(0)).collect() == [] and whitening.whitened(df.filter("vec_id = 1")).collect() == []
    alike = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert whitening.whitened(alike).collect() == []
