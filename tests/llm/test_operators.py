"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinlink.llm import components, decontaminate, graph_search, jaccard_join, language_id, license_scan, line_dedup, mixing, pitman_yor, token_counts, toxicity
from kinlink.llm.common import hash_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 int, size int, score string"
LONG = "alpha beta gamma delta epsilon " * 20_000
COPY = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    None, "", "  ", "...", LONG, COPY, COPY, COPY.replace("word3 ", "other "), COPY.upper(), "one two", "one two", "Repeated Line\nown line 1", "repeated line \nown line 2", "\trepeated line\n\nx",
    "Licensed under the Apache License, Version 2.0.\nmit license MIT License", "a b c d e f g h i j k l m n", "x a b c d e f g h i j y a b c", "été über straße", "12345 !!!",
]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None][i % 3], 0, 1, 2, "x") for i, t in enumerate(TEXTS)]
    data.append((len(TEXTS), TEXTS[9], "en", "s1", 0, 1, 2, "x"))
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_license_scan(spark, docs, empty, monkeypatch):
    found = by_id(license_scan.scan(docs))
    for i, t in enumerate(TEXTS):
        w = tokens(t)
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = found[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert r.first_word == (min(k for k, _ in places) if places else None) and 0 <= r.score <= 1
    assert set(found[14].base_labels.split(",")) <= set(found[14].labels.split(","))
    # templates are met by containment, at every place of a text, and long ones too
    text, label = next(iter(license_scan.TEMPLATES.items()))
    filler = [f"filler{i}" for i in range(200)]
    placed = {i: " ".join([*filler[:i], *text.split()[:-2], *filler[i:]]) for i in range(0, 200, 7)}
    met = by_id(license_scan.scan(spark.createDataFrame(list(placed.items()), "doc_id long, text string")))
    size = len(set(tokens(text)))
    assert all(label in r.labels.split(",") and math.isclose(r.score, len(set(tokens(placed[i])) & set(tokens(text))) / size) for i, r in met.items())
    long = " ".join(f"clause{i}" for i in range(60))
    monkeypatch.setitem(license_scan.TEMPLATES, long, "long-text")
    placed = {i: " ".join([*filler[:i], long, *filler[i:]]) for i in range(0, 200, 7)}
    met = by_id(license_scan.scan(spark.createDataFrame(list(placed.items()), "doc_id long, text string")))
    assert all((r.labels, r.score) == ("long-text", 1.0) for r in met.values())
    assert license_scan.scan(empty).count() == 0


def test_token_counts(docs, empty):
    import public_tokenizers

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = token_counts.load(path)
    found = by_id(token_counts.count_tokens(docs, path, table_size=8, per_task=4, cache_size=50))
    for i, t in enumerate(TEXTS):
        assert (found[i].n_tokens, found[i].n_bytes) == (len(model.encode(t or "")), len((t or "").encode()))
        assert found[i].over_limit == (found[i].n_tokens > 4096)
    assert token_counts.count_tokens(empty, path).count() == 0
    rng = np.random.default_rng(1)
    for _ in range(300):
        t = "".join(rng.choice(list("ab the \n\t▁éß漢😀<s>"), rng.integers(0, 30)))
        assert len(model.encode(t)) == sum(token_counts.Lengths(path, 9)[k] for k in token_counts.pre_tokens(t)) if t else True


@pytest.mark.parametrize("most", [1000, 0])
def test_line_dedup(docs, empty, most):
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    texts = [*TEXTS, TEXTS[9]]
    held = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    found = by_id(line_dedup.dedup_lines(docs, min_docs=2, broadcast_keys=most))
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[key(x)] < 2]
        assert (found[i].text, found[i].n_lines_, found[i].n_dropped_) == ("\n".join(kept), len(lines), len(lines) - len(kept))
        assert found[i].h1 == 1 and found[i].score == "x"
    assert line_dedup.dedup_lines(empty, broadcast_keys=most).count() == 0


def test_line_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, 3, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(1, 1, 1), (k + 10, 0, 1)], "h1 long, h2 long, n long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert [(r.h1, r.h2) for r in runs.frequent().collect()] == [(1, 1)]


@pytest.mark.parametrize("windows", [1000, 3])
def test_decontaminate(spark, docs, empty, windows):
    items = [(1, "a b c d e f g h i j k"), (2, "one TWO"), (3, None), (4, "c d e f g h i j k l"), (10, "a b c d e f g h i j k"), (5, "...")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = by_id(decontaminate.contamination(docs, table, 10, windows))
    for i, t in enumerate(TEXTS):
        w, hit, names = tokens(t), set(), set()
        for item, text in items:
            b = tokens(text)
            n = min(10, len(b))
            for win in {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else ():
                for at in range(len(w) - n + 1):
                    if tuple(w[at : at + n]) == win:
                        hit |= set(range(at, at + n))
                        names.add(str(item))
        assert (found[i].n_words, found[i].n_hit, found[i]["items"]) == (len(w), len(hit), sorted(names)), i
    assert decontaminate.contamination(empty, table).count() == 0
    assert decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).filter("n_hit > 0").count() == 0


def test_pitman_yor(spark, docs, empty):
    rows = [(100 + i, " ".join(f"w{(i * j) % 13}" for j in range(30))) for i in range(60)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    texts = {**dict(enumerate([*TEXTS, TEXTS[9]])), **dict(rows)}
    train = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*words(t), "\0end"])
    n, v = sum(train.values()), len(train)
    key = lambda w: int(pitman_yor.END) if w == "\0end" else int(hash_words([w], False)[0][0])
    as_context = lambda w: int(np.uint64(key(w)) & pitman_yor.BITS)
    for share, hot in ((0.01, 20), (0.5, 10**5)):  # with many heavy tokens, and with none; with few hot pairs, and with all
        found = by_id(pitman_yor.score(more, share=share, hot_pairs=hot))
        assert len(found) == len(texts)
        # the seatings that the same seed gives, read pair by pair
        state, parents, spread = pitman_yor.trained(more.filter(F.crc32(F.col("doc_id").cast("string")) % 7 != 2), 24, share=share)
        pairs, own = {}, {}
        for row in state.collect():
            s = pitman_yor.State(row)
            for i in range(len(s.c)):
                pair = int(s.token[s.word[i]]), int(s.contexts[s.place[i]])
                assert pair not in pairs and all(1 <= t[i] <= s.c[i] for t in s.t)
                pairs[pair] = int(s.c[i]), [int(t[i]) for t in s.t]
            for i, w in enumerate(s.token):
                own[int(w)] = [int(t[i]) for t in s.parent_t]
        assert sum(c for c, _ in pairs.values()) == n and len({w for w, _ in pairs}) == v
        if share == 0.5:
            assert not len(spread.value.heavy)
        by_context, by_token = {}, {}
        for (w, u), (c, t) in pairs.items():
            by_context.setdefault(u, []).append((c, t))
            by_token.setdefault(w, []).append(t)

        def probability(w, u, k):
            p = parents[k]
            customers = sum(t[k] for t in by_token.get(w, []))
            at = list(p.heavy).index(w) if w in p.heavy else -1
            tables = p.heavy_tables[at] if at >= 0 else own[w][k] if w in own else 0
            up = (customers - pitman_yor.D0 * tables + (pitman_yor.S0 + pitman_yor.D0 * p.tables) / (v + 1)) / (pitman_yor.S0 + p.customers)
            c, t = pairs.get((w, u), (0, [0] * len(parents)))
            whole, opened = sum(x for x, _ in by_context.get(u, [])), sum(x[k] for _, x in by_context.get(u, []))
            return (c - pitman_yor.D1 * t[k] + (pitman_yor.S1 + pitman_yor.D1 * opened) * up) / (pitman_yor.S1 + whole)

        for u in (as_context("\0end"), as_context("w3"), as_context("nowhere")):
            for k in range(len(parents)):
                assert math.isclose(sum(probability(w, u, k) for w in by_token) + probability(1, u, k), 1.0, rel_tol=1e-9)
        for i, t in texts.items():
            told = [*words(t), "\0end"]
            r = found[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(told), sum(train[w] > 0 for w in told), n)
            assert math.isclose(r.base_score, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in told), rel_tol=1e-9, abs_tol=1e-9)
            if len(told) > 1000:
                continue
            before = map(as_context, ["\0end", *told])
            slow = sum(math.log10(sum(p) / len(p)) for u, w in zip(before, map(key, told)) for p in [[probability(w, u, k) for k in range(len(parents))]])
            assert math.isclose(r.score, slow, rel_tol=1e-6), (i, r.score, slow)
    assert pitman_yor.score(empty).collect() == []


def test_seating():
    """Tables of one dish against all probabilities, from all of them and by weighted paths."""
    rng = np.random.default_rng(0)
    for c, x in ((10, 0.2), (10, 3.0), (300, 0.05), (300, 4.0), (300, 60.0), (1000, 30.0)):
        weights = pitman_yor.log_stirling(0.85, 1000)[c, 1 : c + 1] + np.arange(1, c + 1) * np.log(x)
        exact = np.cumsum(np.exp(weights - weights.max()))
        for limit in (1000, 64):
            found = np.cumsum(np.bincount(pitman_yor.seat(np.full(4000, c), np.full(4000, x), 0.85, rng, limit), minlength=c + 1)[1:]) / 4000
            assert np.abs(found - exact / exact[-1]).max() < 0.04, (c, x, limit)
    t = pitman_yor.seat(np.array([0, 1, 2, 50, 10**7]), np.full(5, 100.0), 0.85, rng)
    assert t[0] == 0 and t[1] == 1 and 1 <= t[2] <= 2 and 90 < t[4] < 150


def test_seating_work(monkeypatch):
    """Many sizes of dishes are seated in few steps, and a path evaluates few gamma functions for each table."""
    calls, evaluated = [], []
    chosen, log_gamma = pitman_yor._chosen, pitman_yor._log_gamma
    monkeypatch.setattr(pitman_yor, "_chosen", lambda w, rng: calls.append(w.shape) or chosen(w, rng))
    monkeypatch.setattr(pitman_yor, "_log_gamma", lambda z: evaluated.append(len(z)) or log_gamma(z))
    rng = np.random.default_rng(0)
    c = np.arange(2, 1001)
    t = pitman_yor.seat(c, np.full(len(c), 3.0), 0.85, rng)
    assert (1 <= t).all() and (t <= c).all() and len(calls) < 60
    t = pitman_yor.seat(np.full(40, 5000), np.full(40, 30.0), 0.85, rng)
    assert sum(evaluated) < 6 * pitman_yor.PATHS * t.sum()


def test_numbers_and_lookups():
    rng = np.random.default_rng(0)
    for x in (np.zeros(0, np.int64), np.array([0, 1, 254, 255, 256, 2**40]), rng.geometric(0.01, 5000)):
        assert np.array_equal(pitman_yor._numbers(pitman_yor._squeezed(x)), x) and np.array_equal(pitman_yor._unpacked(pitman_yor._packed(x)), x)
    top = np.uint64(2**64 - 1)
    for keys in ([], [0], [top], [0, 5, top], rng.integers(0, 2**63, 3000), rng.integers(0, 2**48, 3000), np.arange(300)):
        keys = np.unique(np.array(keys, np.uint64))
        asked = np.concatenate([keys, keys + np.uint64(1), np.array([0, 1, 2**47, top], np.uint64)])
        found, place = pitman_yor.Lookup(keys)(asked)
        assert np.array_equal(found, np.isin(asked, keys)) and np.array_equal(keys[place[found]], asked[found])


def test_variables_by_key():
    keys = np.arange(100_000).astype(np.uint64)
    for shape in (0.4, 1.0, 7.0):
        g = pitman_yor.gammas(np.full(len(keys), shape), keys, 5)
        assert abs(g.mean() - shape) < 0.05 and abs(g.var() - shape) < 0.1 * shape + 0.03
        assert np.array_equal(g[7:9], pitman_yor.gammas(np.full(2, shape), keys[7:9], 5))
    for mass in (0.3, 2.6):
        y = pitman_yor.tempered(mass, 0.6, keys, 3)
        for s in (0.5, 1.0, 4.0):
            assert abs(np.exp(-s * y).mean() - math.exp(-mass * ((1 + s) ** 0.6 - 1))) < 0.01


def test_sweeps_against_exact_posterior():
    """The chain of whole sweeps over two contexts and their parent against the posterior, with all seatings counted."""
    from itertools import product
    from types import SimpleNamespace

    D0, S0, D1, S1 = pitman_yor.D0, pitman_yor.S0, pitman_yor.D1, pitman_yor.S1
    c, place, word = np.array([6, 3, 4]), np.array([0, 1, 0]), np.array([0, 0, 1])  # (token 0, contexts 0 and 1), (token 1, context 0)
    up, low, lg = pitman_yor.log_stirling(D0, 20), pitman_yor.log_stirling(D1, 20), math.lgamma
    weight, exact = 0.0, np.zeros(5)
    for t in product(*(range(1, n + 1) for n in c)):
        customers = np.bincount(word, t)
        opened = np.bincount(place, t)
        own = sum(low[n, k] for n, k in zip(c, t)) + sum(k * math.log(D1) + lg(S1 / D1 + k) for k in opened) - lg(S0 + customers.sum())
        for t0 in product(*(range(1, int(n) + 1) for n in customers)):
            k = sum(t0)
            p = math.exp(own + k * math.log(D0 / 3) + lg(S0 / D0 + k) + sum(up[int(n), i] for n, i in zip(customers, t0)))
            weight += p
            exact += p * np.array([*t, *t0])
    exact /= weight
    row = {"bucket": 0, "tokens": pitman_yor._packed(np.array([11, 22], np.uint64)), "sizes": pitman_yor._packed(np.array([2, 1])), "contexts": pitman_yor._packed(np.array([33, 44], np.uint64)), "place": pitman_yor._packed(place), "c": pitman_yor._squeezed(c), "t": [pitman_yor._squeezed(np.ones(3, np.int64))], "parent_t": [pitman_yor._squeezed(np.ones(2, np.int64))]}
    rng, none, sums, n = np.random.default_rng(1), np.zeros(0), np.zeros(5), 3000
    for k in range(n):
        s = pitman_yor.State(row)
        customers, tables = np.bincount(s.word, s.t[0]), s.parent_t[0]
        parent = pitman_yor.Parent(float(customers.sum()), float(tables.sum()), 2, 13, none.astype(np.uint64), none, none, none, rng.gamma(S0 / D0 + tables.sum()), k + 1, heavy_mass=none)
        mass = parent.masses(s.token, customers, tables).sum() + parent.masses(np.ones(1, np.uint64), np.zeros(1), np.zeros(1))[0]
        known = SimpleNamespace(value=pitman_yor.replace(parent, mass=float(mass)))
        answers = pd.DataFrame([{"at": 0, "t": [pitman_yor._squeezed(np.bincount(s.place, s.t[0]).astype(np.int64))]}])
        row = pitman_yor._swept(known, [], k + 1)(pd.DataFrame([row]), answers).iloc[0].to_dict()
        sums += [*pitman_yor._numbers(row["t"][0]), *pitman_yor._numbers(row["parent_t"][0])]
    assert np.abs(sums / n - exact).max() < 0.12, (sums / n, exact)


def test_jaccard_join(spark, empty):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice([f"v{i}" for i in range(400)], 60)) for _ in range(8)]
    data = [(i, t) for i, t in enumerate(TEXTS)]
    for b in base:
        for _ in range(12):
            w = b.split()
            for k in rng.choice(60, rng.integers(0, 4), replace=False):
                w[k] = f"n{rng.integers(1000)}"
            data.append((len(data), " ".join(w)))
    data += [(1000 + i, "common passage shared by many texts of all kinds here " + str(i) + " " + " ".join(rng.choice([f"z{j}" for j in range(50)], i % 5))) for i in range(40)]
    sets = {}
    for i, t in data:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    found = by_id(jaccard_join.near_duplicates(df))
    for i in ids:
        assert (found[i].n_shingles, found[i].component_id) == (len(sets[i]), root(i)), i
    assert jaccard_join.near_duplicates(empty).count() == 0
    doubled = jaccard_join.near_duplicates(df.unionByName(df))
    assert doubled.count() == 2 * len(ids)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 101), (7, 3)], "u long, v long")
    found = {r.node: r.label for r in components.components(edges).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


def test_mixing(spark, docs, empty):
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 4}") for i, n in enumerate(np.random.default_rng(2).integers(0, 200, 400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = by_id(mixing.mix(df.repartition(7)))
    goal = mixing.targets([(s, sum(len(t.split()) for _, t, x in rows if x == s)) for s in sorted({s for _, _, s in rows})])
    for i, t, s in rows:
        assert found[i].size == len(t.split()) and math.isclose(found[i].target, goal[s]) and found[i].copies <= 3
    for s, g in goal.items():
        taken = sum(r.size * r.copies for r in found.values() if r.source == s)
        assert abs(taken - g) <= 200
    assert {i: r.copies for i, r in by_id(mixing.mix(df.repartition(2))).items()} == {i: r.copies for i, r in found.items()}
    assert mixing.mix(docs).count() == len(TEXTS) + 1 and mixing.mix(empty).count() == 0
    out = mixing.emit(docs)
    assert out.columns == [*docs.columns, "copy_"]
    # rows of one id are drawn each by themselves, and names may clash
    repeated = df.withColumn("doc_id", F.col("doc_id") % 15).withColumn("copy_", F.lit(0)).withColumn("n_", F.lit(0)).withColumn("rows_", F.lit(0))
    mixed, drawn = mixing.mix(repeated), mixing.emit(repeated)
    assert drawn.columns == [*repeated.columns, "copy__"]
    assert drawn.filter("text <> ''").select(F.sum(F.size(F.split("text", " ")))).first()[0] == mixed.filter("copies > 0 AND size > 0").select(F.sum(F.col("copies") * F.col("size"))).first()[0]
    assert mixing.emit(empty).count() == 0
    assert mixing.targets([("a", 0), (None, 10), ("b", 10)]) == {"a": 0.0, "b": 8.0, None: 12.0}


def test_graph_search(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[700:760] = x[3]
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    odd = [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [None] * 16), (2400, [1.0]), (2500, [2.0]), (0, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    found = graph_search.search(df, 100, 10, shard_size=800).collect()
    exact = x.astype(float)
    hits = 0
    queries = [i for i in range(0, 1500, 100)]
    for q in queries:
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(math.isclose(r.score, d[r.vec_id]) for r in own)
        hits += len({r.vec_id for r in own} & set(best))
        if q == 700:
            assert [r.vec_id for r in own] == [3, *range(701, 710)]
    assert hits >= 0.9 * 10 * len(queries)
    assert [(r.vec_id, r.score) for r in found if r.query_id == 2400] == [(2500, 1.0)]
    assert {r.query_id for r in found} == {*queries, 2400, 2500}
    assert graph_search.search(df.limit(0)).count() == 0
    # repeated rows take no other row's place
    few = spark.createDataFrame([(1, [1.0, 2.0])] * 12 + [(2, [1.0, 2.0]), (3, [5.0, 2.0]), (100, [1.0, 2.0])] * 2, "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in graph_search.search(few, 100, 2).orderBy("rank").collect()] == [(1, 0.0), (2, 0.0)]


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = language_id.Network.new(["a", "b", "c"], rng)
    for name in ("by_byte", "recurrent", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    text = rng.integers(0, 256, (6, 5)).astype(np.uint8)
    label, weight = np.array([0, 1, 2, 1, 0]), np.ones((6, 5))
    weight[4:, 2] = 0

    def loss():
        p = language_id.position_labels(net, text)
        return -(np.log(p[:, label, np.arange(5)]) * weight).sum() / weight.sum()

    for part, grad in zip(net.parts(), language_id._gradients(net, text, label, weight), strict=True):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in part.shape)
            if part is net.by_byte:
                at = (at[0], at[1], int(text[0, 0]))
            part[at] += 1e-3
            up = loss()
            part[at] -= 2e-3
            down = loss()
            part[at] += 1e-3
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-3


def test_network_reads_each_byte_by_the_recurrence():
    """The pooled probabilities against a plain pass, byte by byte."""
    rng = np.random.default_rng(1)
    net = language_id.Network.new(["a", "b", "c"], rng)
    net.bias += rng.standard_normal(net.bias.shape).astype(np.float32)
    texts = [b"", b"x", "straße über".encode(), bytes(rng.integers(0, 256, 200, dtype=np.uint8))]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(text, k):
        h, out = np.zeros(net.hidden), []
        for byte in text if k == 0 else reversed(text):
            x, u = net.by_byte[k][:, byte].astype(float), net.recurrent[k].astype(float) @ h
            n = net.hidden
            z, r = sigmoid(x[:n] + u[:n]), sigmoid(x[n : 2 * n] + u[n : 2 * n])
            new = np.tanh(x[2 * n :] + r * (u[2 * n :] + net.bias[k][:, 0]))
            h = (1 - z) * new + z * h
            out.append(h)
        return out if k == 0 else out[::-1]

    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = language_id.pooled(net, data, bounds)
    for text, p in zip(texts, found, strict=True):
        sums = np.zeros(3)
        for at in range(0, len(text), language_id.WINDOW):
            # past a text's end a window holds zeros
            window = text[at : at + language_id.WINDOW]
            whole = window + b"\0" * (language_id.WINDOW - len(window))
            for f, b in list(zip(states(whole, 0), states(whole, 1), strict=True))[: len(window)]:
                y = net.out.astype(float) @ np.concatenate([f, b]) + net.out_bias[:, 0]
                sums += np.exp(y - y.max()) / np.exp(y - y.max()).sum()
        assert np.allclose(p, sums / max(1, len(text)), atol=1e-4)


def test_language_id(spark, docs, empty):
    rng = np.random.default_rng(5)
    vocabulary = {"aa": ["the", "and", "thing"], "bb": ["le", "où", "eux"]}
    rows = [(i, " ".join(rng.choice(vocabulary[lang], 40)), lang) for i in range(200) for lang in [("aa", "bb")[i % 2]]]
    rows += [(900, None, "aa"), (901, "123 ...", "bb"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = by_id(language_id.predict(df, language_id.fit(df, steps=60)))
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (900, 901, 902))
    held = [(found[i].lang_pred, lang) for i, _, lang in rows[:200] if found[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and {i for i, r in found.items() if r.held_out} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert language_id.identify(empty).count() == 0
    many = [(i, " ".join(f"{a}{b}{a}" for _ in range(12)), f"{a}{b}") for i in range(2100) for a, b in [divmod(i % 70, 10)] for a, b in [("kprstvz"[a], "aeiouyàéöü"[b])]]
    spread = spark.createDataFrame(many, "doc_id long, text string, lang string")
    told = by_id(language_id.predict(spread, language_id.fit(spread, steps=120)))
    assert len({r.lang_pred for r in told.values()}) == 70 and sum(told[i].lang_pred == lang for i, _, lang in many if told[i].held_out) >= 0.9 * sum(r.held_out for r in told.values())
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = list(rng.choice([f"plain{k}" for k in range(50)], 30))
        if toxic:
            w[int(rng.integers(30))] = str(rng.choice(["idiot", "moron"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    hidden = {1000: "1d10t", 1001: "i d i o t", 1002: "m.o.r.o.n", 1003: "idiiiiot", 1004: "m0r0n"}
    rows += [(i, f"plain1 plain2 {w} plain3") for i, w in hidden.items()] + [(2000, None), (2001, "plain1 555-2186 a b c x$$$")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(2000, None)], "doc_id long, toxic int")
    found = by_id(toxicity.toxicity(df, lab))
    assert all(found[i].predicted == t for i, t in labels)
    assert all(found[i].predicted == 1 for i in hidden), {hidden[i]: found[i].score for i in hidden}
    assert found[2000].predicted == 0 and found[2001].predicted == 0 and all(0 <= r.score <= 1 for r in found.values())
    assert toxicity.toxicity(empty, lab).count() == 0
    assert toxicity.toxicity(docs, lab.limit(0)).filter("predicted = 1").count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (1, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert license_scan.scan(df).count() == 4 and pitman_yor.score(df).count() == 4 and jaccard_join.near_duplicates(df).count() == 4
    assert line_dedup.dedup_lines(df).count() == 4 and toxicity.toxicity(df, labels).count() == 4
    assert mixing.mix(df.withColumn("source", F.lit("s"))).count() == 4
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(df, items).filter("n_hit = 2").count() == 3
