"""As-of and interval joins against brute force: ties, nulls, hot keys, long intervals; counters and sketches."""

import numpy as np

from kinlink.operators import timeline


def test_as_of(spark):
    rng = np.random.default_rng(1)
    left = [(i, None if i % 50 == 0 else "hot" if i % 3 else f"k{rng.integers(5)}", None if i % 41 == 0 else int(rng.integers(1000))) for i in range(1500)]
    right = [(None if i % 30 == 0 else "hot" if i % 2 else f"k{rng.integers(5)}", None if i % 37 == 0 else int(rng.integers(100, 1000)), i if i % 11 else None) for i in range(400)]
    a, b = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int")
    found = {r.id: r.v for r in timeline.as_of(a.repartition(7), b.repartition(3), ["k"], "t", ["v"]).collect()}
    none = (-1, -1)
    for i, k, t in left:
        held = [(y, none if v is None else (0, v)) for x, y, v in right if k is not None and x == k and t is not None and y is not None and y <= t]
        want = max(held, default=(0, none))[1]
        assert found[i] == (None if want == none else want[1]), i
    assert len(found) == len(left) and timeline.as_of(a, b.limit(0), ["k"], "t", ["v"]).filter("v IS NOT NULL").count() == 0 and timeline.as_of(a.limit(0), b, ["k"], "t", ["v"]).collect() == []


def test_overlapping(spark):
    rng = np.random.default_rng(2)

    def made(n):
        start = rng.uniform(-500, 5000, n)
        return [(i, int(rng.integers(3)), float(s), float(s + w)) for i, (s, w) in enumerate(zip(start, np.exp(rng.uniform(-3, 8, n)) * (rng.random(n) < 0.9), strict=True))]

    x, y = [*made(150), (900, 1, -1e6, 1e6), (901, 1, 10.0, 5.0), (902, 1, None, 5.0), (903, 1, 60.0, 120.0)], [*made(150), (910, 1, 120.0, 180.0), (911, 1, 7e5, 2e6)]
    a, b = spark.createDataFrame(x, "l int, k int, l_start double, l_end double"), spark.createDataFrame(y, "r int, k int, r_start double, r_end double")
    found = [(r.l, r.r) for r in timeline.overlapping(a, b, ["k"], 60).select("l", "r").collect()]
    want = {(i, j) for i, k, s, e in x for j, m, u, v in y if k == m and s is not None and s <= e and s <= v and u <= e}
    assert len(found) == len(set(found)) and set(found) == want and (903, 910) in want and (900, 911) in want
    # a long interval lies in a few cells, however long it is
    cells = timeline._cells(a.filter("l = 900"), "l_start", "l_end", 60, "l_")
    assert cells.count() <= 2 * timeline.LEVELS


def test_sketches_by_increments(spark):
    rows = [(d, f"k{k}", f"n{(7 * d + i) % (k + 1)}") for d in range(4) for k in range(30) for i in range(k + 1)]
    df = spark.createDataFrame(rows, "day int, key string, name string")
    first, second = (timeline.sketched(df.filter(c), "day", "key", "name") for c in ("day < 2", "day >= 2"))
    found = {r.key: r.many for r in timeline.shared_by_many(first.unionByName(second), df, "key", "name", 10).collect()}
    assert found == {f"k{k}": k + 1 >= 10 for k in range(30)}
    totals = timeline.counters_of_all(spark.createDataFrame([("MATCH", "MATCH", None, 1), ("PENDING", None, None, None)], "status string, decision string, manual_verdict string, team int"), "team")
    assert sorted((str(r.team), r.grouping, r.total_rows, r.match_count) for r in totals.collect()) == [("1", 0, 1, 1), ("None", 0, 1, 0), ("None", 1, 2, 1)]
