"""The pruned graph against all pairs of vectors."""

import math

import numpy as np

from keepsake.llm import vectordups as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=V.COSINE):
    ok, x = [], []
    for i, (k, v, g) in enumerate(rows):
        good = k is not None and v is not None and g is not None and len(v) and all(a is not None and math.isfinite(a) for a in v) and any(v)
        if good:
            a = np.array(np.array(v, np.float32), np.float64)
            ok.append(i)
            x.append(a / np.linalg.norm(a))
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a in range(len(ok)):
        for b in range(a):
            i, j = ok[a], ok[b]
            if rows[i][2] == rows[j][2] and len(x[a]) == len(x[b]) and float(x[a] @ x[b]) >= cosine:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], low[find(i)] if r[0] is not None else None, r[0] is not None and low[find(i)] == r[0]) for i, r in enumerate(rows)), key=str)


def run(spark, rows):
    got, recall = V.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    return sorted((tuple(r) for r in got.collect()), key=str), recall


def test_clusters_copies_and_noise(spark, monkeypatch):
    for name, value in (("SHARD", 40), ("SHARD_MOST", 90)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(3)
    x = [rng.normal(size=24) for _ in range(180)]
    x += [x[i % 20] + rng.normal(size=24) * s for i in range(80) for s in (0.05,)]
    x += [x[5] + rng.normal(size=24) * s for s in np.linspace(0.01, 0.5, 60)]  # a dense ball and its rim
    x += [x[7]] * 9
    rows = [(int(k), [float(a) for a in v], i % 2 if i < 180 else 1) for i, (k, v) in enumerate(zip(rng.permutation(len(x)), x))]
    got, recall = run(spark, rows)
    want = brute(rows)
    assert recall >= 0.98
    assert got == want


def test_edge_cases(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1),
        (7, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (8, [], 1), (9, [1.0, None], 1), (10, [3e38, 0.0], 1), (11, [1e-40, 0.0], 1), (12, [1.0, 0.0], 2),
    ]
    got, _ = run(spark, rows)
    assert got == brute(rows)
    assert run(spark, [])[0] == []


def test_repeated_ids_and_extra_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 5), (1, [1.0, 0.0], 1, 5), (2, [0.0, 1.0], 1, 5)], SCHEMA + ", cls int")
    got = sorted(tuple(r) for r in V.near_duplicates(df)[0].collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_a_dense_ball_does_not_hide_lost_links(spark, monkeypatch):
    """Certain links of a ball outnumber all others; of those, one overlap loses some."""
    for name, value in (("SHARD", 40), ("SHARD_MOST", 90), ("OVERLAPS", (1, 2))):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(5)
    ball = rng.normal(size=64)
    x = [ball + rng.normal(size=64) * 0.02 for _ in range(400)]
    for _ in range(150):
        one = rng.normal(size=64)
        x += [one, *[one + rng.normal(size=64) * 0.37 for _ in range(2)]]
    rows = [(100 * int(k), [float(a) for a in v], 1) for k, v in zip(rng.permutation(len(x)), x)]
    got, recall = run(spark, rows)
    assert recall >= 0.98
    shares = [min(1.0, g[1] / w[1]) for g, w in zip(got, brute(rows)) if 0 < w[1] < 300]
    assert len(shares) > 300 and np.mean(shares) >= 0.98


def test_labels_are_judged_apart_and_unmeasured_ones_compared_whole(spark, monkeypatch):
    """No search finds anything here: links come from the comparison of blocks alone."""
    monkeypatch.setattr(V, "search", lambda *a: np.empty((2, 0), np.int64))
    rng = np.random.default_rng(6)
    x = [rng.normal(size=16) for _ in range(60)]
    x += [x[i] + rng.normal(size=16) * 0.02 for i in range(60)]
    rows = [(i * (100 if i % 2 else 1) + 7 * (i % 2 == 0), [float(a) for a in v], i % 2) for i, v in enumerate(x)]
    assert run(spark, rows)[0] == brute(rows)


def test_planted_links_at_several_levels_of_splitting(spark, monkeypatch):
    """Copies of a row stay within the overlap at any depth, and planted links are found."""
    for name, value in (("SHARD", 60), ("SHARD_MOST", 120), ("CENTROIDS", 6)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 48))
    x = np.vstack([x, x + rng.normal(size=x.shape) * 0.25])
    rows = [(i, [float(a) for a in v], 1) for i, v in enumerate(x)]
    points = spark.createDataFrame([(i, "1", np.ascontiguousarray(v / np.linalg.norm(v)).tobytes()) for i, v in enumerate(x)], "p long, grp string, vec binary")
    places = V.split(points, V.Scratch(spark), "t", 2).toPandas()
    assert places["grp"].str.count("/").max() >= 2 and places.groupby("p").size().between(2, 4).all()
    got, recall = run(spark, rows)
    want = brute(rows)
    assert recall >= 0.98
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want) > 0 and all(g[1] <= w[1] for g, w in zip(got, want))


def test_pruned_neighbours_keep_the_rule():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pools = rng.integers(0, 80, size=(80, 30))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for p, kept in enumerate(V.prune(np.arange(80), pools, x)):
        want, left = [], sorted({int(q) for q in pools[p]} - {p}, key=lambda q: d[p, q])
        while left and len(want) < V.DEGREE:
            want.append(left.pop(0))
            left = [q for q in left if V.ALPHA * d[want[-1], q] > d[p, q]]
        assert kept == want
