"""The prefix-tree join against comparing all pairs of word n-gram sets."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.llm import ngramjoin as J


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, percent=75):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                if min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                    k = len(sets[i] & sets[j])
                    if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                        parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted(((k, len(s), low[find(i)] if k is not None else None) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in J.link_components(df).collect()), key=str)
    assert got == brute(rows)


def made(seed, n, vocabulary=400, near=0.5, passage=None):
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and r.random() < near:
            w = r.choice(texts).split()
            for _ in range(r.randint(0, 1 + len(w) // 25)):
                if w:
                    w[r.randrange(len(w))] = f"x{r.randrange(vocabulary)}"
            w = w[: len(w) - r.randint(0, len(w) // 6)] if r.random() < 0.3 else w
        else:
            w = [f"w{r.randrange(vocabulary)}" for _ in range(r.choice([0, 2, 5, 30, 80, 120]))]
        if passage and r.random() < 0.4:
            w = w + passage
        texts.append(" ".join(w))
    return texts


def test_random_near_copies(spark):
    texts = made(1, 220, passage=[f"p{i}" for i in range(40)])
    check(spark, [(i * 3, t) for i, t in enumerate(texts)])


def test_large_group_is_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(J, "PART", 16)
    monkeypatch.setattr(J, "PIVOTS", 2)
    monkeypatch.setattr(J, "PACK", 1000)
    r = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(130):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(90)] = f"y{r.randrange(10_000)}"
        rows.append((1000 - i, " ".join(w)))
    check(spark, rows + [(5000 + i, t) for i, t in enumerate(made(6, 60))])


def test_two_large_halves_of_one_block(spark, monkeypatch):
    """Rare n-grams in common make one block of two groups that are not linked, but for one document between them."""
    for name, value in (("PART", 16), ("PIVOTS", 2), ("PACK", 2000)):
        monkeypatch.setattr(J, name, value)
    r = random.Random(7)
    rare = [f"r{i}" for i in range(12)]
    halves = [[f"{h}{i}" for i in range(80)] for h in "ab"]
    rows = []
    for i in range(120):
        w = list(halves[i % 2]) + (rare if i < 10 else [])
        w[r.randrange(80)] = f"y{r.randrange(10_000)}"
        rows.append((i + 1, " ".join(w)))
    check(spark, rows)
    seen = J.routes(spark.createDataFrame([(1, p, c, c < 3) for c, p in ((1, 0), (2, 0), (3, 1), (4, 2))], "block long, part int, cls long, away boolean"), spark.createDataFrame([(c, np.array(t, "<u8").tobytes()) for c, t in ((1, [5, 2**63]), (2, [7]), (3, [2**63, 9]), (4, [9, 7]))], "cls long, prefix binary"))
    assert sorted(map(tuple, seen.collect())) == [(1, 1), (2, 2)]


def test_routes_pass_over_the_own_component(spark):
    """Of two halves of a block the smaller one visits no part for the hashes that only itself has there."""
    classes = [(1, part, 10 * half + part, 10 * half, half == 1) for half in (1, 2) for part in range(6)]
    prefixes = [(10 * half + part, np.array([half, 7] if part == 5 else [half], "<u8").tobytes()) for half in (1, 2) for part in range(6)]
    seen = J.routes(spark.createDataFrame([*classes, (1, 2, 30, 30, True)], "block long, part int, cls long, root long, away boolean"), spark.createDataFrame([*prefixes, (30, np.array([7], "<u8").tobytes())], "cls long, prefix binary"))
    assert sorted(map(tuple, seen.collect())) == [(15, 2), (30, 5)]


def test_visitors_meet_the_stored_sets_only(spark):
    a, b = (np.arange(i, i + 40, dtype="<u8").tobytes() for i in (0, 1))
    rows = [(0, 1, 0, 0, c, h, probe, not probe, None) for c, h, probe in ((1, a, False), (2, b, True), (3, np.arange(9, 49, dtype="<u8").tobytes(), True), (4, np.arange(10, 50, dtype="<u8").tobytes(), True))]
    links = J._tries(spark.createDataFrame(rows, "bin int, block long, part int, slot int, cls long, hashes binary, probe boolean, stored boolean, root long"), 75)
    assert [tuple(r) for r in links.collect()] == [(2, 1)]


def test_many_visitors_in_slots(spark, monkeypatch):
    """Texts that share passages with a large group, and pairs of them, are visitors of its parts by several slots."""
    monkeypatch.setattr(J, "PART", 6)
    monkeypatch.setattr(J, "PIVOTS", 2)
    monkeypatch.setattr(J, "BIN_BYTES", 5000)
    r = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        w = list(base)
        w[r.randrange(60)] = f"y{r.randrange(10_000)}"
        texts.append(w)
        own = base[:30] + [f"z{i}-{j}" for j in range(r.choice([8, 15, 30]))]
        texts += [own, own[:-1] + ["end"]] if i % 2 else [own]
    rows = [(i * 7 % 1009, " ".join(w)) for i, w in enumerate(texts)]
    check(spark, rows)


def near_copies(n, edits, size=400, seed=7):
    """n sets of one base, each with so many edits that put five hashes of its own in the place of five of the base."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        h = np.arange(size, dtype=np.uint64)
        for k, e in enumerate(r.sample(range(size // 5), edits)):
            h[5 * e : 5 * e + 5] = np.arange(5, dtype=np.uint64) + np.uint64(10**6 + 1000 * i + 5 * k)
        out.append(np.sort(h))
    return out


def test_hopeless_sets_are_not_walked(monkeypatch):
    """Sets with too many hashes that no other set of their group has are neither stored nor walked."""
    walked, stored = [], []
    walk, insert = J.Trie.walk, J.Trie.insert
    monkeypatch.setattr(J.Trie, "walk", lambda self, ranks, *a: walked.append(len(ranks)) or walk(self, ranks, *a))
    monkeypatch.setattr(J.Trie, "insert", lambda self, ranks, who: stored.append(who) or insert(self, ranks, who))
    few, many = near_copies(30, 3), near_copies(40, 14, seed=8)
    many = [h + np.uint64(10**7) * (h >= 10**6) for h in many]
    assert J.trie_links(many, list(range(40)), 75) == [] and (walked, stored) == ([], [])
    assert J.trie_links([*few, *many], list(range(30, 70)), 75, None, list(range(30))) == [] and (walked, stored) == ([], [])
    assert len(J.trie_links([*few, *many], list(range(70)), 75)) == 29 and (len(walked), sorted(stored)) == (30, list(range(30)))


@pytest.mark.parametrize("seed", range(4))
def test_reachable_keeps_all_that_link(seed):
    r = random.Random(seed)
    base = [np.unique(np.array([r.randrange(80) for _ in range(r.randint(1, 40))], np.uint64)) for _ in range(10)]
    sets = base + [np.unique(np.r_[b[: len(b) - r.randint(0, 3)], np.array([r.randrange(10_000)], np.uint64)]) for b in base for _ in range(4)]
    probes, stored = (np.array([r.random() < 0.6 for _ in sets]) for _ in range(2))
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    asks, takes = J.reachable(np.array([len(s) for s in sets]), at, probes, stored, 75)
    assert not (asks & ~probes).any() and not (takes & ~stored).any()
    for i in np.flatnonzero(probes):
        for j in np.flatnonzero(stored):
            k = len(np.intersect1d(sets[i], sets[j]))
            if i != j and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                assert asks[i] and takes[j]


def test_hashes_are_moved_once(spark, monkeypatch):
    """Whatever Spark broadcasts by itself, sets are not shuffled to learn their block, and what is read no more is deleted."""
    plans, roots, save = {}, [], J.Scratch.save

    def saved(self, df, name, by=None):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        roots.append(self.root.removeprefix("file://"))
        return save(self, df, name, by)

    monkeypatch.setattr(J.Scratch, "save", saved)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark, list(enumerate(made(4, 80))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plans["members"] and "BroadcastHashJoin" in plans["members"]
    left = {str(p.relative_to(r)) for r in map(Path, {*roots}) for p in r.glob("**/") if p != r}
    assert "dealt/kind=0" in left and not left & {"dealt/kind=1", "dealt/kind=2", "dealt/kind=3", "sets"}


def test_distinct_pairs():
    r = np.random.default_rng(2)
    token, owner = r.integers(0, 40, 3000).astype("<u4"), r.integers(-9, 9, 3000).astype("<i8")
    pairs = list(zip(*(x.tolist() for x in J.distinct_pairs(token, owner))))
    assert pairs == sorted({*zip(token.tolist(), owner.tolist())})
    assert [len(x) for x in J.distinct_pairs(token[:0], owner[:0])] == [0, 0]


def test_bins_follow_the_bytes():
    assert [J._bins(x * J.BIN_BYTES) for x in (0, 1, 5)] == [1, 1, 5]


def test_buckets_follow_the_bytes(spark):
    one = spark.createDataFrame([("x" * 1000,)], "text string")
    assert J.buckets_of(one.limit(0), "text") == J.buckets_of(one, "text") == 64
    assert J.buckets_of(spark.range(200).select(F.repeat(F.lit("x"), 16 << 20).alias("text")), "text") == 256


def test_keep_one_of_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, long, "x"), (1, long, "x"), (1, long + " more", "x"),  # one group under one key
        (2, long, "x"), (2, "quite another text of this key", "x"),  # the first is a copy, the other is not
        (3, "", "x"), (3, "", "x"), (3, None, "x"), (4, None, "x"), (None, long, "x"), (None, long, "x"), (5, "word " * 200_000, "x"), (6, "word " * 200_000, "x"),
    ]
    got = [(r.doc_id, len(r.text) if r.text is not None else None) for r in J.keep_one(spark.createDataFrame(rows, "doc_id long, text string, body string")).collect()]
    assert len([g for g in got if g[0] == 1]) == 1
    assert sorted([g for g in got if g[0] != 1], key=str) == sorted([(2, 30), (3, 0), (3, None), (4, None), (None, len(long)), (None, len(long)), (5, 1_000_000)], key=str)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE Two"), (6, "two one"), (7, "a b c d e"), (8, "a b c d e"), (8, "a b c d e"), (None, "a b c d e"), (9, "É a b c d"), (10, "é a b c d"), (11, "a b c d e f g")]
    check(spark, rows)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n long, cls long, kind int")
    assert J.link_components(df).collect() == []
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 1, 2, 3)], "doc_id long, text string, n long, cls long, kind int")
    assert [r.doc_id for r in J.keep_one(df).collect()] == [1]
    assert J.keep_one(df).columns == df.columns


@pytest.mark.parametrize("percent", [50, 75, 90])
def test_trie_finds_what_pairs_find(percent):
    r = random.Random(percent)
    base = [np.unique(np.array([r.randrange(60) for _ in range(r.randint(3, 40))], np.uint64)) for _ in range(12)]
    sets = base + [np.unique(np.r_[b[: len(b) - r.randint(0, 3)], np.array([r.randrange(60)], np.uint64)]) for b in base for _ in range(3)]
    got = set()
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in J.trie_links(sets, list(range(len(sets))), percent):
        parent[find(a)] = find(b)
    got = {(i, j) for i in range(len(sets)) for j in range(i) if find(i) == find(j)}
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    assert got == {(i, j) for i in range(len(sets)) for j in range(i) if find(i) == find(j)}
