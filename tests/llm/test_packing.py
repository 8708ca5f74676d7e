"""Packing against the tokenizer, the rules of a packing, and a plain best fit."""

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keepsake.llm.common import Scratch
from keepsake.llm.packing import bands, best_fit, pack, pieces, settle, sweep
from keepsake.llm.tokens import WordEncoder

PATH = P.path("word_bpe_49k.json")


def supersteps(counts, capacity, parts):
    """The supersteps of best_fit without Spark."""
    placed, gaps = [], []
    for step, (above, upto) in enumerate(bands(capacity)):
        todo, kept = [], []
        for p in range(parts):
            cut = lambda k: (k * p // parts, k * (p + 1) // parts)  # noqa: B023, E731
            share = lambda runs: [(n, f + cut(k)[0], cut(k)[1] - cut(k)[0]) for n, f, k in runs if cut(k)[1] > cut(k)[0]]  # noqa: B023, E731
            got, left, now = sweep(share([(n, 0, k) for n, k in counts.items() if above < n <= upto]), share(gaps), capacity)
            placed, todo, kept = placed + got, todo + left, kept + now
        got, gaps = settle(todo, kept, capacity, step << 40)
        placed += got
    return placed


def valid(placed, counts, capacity):
    """The number of sequences of a packing that keeps the rules."""
    fill, seen = {}, {}
    for n, rank, k, first, offset in placed:
        for i in range(k):
            assert (n, rank + i) not in seen
            seen[n, rank + i] = True
            fill.setdefault(first + i, []).append((offset, n))
    assert sorted(seen) == sorted((n, i) for n, k in counts.items() for i in range(k))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(fill)


def decreasing(counts, capacity):
    """Best fit decreasing, one document at a time."""
    gaps = []
    for n in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
        at = bisect_left(gaps, n)
        g = gaps.pop(at) if at < len(gaps) else capacity
        insort(gaps, g - n)
    return len(gaps)


def test_runs_are_a_packing_as_good_as_best_fit_decreasing():
    """Never over one sequence more, and fewer in all."""
    ours = theirs = 0
    for seed in range(60):
        r = random.Random(seed)
        capacity, counts = r.choice([64, 2048]), {}
        for _ in range(r.choice([1, 30, 800])):
            n = min(capacity, max(1, int(r.paretovariate(1.1) * capacity / 12)))
            counts[n] = counts.get(n, 0) + r.randint(1, 4)
        got, bfd = valid(supersteps(counts, capacity, 8), counts, capacity), decreasing(counts, capacity)
        assert got <= bfd + 1
        ours, theirs = ours + got, theirs + bfd
    assert ours < theirs


def test_sweep_gives_the_successor():
    assert sweep([(5, 0, 2), (3, 0, 1)], [(9, 0, 1), (6, 7, 1), (2, 9, 1)], 10) == ([(5, 0, 1, 7, 4), (5, 1, 1, 0, 1), (3, 0, 1, 0, 6)], [], [(1, 7, 1), (1, 0, 1), (2, 9, 1)])
    assert settle([(8, 0, 5)], [], 8, 0)[0] == [(8, 0, 5, 0, 0)]


@pytest.mark.parametrize("counts, capacity", [({}, 8), ({8: 5}, 8), ({5: 3}, 8), ({1: 1}, 1), ({n: 3 for n in range(1, 65)}, 64)])
def test_supersteps_in_spark(spark, counts, capacity):
    lengths = spark.createDataFrame(list(counts.items()), "length int, n long")
    got = [(r["length"], r["first"], r["k"], r["at"], r["offset"]) for r in best_fit(lengths, Scratch(spark), capacity).collect()]
    assert sorted(got) == sorted(supersteps(counts, capacity, 8))
    assert valid(got, counts, capacity) <= decreasing(counts, capacity)


def test_documents_fill_the_sequences_of_best_fit_decreasing(spark):
    cut = pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), PATH)
    lengths = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in lengths.collect()}
    got = [tuple(r) for r in best_fit(lengths, Scratch(spark)).collect()]
    assert valid(got, counts, 2048) == decreasing(counts, 2048) == -(-sum(n * k for n, k in counts.items()) // 2048)


def test_word_cache_gives_the_tokenizers_ids():
    t = Tokenizer.from_file(PATH)
    texts = ["a.", "ñandú œuvre ſtraße ŉ ǆ ıß", "Ünder ǅx Ərə", "don't!!", "x's,", "-", "--a--", "été!", "A1.", "q<|endoftext|>.", "", " ", "It's ÉCOLE<|endoftext|>x <|startoftext|> ΣΑΣ\x1ca b\x85c　d", "a\x00b ﬁ ½ 123abc !!?", "x" * 5000, "İstanbul ǅ é"]
    got = WordEncoder.of(PATH).ids([x.encode() for x in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_pack_whole_documents(spark):
    t = Tokenizer.from_file(PATH)
    r = random.Random(2)
    texts = [" ".join(r.choice(["alpha", "beta,", "Gamma!", "x1"]) for _ in range(r.choice([0, 3, 20, 70]))) for _ in range(60)] + [None, "", None]
    rows = [(i % 50, x, 1, 2) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int, `Length` int").repartition(3)
    got = pack(df, PATH, capacity=32).collect()
    want = []
    for k, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for i in range(0, len(ids), 32):
            part = np.array(ids[i : i + 32], "<u4")
            want.append((k, i // 32, i, len(part), zlib.crc32(part.tobytes())))
    assert sorted((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == sorted(want)
    by = {}
    for g in got:
        by.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 32
    counts = {}
    for w in want:
        counts[w[3]] = counts.get(w[3], 0) + 1
    assert len(by) <= decreasing(counts, 32)
    assert pack(df.limit(0), PATH).collect() == []
    assert {f.name for f in pieces(df, PATH, ids=True).schema} == {"doc_id", "piece", "start", "length", "ids_crc32", "ids"}
