"""Edit-aware counts against counting the edited text anew."""

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from keepsake.llm.editcount import CountTree, Splitter, count_edited, review_edits

SPLITTER = Splitter.of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
TEXT = st.text(alphabet="ab 'slvre\n\t1%é!　", max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 420), st.integers(0, 60), st.text(alphabet="a 'l\n%9", max_size=12)), max_size=5))
def test_edits_count_as_the_edited_text(text, edits):
    tree = CountTree(text, SPLITTER)
    for at, remove, insert in edits:
        tree.edit(at, remove, insert)
        at = min(at, len(text))
        text = text[:at] + insert + text[at + remove :]
        assert tree.text() == text
        assert tree.total() == len(SPLITTER.encoding.encode_ordinary(text))
        assert tree.chars[1] == len(text)


def test_only_the_surroundings_are_encoded_anew():
    text = "The quick brown fox jumps over the lazy dog. " * 2000
    tree = CountTree(text, SPLITTER)
    assert tree.edit(len(text) // 2, 3, "X") < 20
    assert tree.total() == len(SPLITTER.encoding.encode_ordinary(tree.text()))


def test_large_insertion_rebuilds():
    tree = CountTree("a b c " * 500, SPLITTER)
    tree.edit(700, 1, "word " * 3000)
    assert tree.total() == len(SPLITTER.encoding.encode_ordinary(tree.text()))
    tree.edit(5, 0, "zz")
    assert tree.total() == len(SPLITTER.encoding.encode_ordinary(tree.text()))


def test_table(spark):
    long = "many words here " * 20_000
    rows = [(1, "some text", [(0, 4, "no")], "x"), (2, None, [(5, 1, "added")], "x"), (3, "kept", None, "x"), (4, "", [], "x"), (1, "some text", [(0, 4, "no")], "x"), (5, "abc", [(None, None, None), None, (-3, 99, "z")], "x"), (6, long, [(10, 0, "!")], "x"), (None, "n", [], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at:long,remove:long,insert:string>>, n_tokens string").repartition(2)
    got = count_edited(df, "edits", P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    n = lambda t: len(SPLITTER.encoding.encode_ordinary(t))
    want = [(1, n("some text"), n("no text")), (2, 0, n("added")), (3, n("kept"), n("kept")), (4, 0, 0), (1, n("some text"), n("no text")), (5, n("abc"), n("z")), (6, n(long), n(long[:10] + "!" + long[10:])), (None, n("n"), n("n"))]
    assert sorted(((r.doc_id, r.n_tokens, r.n_tokens_edited) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_encoded < 30 for r in got)
    assert count_edited(df.limit(0), "edits", P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


def test_review_edits(spark):
    df = spark.createDataFrame([(1, "é" * 10), (2, None)], "doc_id long, text string")
    got = {r.doc_id: [(e.at, e.remove) for e in r.e] for r in df.select("doc_id", review_edits().alias("e")).collect()}
    assert got == {1: [(0, 0), (5, 5), (6, 7)], 2: [(0, 0), (0, 5), (0, 7)]}
