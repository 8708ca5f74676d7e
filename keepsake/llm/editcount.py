"""Edit-aware token counts.

A document's pre-tokens are the leaves of a segment tree whose nodes hold the
sums of characters and tokens below. An edit re-splits and re-encodes only the
pre-tokens it touches and their context: from the first pre-token whose match
may have looked at the edited place, to the first boundary past the edit where
the new split meets the old one. (A match depends on what follows it only, so
from a common boundary on both splits agree.) Then the sums above are updated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, worker_cache

#: Characters past its end that a match of the pre-token pattern can look at.
LOOK_AHEAD = 4
#: Pre-tokens per leaf of the tree, and pre-tokens kept per worker.
LEAF, CACHE = 64, 800_000


class Splitter(dict):
    """Pre-token -> number of tokens, for one rank file and pattern."""

    held: dict[tuple[str, str], "Splitter"] = {}

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> int:
        worker_cache("pre-tokens", self, CACHE)
        self[piece] = n = len(self.encoding.encode_ordinary(piece))
        return n

    @classmethod
    def of(cls, path: str, pattern: str) -> "Splitter":
        if (path, pattern) not in cls.held:
            cls.held[path, pattern] = cls(path, pattern)
        return cls.held[path, pattern]


class CountTree:
    """Segment tree over the leaves (runs of pre-tokens) of one document."""

    def __init__(self, text: str, splitter: Splitter):
        self.splitter = splitter
        pieces = splitter.split(text)
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        count = splitter.__getitem__
        for i, leaf in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(map(len, leaf)), sum(map(count, leaf))
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def total(self) -> int:
        return self.tokens[1]

    def _set(self, leaf: int, pieces: list[str]) -> None:
        self.leaves[leaf] = pieces
        i = self.size + leaf
        chars, tokens = sum(map(len, pieces)) - self.chars[i], sum(map(self.splitter.__getitem__, pieces)) - self.tokens[i]
        while i:
            self.chars[i] += chars
            self.tokens[i] += tokens
            i //= 2

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last if past the end) and where it begins."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def edit(self, at: int, remove: int, insert: str) -> int:
        """Replaces ``remove`` characters at ``at``; returns how many pre-tokens were encoded anew.

        Places past the end are the end; negative numbers count as 0.
        """
        length = self.chars[1]
        at = min(max(0, at), length)
        end = min(at + max(0, remove), length)
        first, start = self._find(max(0, at - LOOK_AHEAD))
        k = 0  # first pre-token of the leaf that may have looked at the edit
        pieces = self.leaves[first]
        while k < len(pieces) and start + len(pieces[k]) + LOOK_AHEAD <= at:
            start += len(pieces[k])
            k += 1
        old, last, take = pieces[k:], first, 8
        while True:
            # enough old pre-tokens to reach past the edit, then ``take`` more
            bounds, past, stop, i = [], 0, start, 0
            while past < take:
                if i == len(old):
                    last += 1
                    if last >= len(self.leaves):
                        break
                    old = old + self.leaves[last]
                    continue
                stop += len(old[i])
                i += 1
                if stop >= end:
                    bounds.append(stop)
                    past += 1
            everything = last >= len(self.leaves)
            body = "".join(old[:i])
            new = self.splitter.split(body[: at - start] + insert + body[end - start :])
            shift, limit = len(insert) - (end - at), stop + len(insert) - (end - at)
            if everything:
                kept, rest = new, old[i:]
                break
            meet, place, kept = set(bounds), start, None
            for j, piece in enumerate(new):
                place += len(piece)
                if place - shift in meet and place - shift >= end and place + LOOK_AHEAD <= limit:
                    kept = new[: j + 1]
                    begin, i = start, 0
                    while begin < place - shift:
                        begin += len(old[i])
                        i += 1
                    rest = old[i:]
                    break
            if kept is not None:
                break
            take *= 2
        last = min(last, len(self.leaves) - 1)
        self._set(first, pieces[:k] + kept + rest)
        for i in range(first + 1, last + 1):
            self._set(i, [])
        if len(self.leaves[first]) > 16 * LEAF:  # large insertions: build the tree anew from its pre-tokens
            self._rebuild()
        return len(kept)

    def _rebuild(self) -> None:
        pieces = [p for leaf in self.leaves for p in leaf]
        fresh = CountTree("", self.splitter)
        fresh.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        fresh.size = 1 << (len(fresh.leaves) - 1).bit_length()
        fresh.chars, fresh.tokens = [0] * (2 * fresh.size), [0] * (2 * fresh.size)
        self.__dict__ = fresh.__dict__
        for i, leaf in enumerate(self.leaves):
            self._set(i, leaf)

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)


def count_edited(docs: DataFrame, edits: str, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_pre_tokens, n_tokens_edited, n_encoded for every row.

    ``edits``: an array column of structs (at, remove, insert), applied in turn;
    a null array has no edits, null fields are 0 and empty. Null texts count as
    empty; repeated rows are counted alike; an empty table gives no rows; other
    columns are left out.
    """
    schema = T.StructType([docs.schema[key], *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_pre_tokens", "n_tokens_edited", "n_encoded")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter.of(path, pattern)
        for batch in slices(batches):
            out = []
            for t, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tree = CountTree(t or "", splitter)
                before, leaves, encoded = tree.total(), sum(map(len, tree.leaves)), 0
                for e in changes or []:
                    if e is not None:
                        encoded += tree.edit(e["at"] or 0, e["remove"] or 0, e["insert"] or "")
                out.append((before, leaves, tree.total(), encoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[i] for o in out], pa.int64()) for i in range(4)]], schema.names)

    return docs.select(key, F.col(text).alias("_text"), F.col(edits).alias("_edits")).mapInArrow(run, schema)


def review_edits(text: str = "text") -> "F.Column":
    """Three edits that stand for a reviewer's pass: a new opening, a phrase replaced in the middle, a few characters cut."""
    n = F.coalesce(F.length(text), F.lit(0))
    edit = lambda at, remove, insert: F.struct(at.cast("long").alias("at"), F.lit(remove).cast("long").alias("remove"), F.lit(insert).alias("insert"))
    return F.array(edit(F.lit(0), 0, "Edited: "), edit(F.floor(n / 2), 5, " it's 42% (re-checked) "), edit(F.floor(n * 2 / 3), 7, ""))
