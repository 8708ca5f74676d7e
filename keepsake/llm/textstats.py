"""Whole-text counts that the quality operators share (bytes of UTF-8, one pass)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_prefix, slices

#: Fixed value: the characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_digits", "n_marks", "n_lines", "n_chars"]


def repeated(words: list[bytes]) -> tuple[int, int]:
    """Words covered by 3-word windows that the text holds twice or more; distinct words."""
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(seq) < 4:
        return 0, len(ids)
    pair = seq[:-1] * len(ids) + seq[1:]
    if len(ids) >= 2_000_000:  # keys of three words would pass 63 bits: number the pairs first
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(ids) + seq[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    hit = np.zeros(len(window), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(seq), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum()), len(ids)


def counts(text: str | None, words: list[bytes] | None = None) -> tuple[int, ...]:
    """The numbers named in COUNTS; null counts as empty."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8")
    words = raw.split() if words is None else words
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    again, distinct = repeated(words)
    return (
        len(words), len(text) - without(_SPACE), without(SYMBOLS), len(lines) - len(set(lines)), again, distinct,
        without(_UPPER), without(_DIGITS), without(b"!?"), len(lines), len(text),
    )


def with_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The ``keep`` columns (all by default) and the counts, each a long, as ``prefix`` + name."""
    keep = docs.columns if keep is None else keep
    names = [prefix + c for c in COUNTS]
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in names]])
    mark = free_prefix(docs) + "text"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([counts(t) for t in batch.column(mark).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(found[:, i]) for i in range(len(COUNTS))]], [*keep, *names])

    return docs.select(*keep, docs[text].alias(mark)).mapInArrow(count, schema)
