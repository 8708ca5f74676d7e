"""N-gram Jaccard self-join over prefix trees, exact for any threshold.

1. Each document becomes the set of hashes of its word n-grams; equal sets are one
   class from here on, so copies are never paired.
2. Survivors. Sorted by hash, two sets that reach the threshold share at least l of
   their first |x| - t|x| + l hashes (l: a share of |x|). These prefixes are dealt by
   hash range, in packed arrays whose repeated hashes are combined before the
   shuffle; only classes with enough hashes in common with any other go on.
3. Blocks. The survivors' hashes are counted (asked for by packs of sets, answered
   by hash range) and each set is put in one global order, rarest first. Classes that
   share a hash of their plain prefix in this order are candidates, and the components
   of candidates are blocks. Linked classes always share a block; passages that many
   documents have in common come last in the order and join no blocks.
4. Tries. The sets of a block, or of a part of it, are stored in a path-compressed
   trie, common hashes first. Each set walks it once, keeping the overlap of the
   path, which all sets below share, and leaves subtrees whose remaining lengths
   cannot reach the threshold. Large blocks are cut into parts that also hold the
   same few pivots; then what is not connected with a block's largest component is
   walked through all other parts where another component holds a hash of its
   prefix, so no link is lost.
5. The links form components; a document's component is its smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, free_prefix, slices, trim, worker_cache
from .components import components

WORDS = 5
#: Threshold of the Jaccard similarity, in percent.
PERCENT = 75
#: Share of a set, in percent, that the longer prefixes of step 2 must have in common.
COMMON_PERCENT = 15
#: Hashes that a task gathers before it combines and sends them.
FLUSH = 1_500_000
CACHE_WORDS = 300_000
#: Sets in a part of a block, and pivots in each part.
PART, PIVOTS = 256, 8
#: Bytes of hashes that a task gathers to build tries from.
BIN_BYTES = 8 << 20
#: Hashes of a pack of sets.
PACK = 1_500_000
#: Bytes of text for each range of hashes (some 12 MB of packed hashes).
BUCKET_BYTES = 16 << 20

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a shorter text is one n-gram, one without words has none."""
    found = text.encode("utf-8").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    worker_cache("ngram words", _words, CACHE_WORDS)
    ids = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    wide = min(words, len(ids))
    n = len(ids) - wide + 1
    h = np.full(n, wide, np.uint64)
    for j in range(wide):
        h ^= ids[j : j + n]
        h *= _MULTIPLIERS[j % 5]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def set_class(hashes: np.ndarray) -> int:
    """A signed 64-bit name of the whole set; n sets have n**2 / 2**65 false meetings."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _least(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _share(n: int) -> int:
    return max(1, COMMON_PERCENT * n // 100)


def distinct_pairs(token: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (token, owner) pairs, by token then owner: sorted as two plain columns, not as records."""
    order = np.argsort(owner, kind="stable")
    order = order[np.argsort(token[order], kind="stable")]
    token, owner = token[order], owner[order]
    new = np.r_[np.ones(min(1, len(token)), bool), (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])]
    return token[new], owner[new]


def buckets_of(docs: DataFrame, text: str) -> int:
    """A power of two of hash ranges, by the bytes of the texts: a range's hashes stay about as many at any size of the input."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return 1 << max(6, min(20, (total // BUCKET_BYTES).bit_length()))


def deal(docs: DataFrame, scratch: Scratch, buckets: int, percent: int, words: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Steps 1 and 2: the documents (key, hash of the text, n, class), and how many hashes a class has in common with others (class, n)."""
    key_type = dict(docs.dtypes)[key]
    bits = buckets.bit_length() - 1

    def send(tokens: list[np.ndarray], owners: list[int]) -> Iterator[tuple]:
        """Combines what this task has gathered: (kind, bucket, a, b) rows."""
        classes = np.array(owners, np.int64)
        token = np.concatenate(tokens)
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        count = np.diff(np.r_[first, len(token)])
        many = np.repeat(count > 1, count)
        credit = np.bincount(owner[many], minlength=len(classes))
        hit = np.flatnonzero(credit)
        if len(hit):
            yield 3, int(classes[hit[0]]) % buckets, classes[hit].astype("<i8").tobytes(), credit[hit].astype("<u4").tobytes()
        single, own = token[~many], classes[owner[~many]]
        shared, times = token[first[count > 1]], count[count > 1]
        edges = np.arange(buckets + 1, dtype=np.uint64)
        for kind, t, value, width in ((1, single, own.astype("<i8"), 8), (2, shared, times.astype("<u4"), 4)):
            cuts = np.searchsorted(t >> np.uint64(32), edges).tolist()
            low, raw = t.astype("<u4").tobytes(), value.tobytes()
            for b in range(buckets):
                i, j = cuts[b], cuts[b + 1]
                if i < j:
                    yield kind, b, low[4 * i : 4 * j], raw[width * i : width * j]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        owners: list[int] = []
        held, seen, drop = 0, set(), np.uint64(32 - bits)

        def packed() -> pa.RecordBatch:
            rows = list(send(tokens, owners))
            n = len(rows)
            kind, bucket, a, b = zip(*rows)
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.nulls(n, kinds[0]), none, none, none, pa.array(a, pa.binary()), pa.array(b, pa.binary())], names)

        names, kinds = ["kind", "bucket", "key", "body", "n", "cls", "a", "b"], []
        for batch in slices(batches):
            kinds[:] = [batch.column(0).type]
            n, cls = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                h = shingles(t, words)
                n.append(len(h))
                cls.append(c := set_class(h) if len(h) else None)
                if c is None or k is None or c in seen:
                    continue
                seen.add(c)
                size = len(h)
                p = min(size, size - _least(size, percent) + _share(size))
                tokens.append(h[:p] >> drop)
                owners.append(c)
                held += p
                if held >= FLUSH:
                    yield packed()
                    tokens, owners, held = [], [], 0
            size = batch.num_rows
            zero = pa.nulls(size, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([0] * size, pa.int32()), pa.nulls(size, pa.int32()), batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), zero, zero], names)
        if tokens:
            yield packed()

    def meet(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        part = {k: table.filter(pa.array(kind == k)) for k in (1, 2, 3)}
        blob = lambda k, c, d: np.frombuffer(b"".join(part[k].column(c).to_pylist()), d)
        pair, owner = distinct_pairs(blob(1, "a", "<u4"), blob(1, "b", "<i8"))
        more, times = blob(2, "a", "<u4"), blob(2, "b", "<u4")
        token, at = np.unique(np.concatenate([pair, more]), return_inverse=True)
        count = np.bincount(at[: len(pair)], minlength=len(token)) + np.bincount(at[len(pair) :], times, minlength=len(token)).astype(np.int64)
        met = count[at[: len(pair)]] > 1
        own = np.concatenate([owner[met], blob(3, "a", "<i8")])
        worth = np.concatenate([np.ones(int(met.sum()), np.int64), blob(3, "b", "<u4").astype(np.int64)])
        classes, back = np.unique(own, return_inverse=True)
        credit = np.bincount(back, worth, minlength=len(classes)).astype(np.int64)
        out = pa.table({"cls": pa.array(classes, pa.int64()), "n": pa.array(credit)})
        del part, pair, owner, more, times, token, at, count, met, own, worth, classes, back, credit
        trim()
        return out

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    # documents and packed hashes are written in one pass over the texts; only the hashes are shuffled
    dealt = scratch.save(rows.mapInArrow(gather, f"kind int, bucket int, key {key_type}, body long, n long, cls long, a binary, b binary"), "dealt", ["kind"])
    common = dealt.where("kind > 0").groupBy("bucket").applyInArrow(meet, "cls long, n long")
    return dealt.where("kind = 0").select("key", "body", "n", "cls"), common


def _pack(table: pa.Table) -> dict[int, np.ndarray]:
    """class -> hashes of a pack; a class that came twice is taken once."""
    return {c: np.frombuffer(h, "<u8") for c, h in zip(table.column("cls").to_pylist(), table.column("hashes").to_pylist())}


def _pack_hashes(sets: dict[int, np.ndarray], drop: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(list(sets.values())) >> np.uint64(drop), return_counts=True)


def ordered_prefix(hashes: np.ndarray, codes: np.ndarray, percent: int) -> np.ndarray:
    """The hashes of the plain prefix, rarest first (ties by hash), that other classes have too (``codes`` over 0)."""
    order = np.argsort(codes, kind="stable")[: len(hashes) - _least(len(hashes), percent) + 1]
    return hashes[order[codes[order] > 0]]


def candidates(held: DataFrame, scratch: Scratch, buckets: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Step 3: edges (a, b) between classes whose ordered prefixes share a hash, and (cls, prefix) of all classes.

    Within a pack the first class with a hash stands for the others; across packs
    the representatives of a hash are joined to the smallest.
    """
    bits = buckets.bit_length() - 1
    drop = 32 - bits
    total = held.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    packs = max(1, -(-total // (8 * PACK)))
    dealt = held.withColumn("pack", F.pmod(F.xxhash64("cls"), F.lit(packs)).cast("int"))
    edges_at = np.arange(buckets + 1, dtype=np.uint64)

    def ask(table: pa.Table) -> pa.Table:
        token, count = _pack_hashes(_pack(table), drop)
        cuts = np.searchsorted(token >> np.uint64(32), edges_at).tolist()
        low, times = token.astype("<u4").tobytes(), count.astype("<u4").tobytes()
        rows = [(b, low[4 * i : 4 * j], times[4 * i : 4 * j]) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
        bucket, a, c = zip(*rows)
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "pack": pa.array([table.column("pack")[0].as_py()] * len(rows), pa.int32()), "a": pa.array(a, pa.binary()), "c": pa.array(c, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u4") for x in table.column("a").to_pylist()]
        times = np.frombuffer(b"".join(table.column("c").to_pylist()), "<u4")
        token, at = np.unique(np.concatenate(parts), return_inverse=True)
        count = np.bincount(at, times, minlength=len(token))
        code = np.minimum(255, np.floor(16 * np.log2(count))).astype(np.uint8)[at]  # 0: no other class has it
        cuts = np.cumsum([0, *map(len, parts)]).tolist()
        return pa.table({"pack": table.column("pack"), "bucket": table.column("bucket"), "codes": pa.array([code[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())})

    asked = dealt.groupBy("pack").applyInArrow(ask, "bucket int, pack int, a binary, c binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "pack int, bucket int, codes binary")

    def meet(sets: pa.Table, codes: pa.Table) -> pa.Table:
        own = _pack(sets)
        leader: dict[int, int] = {}
        prefix: dict[int, bytes] = {}
        found: set[tuple[int, int]] = set()
        if own:
            token, _ = _pack_hashes(own, drop)
            code = np.frombuffer(b"".join(codes.sort_by("bucket").column("codes").to_pylist()), np.uint8)
            for c, h in own.items():
                first = ordered_prefix(h, code[np.searchsorted(token, h >> np.uint64(drop))], percent)
                prefix[c] = first.tobytes()
                for t in first.astype(np.int64).tolist():
                    if (a := leader.setdefault(t, c)) != c:
                        found.add((a, c))
        n, k, lead = len(found), len(prefix), list(leader.values())
        return pa.table({
            "kind": pa.array([0] * len(lead) + [1] * n + [2] * k, pa.int32()), "token": pa.array([*leader, *[None] * (n + k)], pa.int64()), "a": pa.array([*lead, *[e[0] for e in found], *prefix], pa.int64()),
            "b": pa.array([*lead, *[e[1] for e in found], *[None] * k], pa.int64()), "prefix": pa.array([None] * (len(lead) + n) + list(prefix.values()), pa.binary()),
        })

    met = dealt.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(meet, "kind int, token long, a long, b long, prefix binary")
    met = scratch.save(met, "met", ["kind"])
    across = met.where("kind = 0").groupBy("token").agg(F.collect_set("a").alias("all")).where(F.size("all") > 1)  # one per pack
    across = across.select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    edges = met.where("kind = 1").select("a", "b").unionByName(across).where("a <> b")
    return edges, met.where("kind = 2").select(F.col("a").alias("cls"), "prefix")


def routes(classes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(cls, to): for each class that is ``away``, the other parts of its block that it can have a new link in.

    ``classes``: block, part, cls, away, root (its own by default). Two linked sets share a hash of their
    ordered prefixes, and a link inside a component (``root``) adds nothing: a part
    where only the set's own component holds hashes of its prefix is passed over.
    Hashes are joined to parts, not to the sets of a part.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, "<i8") for x in batch.column("prefix").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(parts)), [len(x) for x in parts]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in names[:-1]], pa.array(np.concatenate(parts) if parts else [], pa.int64())], names)

    names = ["block", "part", "cls", "root", "away", "token"]
    classes = classes if "root" in classes.columns else classes.withColumn("root", F.col("cls"))
    known = classes.join(prefixes, "cls").select(*names[:-1], "prefix")
    rows = known.mapInArrow(unpack, "block long, part int, cls long, root long, away boolean, token long")
    there = rows.groupBy("block", "token", F.col("part").alias("to")).agg(F.min("root").alias("_least"), F.max("root").alias("_most"))
    other = (F.col("_least") != F.col("root")) | (F.col("_most") != F.col("root"))
    return rows.where("away").join(there, ["block", "token"]).where("part <> to").where(other).select("cls", "to").distinct()


class Trie:
    """Path-compressed trie of ordered sets; nodes keep the range of lengths below them."""

    __slots__ = ("tokens", "children", "ends", "least", "most", "last")

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.children, self.ends = tokens, {}, []
        self.least, self.most = 1 << 60, 0
        self.last = int(tokens[-1]) if len(tokens) else -1

    def insert(self, ranks: np.ndarray, who: int) -> None:
        node, at, n = self, 0, len(ranks)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if at == n:
                node.ends.append(who)
                return
            child = node.children.get(int(ranks[at]))
            if child is None:
                node.children[int(ranks[at])] = new = Trie(ranks[at:])
                new.least = new.most = n
                new.ends.append(who)
                return
            m = min(len(child.tokens), n - at)
            differ = np.flatnonzero(child.tokens[:m] != ranks[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.tokens):  # split the path
                upper = Trie(child.tokens[:same])
                upper.least, upper.most = child.least, child.most
                child.tokens = child.tokens[same:]
                upper.children[int(child.tokens[0])] = child
                node.children[int(ranks[at])] = child = upper
            node, at = child, at + same

    def walk(self, ranks: np.ndarray, mark: np.ndarray, percent: int) -> Iterator[int]:
        """Sets that reach the threshold with ``ranks``; ``mark`` is true at its tokens.

        Below a node at depth d with overlap o, a set of length y can reach
        o + min(y - d, tokens of the probe past the node) at most, and needs
        percent / (100 + percent) of both lengths together.
        """
        size, whole = len(ranks), 100 + percent
        todo = [(c, 0, 0) for c in self.children.values()]
        while todo:
            node, depth, shared = todo.pop()
            depth += len(node.tokens)
            shared += int(mark[node.tokens].sum())
            rest = size - int(np.searchsorted(ranks, node.last, "right"))
            y = min(max(depth + rest, node.least), node.most)
            if whole * (shared + min(y - depth, rest)) < percent * (size + y):
                continue
            if node.ends and whole * shared >= percent * (size + depth):
                yield from node.ends
            for c in node.children.values():
                todo.append((c, depth, shared))


def reachable(sizes: np.ndarray, at: np.ndarray, probes: np.ndarray, stored: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which probes and which stored sets can have a link with each other at all, as two masks over the sets.

    ``at``: the numbers of all sets' hashes, one set after the other. Two linked sets have in common at least
    percent / (100 + percent) of both sizes together, and no more than either has in common with
    all of the other side: this gives the largest partner that a set can have.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n = int(at.max()) + 1

    def largest(side: np.ndarray, other: np.ndarray) -> np.ndarray:
        held = np.bincount(at[other[owner]], minlength=n)[at] - other[owner]  # by other sets than the hash's own
        shared = np.bincount(owner[held > 0], minlength=len(sizes))
        return np.where(side, (100 + percent) * shared // percent - sizes, -1)

    def met(side: np.ndarray, own: np.ndarray, other: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        who = np.flatnonzero(other)
        who = who[np.argsort(sizes[who], kind="stable")]
        best = np.r_[-1, np.maximum.accumulate(theirs[who])]  # of the k smallest sets on the other side
        return side & (best[np.searchsorted(sizes[who], own, "right")] >= sizes)

    asks, takes = largest(probes, stored), largest(stored, probes)
    return met(probes, asks, stored, takes), met(stored, takes, probes, asks)


def trie_links(sets: list[np.ndarray], probes: list[int], percent: int, group: list[int] | None = None, stored: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of the probes with any stored set (all by default), as a forest: none between sets that are connected already (``group``: equal numbers)."""
    vocabulary, at = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    asks, takes = np.zeros(len(sets), bool), np.zeros(len(sets), bool)
    asks[probes] = True
    takes[range(len(sets)) if stored is None else stored] = True
    asks, takes = reachable(sizes, at, asks, takes, percent)
    if not asks.any():
        return []
    order = np.argsort(-np.bincount(at), kind="stable")  # common hashes first: sets share long paths
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ends = np.cumsum(sizes)
    ranks = {i: np.sort(rank[at[ends[i] - sizes[i] : ends[i]]]) for i in np.flatnonzero(asks | takes).tolist()}
    trie = Trie(np.empty(0, np.int64))
    for i in np.flatnonzero(takes).tolist():
        trie.insert(ranks[i], i)
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    known: dict[int, int] = {}
    for i, g in enumerate(group or []):
        parent[find(i)] = find(known.setdefault(g, i))
    mark, out = np.zeros(len(vocabulary), bool), []
    for i in np.flatnonzero(asks).tolist():
        mark[ranks[i]] = True
        for j in trie.walk(ranks[i], mark, percent):
            if find(i) != find(j):
                parent[find(i)] = find(j)
                out.append((i, j))
        mark[ranks[i]] = False
    return out


def _maybe_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcasts a stored table only if its count is small; else the join is shuffled."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def _bins(size: int) -> int:
    """Bins that tries are built in, one bin in memory at a time, by the bytes of the hashes to be dealt to them."""
    return max(1, -(-size // BIN_BYTES))


def _tries(parts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside each (block, part, slot). Rows: bin, block, part, slot, cls, hashes, probe, stored, root (null: not connected yet)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["bin"])
        order = np.lexsort([table.column(c).to_numpy() for c in ("cls", "slot", "part", "block")])
        block, part, slot, cls = (table.column(c).to_numpy()[order] for c in ("block", "part", "slot", "cls"))
        probe, stored, root = (table.column(c).to_pylist() for c in ("probe", "stored", "root"))
        blobs = table.column("hashes")
        cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (slot[1:] != slot[:-1]), True])
        a, b = [], []
        for i, j in zip(cuts, cuts[1:]):
            if j - i < 2:
                continue
            own = [k for k in range(i, j) if k == i or cls[k] != cls[k - 1]]  # a class that came twice is taken once
            at = order[own].tolist()
            sets = [np.frombuffer(blobs[k].as_py(), "<u8") for k in at]
            group = [root[k] if root[k] is not None else int(cls[x]) for k, x in zip(at, own)]
            for x, y in trie_links(sets, [x for x, k in enumerate(at) if probe[k]], percent, group, [x for x, k in enumerate(at) if stored[k]]):
                a.append(int(cls[own[x]]))
                b.append(int(cls[own[y]]))
        del table, blobs
        trim()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return parts.groupBy("bin").applyInArrow(run, "a long, b long")


def link_components(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``docs``.

    Component ids are the smallest key reachable over links of at least
    ``percent`` Jaccard similarity. Null texts and texts without words have no
    n-grams and are components of their own; rows with a null key link with
    nothing and have a null component; repeated rows are rows of their own with
    one component; an empty table gives no rows; other columns are left out.
    """
    return _linked(docs, text, key, percent, words).drop("body")


def _linked(docs: DataFrame, text: str, key: str, percent: int, words: int) -> DataFrame:
    """``link_components`` with ``body``, the hash of the row's text."""
    scratch = Scratch(docs.sparkSession)
    buckets = buckets_of(docs, text)
    rows, common = deal(docs, scratch, buckets, percent, words, text, key)
    classes = scratch.save(rows.where("key is not null and cls is not null").groupBy("cls").agg(F.min("key").alias("low"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")), "classes")

    least = F.ceil(F.col("n") * percent / 100)
    need = F.greatest(F.lit(1), F.floor(least * COMMON_PERCENT / 100))
    credits = common.groupBy("cls").agg(F.sum("n").alias("common"))
    alive = scratch.save(classes.join(credits, "cls").where(F.col("common") >= need).select(F.col("low").alias("_low"), "cls"), "alive")
    scratch.drop(*[f"dealt/kind={k}" for k in (1, 2, 3)])

    # the survivors' whole sets, from their texts
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cls, blob = [], []
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = shingles(t, words)
                if len(h) and set_class(h) == c:  # a repeated key may have another text
                    cls.append(c)
                    blob.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(blob, pa.binary())], ["cls", "hashes"])

    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    bodies = slim.join(_maybe_broadcast(alive), slim["_key"] == alive["_low"]).select("cls", "_text")
    held = scratch.save(bodies.mapInArrow(sets, "cls long, hashes binary"), "sets")
    edges, prefixes = candidates(held, scratch, buckets, percent)
    blocks = components(edges, scratch, "blocks").withColumnsRenamed({"node": "cls", "root": "block"})

    sizes = blocks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    placed = blocks.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    placed = scratch.save(placed, "placed")
    # places are joined before the hashes are: those are moved once at most, however many they are
    members = held.join(_maybe_broadcast(placed), "cls")
    members = scratch.save(members.withColumn("size", F.octet_length("hashes").cast("long")), "members")
    scratch.drop("sets")

    def shape(df: DataFrame, size: int, probe: bool, stored: bool, root: Column, slot: Column) -> DataFrame:
        rows = df.select("block", "part", slot.cast("int").alias("slot"), "cls", "hashes", F.lit(probe).alias("probe"), F.lit(stored).alias("stored"), root.alias("root"))
        return rows.withColumn("bin", F.pmod(F.xxhash64("block", "part", "slot"), F.lit(_bins(size))).cast("int"))

    size = members.agg(F.sum("size")).first()[0] or 0
    large = members.where("parts > 1")
    # pivots: the first classes of a large block by hash go into each of its parts
    low = large.groupBy("block").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("cls", F.lit(1)), F.col("parts")) == 0, F.col("cls")))), 1, PIVOTS).alias("pivots"))
    pivots = large.join(low, "block").where(F.array_contains("pivots", F.col("cls")))
    copies = pivots.withColumn("own", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("part <> own")
    alone, zero = F.lit(None).cast("long"), F.lit(0)
    first = shape(members, size, True, True, alone, zero).unionByName(shape(copies, size, True, True, alone, zero))
    links = scratch.save(_tries(first, percent), "links")

    if not large.isEmpty():
        # what is not in a large block's largest component is walked through the other parts that it can have a link in
        joined = components(links, scratch, "first").withColumnsRenamed({"node": "cls", "root": "root"})
        state = large.join(joined, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        counts = state.groupBy("block", "root").agg(F.count(F.lit(1)).alias("k"))
        giant = counts.groupBy("block").agg(F.max(F.struct("k", "root"))["root"].alias("giant"))
        state = scratch.save(state.join(giant, "block"), "state")
        open_blocks = state.where("root <> giant").select("block").distinct()
        todo = state.join(open_blocks, "block", "left_semi")
        to = scratch.save(routes(todo.select("block", "part", "cls", "root", (F.col("root") != F.col("giant")).alias("away")), prefixes), "routes")
        away = todo.where("root <> giant").drop("part").join(to, "cls").withColumnRenamed("to", "part")
        # the part's own sets are stored once for each slot of visitors; visitors meet at home, so they are only walked
        visits = scratch.save(away.groupBy("block", "part").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("slots"), F.sum("size").alias("visitors")), "visits")
        hosts = todo.join(visits, ["block", "part"])
        size = (hosts.agg(F.sum(F.col("size") * F.col("slots"))).first()[0] or 0) + (visits.agg(F.sum("visitors")).first()[0] or 0)
        hosts = hosts.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        away = away.join(visits, ["block", "part"])
        slot = F.pmod(F.xxhash64("cls", F.lit(2)), F.col("slots"))
        second = _tries(shape(hosts, size, False, True, F.col("root"), F.col("slot")).unionByName(shape(away, size, True, False, F.col("root"), slot)), percent)
        links = scratch.save(links.unionByName(second), "all-links")

    joined = components(links, scratch, "links").withColumnsRenamed({"node": "cls"})
    ends = joined.join(classes, "cls")
    ids = ends.groupBy("root").agg(F.min("low").alias("component"))
    linked = ends.join(ids, "root").select("cls", "component")
    copied = classes.where("copies > 1").join(linked.select("cls"), "cls", "left_anti").select("cls", F.col("low").alias("component"))
    named = scratch.save(linked.unionByName(copied), "named").withColumnRenamed("cls", "_cls")
    out = rows.join(_maybe_broadcast(named), rows["cls"] == named["_cls"], "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), "body")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group of near copies, with the columns it came with: the smallest key's.

    Rows with one key and different texts are judged apart: one may be a copy of
    another document while the other stays. Of several rows with the smallest key
    in one group (repeated rows, or near copies under one key) one stays, the one
    with the smallest hash of its text. Rows without a key or without words are
    copies of nothing and all stay, unless key and text repeat.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(_linked(docs, text, key, PERCENT, WORDS).withColumnRenamed(key, "_key"), "linked")
    keyed = found.where("_key is not null")
    gone = keyed.where(F.col("component_id") != F.col("_key")).select("_key", "body")
    # several rows of a group under its smallest key
    first = keyed.where(F.col("component_id") == F.col("_key")).select("_key", "body", F.when(F.col("n_shingles") > 0, F.lit(0)).otherwise(F.col("body")).alias("group"))
    rivals = first.groupBy("_key", "group").agg(F.min("body").alias("stays"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    rivals = scratch.save(rivals.drop("rows"), "rivals")
    lost = first.join(rivals, ["_key", "group"]).where("body <> stays").select("_key", "body")
    drop = scratch.save(gone.unionByName(lost).distinct(), "dropped").withColumnsRenamed({"_key": "_drop", "body": "_body"})
    own = free_prefix(docs) + "body"
    rows = docs.withColumn(own, F.xxhash64(text))
    rows = rows.join(_maybe_broadcast(drop), (docs[key] == drop["_drop"]) & (F.col(own) == drop["_body"]), "left_anti")
    if not rivals.isEmpty():  # of equal rows one stays: only these are shuffled
        again = rivals.select(F.col("_key").alias("_drop"), F.col("stays").alias("_body"))
        same = (docs[key] == again["_drop"]) & (F.col(own) == again["_body"])
        rows = rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates([key, own]))
    return rows.select(*docs.columns)
