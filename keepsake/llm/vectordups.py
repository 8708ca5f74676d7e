"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors of one label are one class. Classes are split into overlapping
   shards by nearest centroids, which are members drawn by hash (level by level,
   64 a group at most, until shards are small).
2. Within shards, dense balls become one unit: all members lie within half the
   threshold angle of the ball's centre, so every two of them are linked, and they
   are counted, not paired. All other classes are units of one.
3. Each shard builds a graph of its units by robust pruning; the adjacency lists of
   a unit's shards are united.
4. Every unit is searched for: greedily from the shard's medoid, then the range is
   expanded over the graph while neighbours lie within the threshold angle and the
   radii of both units.
5. Pairs found are verified in double precision: units of one at once; of two balls,
   by their radii where these decide, else member by member.
6. The recall of each label is audited against brute force: the mean, over all
   audited vectors, of the share found of their links to other units (links inside
   a ball are certain and would hide lost ones). Labels below the wanted recall
   repeat everything from step 3 with more overlap; what then is still below it,
   and small labels without a link to measure by, are compared block by block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch
from .components import components

COSINE = 0.93
#: Classes or units a shard is meant for, and at most before it is split again.
SHARD, SHARD_MOST = 800, 2_000
#: Centroids of a group, and levels of splitting, at most.
CENTROIDS, LEVELS = 64, 4
#: Robust pruning: neighbours kept, nearest candidates, other candidates, slack factor.
DEGREE, NEAREST, OTHERS, ALPHA = 24, 40, 12, 1.2
BEAM = 24
#: Classes that a ball has at least.
BALL = 4
#: Audited vectors (all with an id divisible by 100) compared in one pass, recall wanted of each label, overlaps tried.
AUDITED, RECALL, OVERLAPS = 1_000, 0.98, (2, 4)
#: Radians that bounds are kept clear of the threshold, so that rounding decides nothing.
MARGIN = 1e-7


def _angle(c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(c, -1.0, 1.0))


def unit_vectors(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, cls, grp, vec) of the rows that can have links: vec holds doubles of length 1."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cls, grp, vec = [], [], [], []
            for i, (k, v, g) in enumerate(zip(*[batch.column(j).to_pylist() for j in range(3)])):
                if k is None or v is None or g is None or not len(v) or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                if not np.isfinite(top) or top == 0:
                    continue
                x = x / top  # neither overflow nor underflow of squares
                x = np.ascontiguousarray(x / math.sqrt(float(x @ x)))
                name = f"{g}|{len(v)}"
                raw = x.tobytes()
                at.append(i)
                cls.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=name.encode()[:64]).digest(), "little", signed=True))
                grp.append(name)
                vec.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(cls, pa.int64()), pa.array(grp, pa.string()), pa.array(vec, pa.binary())], ["id", "cls", "grp", "vec"])

    return df.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(label).alias("g")).mapInArrow(run, f"id {kind}, cls long, grp string, vec binary")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def split(points: DataFrame, scratch: Scratch, name: str, overlap: int) -> DataFrame:
    """(p, grp, vec) with every group larger than SHARD_MOST dealt to its members' ``overlap`` nearest centroids.

    A group's rows are dealt in salted parts, each of which gets the group's
    centroids: no task needs the whole group. After each level a row keeps its
    2 * ``overlap`` best places among all groups it was dealt to, so the copies
    don't multiply with the levels.
    """
    points = points.select("p", "grp", "vec", F.lit(1.0).alias("score"))
    best = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("score"), "grp"))
    for level in range(LEVELS):
        sizes = points.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_MOST)
        sizes = scratch.save(sizes.select(F.col("grp").alias("g"), "n", F.least(F.lit(CENTROIDS), F.ceil(F.col("n") / SHARD)).cast("int").alias("k"), F.ceil(F.col("n") / SHARD_MOST).cast("int").alias("salts")), f"{name}-sizes{level}")
        if sizes.isEmpty():
            break
        large = points.join(sizes, points["grp"] == sizes["g"])
        u = F.pmod(F.xxhash64("p", F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = large.where(u < 3 * F.col("k") / F.col("n")).groupBy("g").agg(F.slice(F.array_sort(F.collect_list(F.struct(u.alias("u"), "vec"))), 1, CENTROIDS).alias("all"), F.first("k").alias("k"), F.first("salts").alias("salts"))
        centres = drawn.select("g", "salts", F.explode(F.slice("all", F.lit(1), F.col("k"))).alias("one"))
        centres = centres.select("g", F.col("one.vec").alias("vec"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        centres = scratch.save(centres, f"{name}-centres{level}")
        rows = large.select("p", "g", "vec", F.pmod(F.xxhash64("p", F.lit(99)), F.col("salts")).cast("int").alias("salt"))

        def nearest(own: pa.Table, given: pa.Table) -> pa.Table:
            if not len(own):
                return pa.table({"p": pa.array([], pa.int64()), "grp": pa.array([], pa.string()), "vec": pa.array([], pa.binary()), "score": pa.array([], pa.float64())})
            group = own.column("g")[0].as_py()
            if not len(given):  # no centroid was drawn: the group stays one shard
                return pa.table({"p": own.column("p"), "grp": own.column("g"), "vec": own.column("vec"), "score": pa.array(np.ones(len(own)))})
            c = np.unique(_matrix(given.column("vec")), axis=0)
            k = min(overlap, len(c))
            cosines = _matrix(own.column("vec")) @ c.T
            best = np.argsort(-cosines, axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(own)), k)
            taken = own.select(["p", "vec"]).take(pa.array(at))
            return pa.table({"p": taken.column("p"), "grp": pa.array([f"{group}/{j}" for j in best.ravel()], pa.string()), "vec": taken.column("vec"), "score": pa.array(np.take_along_axis(cosines, best, 1).ravel())})

        dealt = rows.groupBy("g", "salt").cogroup(centres.groupBy("g", "salt")).applyInArrow(nearest, "p long, grp string, vec binary, score double")
        rest = points.join(sizes.select("g"), points["grp"] == sizes["g"], "left_anti").select("p", "grp", "vec", "score")
        places = dealt.unionByName(rest)
        if level and overlap > 1:
            places = places.withColumn("_place", best).where(F.col("_place") <= 2 * overlap).drop("_place")
        points = scratch.save(places, f"{name}-level{level}")
    return points.select("p", "grp", "vec")


def find_balls(x: np.ndarray, theta: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Dense balls of the rows: (members, centre, radius), members within half the threshold angle."""
    out, left = [], np.arange(len(x))
    degree = ((x @ x.T) >= math.cos(theta)).sum(1)
    while True:
        live = left[degree[left] > BALL]
        if not len(live):
            return out
        seed = live[np.argmax(degree[live])]
        near = left[(x[left] @ x[seed]) >= math.cos(theta)]
        centre = x[near].mean(0)
        centre /= np.linalg.norm(centre)
        angle = _angle(x[near] @ centre)
        inside = near[angle <= theta / 2 - MARGIN]
        if len(inside) >= BALL:
            out.append((inside, centre, float(angle[angle <= theta / 2 - MARGIN].max())))
            left = np.setdiff1d(left, inside, assume_unique=True)
        degree[seed] = 0  # not a seed again
        if len(inside) >= BALL:
            degree[left] -= (x[left] @ x[inside].T >= math.cos(theta)).sum(1)


def prune(own: np.ndarray, pools: np.ndarray, x: np.ndarray) -> list[list[int]]:
    """Robust pruning of each row's pool: take the nearest, drop what is nearer to it (by ALPHA) than to the row, repeat."""
    d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nkd,nd->nk", x[pools], x[own])))
    alive = pools != own[:, None]
    order = np.argsort(pools, axis=1, kind="stable")
    ranked = np.take_along_axis(pools, order, 1)
    twice = np.zeros_like(alive)
    np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
    alive &= ~twice
    order = np.argsort(d, axis=1, kind="stable")
    pools, d, alive = (np.take_along_axis(v, order, 1) for v in (pools, d, alive))
    y = x[pools]
    between = ALPHA * np.sqrt(np.maximum(0, 2 - 2 * (y @ y.transpose(0, 2, 1))))
    rows, kept = np.arange(len(own)), [[] for _ in own]
    for _ in range(DEGREE):
        i = alive.argmax(1)
        found = alive[rows, i]
        if not found.any():
            break
        for r in np.flatnonzero(found):
            kept[r].append(int(pools[r, i[r]]))
        alive &= between[rows, i] > d
        alive[rows, i] = False
    return kept


def build(x: np.ndarray, seeds: np.ndarray) -> list[list[int]]:
    """Pruned out-neighbours of each row, and the reverse edges while there is room."""
    n, k = len(x), min(len(x) - 1, NEAREST)
    if n < 2:
        return [[] for _ in range(n)]
    others = (seeds[:, None].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, OTHERS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
    others = (others % np.uint64(n)).astype(np.int64)
    out = []
    for i in range(0, n, 256):
        s = x[i : i + 256] @ x.T
        near = np.argpartition(-s, k, axis=1)[:, : k + 1] if k < n - 1 else np.tile(np.arange(n), (len(s), 1))
        out += prune(np.arange(i, i + len(s)), np.hstack([near, others[i : i + 256]]), x)
    for p in range(n):
        for q in list(out[p]):
            if len(out[q]) < 2 * DEGREE and p not in out[q]:
                out[q].append(p)
    return out


def search(x: np.ndarray, graph: list[np.ndarray], medoid: int, reach: np.ndarray, together: int = 512) -> np.ndarray:
    """Pairs (2 x n, each once, lower row first) found by searching for every row ``q``: what has a cosine of ``reach[q]`` to it, as far as the graph leads.

    Many rows are searched for at once. Each has a beam of its BEAM best rows
    seen; its best row not yet expanded is next, until none is left in the beam;
    then the range is expanded from all rows within reach. Cosines are single
    precision with some slack: pairs are verified by the caller.
    """
    n, slack = len(x), 1e-5
    near = np.full((n + 1, max(1, *map(len, graph))), n, np.int32)  # row n is none
    for i, a in enumerate(graph):
        near[i, : len(a)] = a
    y = np.vstack([x, np.zeros((1, x.shape[1]))]).astype(np.float32)
    low = reach - slack
    pairs = []
    for at in range(0, n, together):
        own = np.arange(at, min(n, at + together))
        m = len(own)
        seen, opened = np.zeros((m, n + 1), bool), np.zeros((m, n + 1), bool)
        seen[:, n] = seen[:, medoid] = True
        beam, score, done = np.full((m, BEAM), n, np.int32), np.full((m, BEAM), -2, np.float32), np.ones((m, BEAM), bool)
        beam[:, 0], score[:, 0], done[:, 0] = medoid, y[own] @ y[medoid], False
        live, found = np.arange(m), [(np.arange(m), beam[:, 0].copy(), score[:, 0].copy())]
        while True:
            best = np.where(done[live], -3, score[live]).argmax(1)
            more = ~done[live, best]
            live, best = live[more], best[more]
            if not len(live):
                break
            node = beam[live, best]
            done[live, best] = opened[live, node] = True
            new = near[node]
            row, column = np.nonzero(~seen[live[:, None], new])
            r, v = live[row], new[row, column]
            seen[r, v] = True
            cosine = np.einsum("ij,ij->i", y[v], y[own[r]])
            found.append((r, v, cosine))
            there = np.full(new.shape, -2, np.float32)
            there[row, column] = cosine
            scores, nodes = np.hstack([score[live], there]), np.hstack([beam[live], new])
            closed = np.hstack([done[live], there < -1.5])
            top = np.argpartition(-scores, BEAM - 1, axis=1)[:, :BEAM]
            beam[live], score[live], done[live] = (np.take_along_axis(v, top, 1) for v in (nodes, scores, closed))
        r, v, cosine = (np.concatenate(c) for c in zip(*found))
        hit = cosine >= low[own[r]]
        r, v = r[hit], v[hit]
        hits = [(r, v)]
        while len(r):  # range expansion
            fresh = ~opened[r, v]
            r, v = r[fresh], v[fresh]
            opened[r, v] = True
            r, v = np.repeat(r, near.shape[1]), near[v].ravel()
            fresh = ~seen[r, v]
            r, v = np.divmod(np.unique(r[fresh] * np.int64(n + 1) + v[fresh]), n + 1)
            seen[r, v] = True
            hit = np.einsum("ij,ij->i", y[v], y[own[r]]) >= low[own[r]]
            r, v = r[hit], v[hit]
            hits.append((r, v))
        pairs.append(np.stack([own[np.concatenate([h[0] for h in hits])], np.concatenate([h[1] for h in hits])]))
    both = np.concatenate(pairs, 1) if pairs else np.empty((2, 0), np.int64)
    return np.unique(np.sort(both[:, both[0] != both[1]], 0), axis=1)


def _graph_pairs(units: DataFrame, scratch: Scratch, theta: float, overlap: int) -> DataFrame:
    """(u, v, cosine) of units whose members may be linked, each pair once."""
    tag = f"o{overlap}"
    shards = scratch.save(split(units.select(F.col("unit").alias("p"), F.col("grp"), F.col("vec")), scratch, tag, overlap), f"{tag}-shards")

    def adjacency(table: pa.Table) -> pa.Table:
        data = table.sort_by("p")
        ids = data.column("p").to_numpy()
        out = build(_matrix(data.column("vec")), ids.view(np.uint64))
        return pa.table({"p": data.column("p"), "near": pa.array([ids[o].tolist() for o in out], pa.list_(pa.int64()))})

    lists = shards.groupBy("grp").applyInArrow(adjacency, "p long, near array<long>")
    lists = scratch.save(lists.groupBy("p").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), f"{tag}-lists")  # overlap * 2 * DEGREE at most
    homes = shards.groupBy("p").agg(F.array_sort(F.collect_set("grp")).alias("homes"))
    radii = units.select(F.col("unit").alias("p"), "radius")
    rows = shards.join(lists, "p").join(homes, "p").join(radii, "p")

    def ranges(table: pa.Table) -> pa.Table:
        data = table.sort_by("p")
        ids, x, radius = data.column("p").to_numpy(), _matrix(data.column("vec")), data.column("radius").to_numpy()
        homes, own = [set(h) for h in data.column("homes").to_pylist()], data.column("grp")[0].as_py()
        local = {v: i for i, v in enumerate(ids.tolist())}
        graph = [np.array([local[v] for v in near if v in local], np.int64) for near in data.column("near").to_pylist()]
        mean = x.mean(0)
        medoid = int(np.argmax(x @ mean))
        widest = float(radius.max())
        i, j = search(x, graph, medoid, np.cos(np.minimum(math.pi, theta + radius + widest + 1e-9)))
        cosine = np.einsum("ij,ij->i", x[i], x[j])
        near = np.where((radius[i] == 0) & (radius[j] == 0), cosine >= math.cos(theta), _angle(cosine) <= theta + radius[i] + radius[j] + MARGIN)
        # of the shards that hold both units, the first counts the pair
        near &= np.array([min(homes[a] & homes[b]) == own for a, b in zip(i.tolist(), j.tolist())], bool)
        u, v, c = ids[i[near]], ids[j[near]], cosine[near]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "cosine": pa.array(c, pa.float64())})

    return scratch.save(rows.groupBy("grp").applyInArrow(ranges, "u long, v long, cosine double"), f"{tag}-pairs")


def _counted(pairs: DataFrame, units: DataFrame, members: DataFrame, scratch: Scratch, theta: float, cosine: float, tag: str) -> tuple[DataFrame, DataFrame]:
    """(cls, more) links over pairs of units, and (a, b) links of units."""
    a = units.select(F.col("unit").alias("u"), F.col("radius").alias("ru"), F.col("weight").alias("wu"))
    b = units.select(F.col("unit").alias("v"), F.col("radius").alias("rv"), F.col("weight").alias("wv"))
    known = pairs.join(a, "u").join(b, "v")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cosine"))))
    sure = ((F.col("ru") == 0) & (F.col("rv") == 0)) | (angle + F.col("ru") + F.col("rv") <= theta - MARGIN)
    known = scratch.save(known.withColumn("sure", sure), f"{tag}-known")
    whole = known.where("sure")
    by_unit = whole.select(F.col("u").alias("unit"), F.col("wv").alias("more")).unionByName(whole.select(F.col("v").alias("unit"), F.col("wu").alias("more")))
    by_unit = by_unit.groupBy("unit").agg(F.sum("more").alias("more"))
    counts = members.join(by_unit, "unit").select("cls", "more")
    edges = whole.select(F.col("u").alias("a"), F.col("v").alias("b"))
    open_pairs = known.where("not sure").select("u", "v")
    if open_pairs.isEmpty():
        return counts, edges
    named = open_pairs.withColumn("pair", F.xxhash64("u", "v"))
    sides = named.select("pair", F.col("u").alias("unit"), F.lit(0).alias("side"), "u", "v").unionByName(named.select("pair", F.col("v").alias("unit"), F.lit(1).alias("side"), "u", "v"))
    # of large balls, each two blocks of members meet in a task of their own
    size = members.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / SHARD_MOST).cast("int").alias("blocks"))
    sides = sides.join(size.select(F.col("unit").alias("u"), F.col("blocks").alias("left")), "u").join(size.select(F.col("unit").alias("v"), F.col("blocks").alias("right")), "v")
    rows = sides.join(members.select("unit", "cls", "w", "vec"), "unit")
    block = F.pmod(F.xxhash64("cls", F.lit(13)), F.when(F.col("side") == 0, F.col("left")).otherwise(F.col("right"))).cast("int")
    rows = rows.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("right")).otherwise(F.col("left")) - 1)))
    first = F.col("side") == 0
    rows = rows.select("pair", F.when(first, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(first, F.col("other")).otherwise(F.col("own")).alias("j"), "side", "u", "v", "cls", "w", "vec")

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        x, w, cls = _matrix(table.column("vec")), table.column("w").to_numpy(), table.column("cls").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        hit = (x[left] @ x[right].T) >= cosine
        more = np.zeros(len(x), np.int64)
        more[left], more[right] = hit @ w[right], hit.T @ w[left]
        keep = np.flatnonzero(more)
        linked = np.array([bool(hit.any())] + [False] * (len(keep) - 1)) if len(keep) else np.array([], bool)
        return pa.table({"cls": pa.array(cls[keep], pa.int64()), "more": pa.array(more[keep], pa.int64()), "a": pa.array(np.full(len(keep), table.column("u")[0].as_py()), pa.int64()), "b": pa.array(np.full(len(keep), table.column("v")[0].as_py()), pa.int64()), "linked": pa.array(linked, pa.bool_())})

    looked = scratch.save(rows.groupBy("pair", "i", "j").applyInArrow(compare, "cls long, more long, a long, b long, linked boolean"), f"{tag}-looked")
    return counts.unionByName(looked.select("cls", "more")), edges.unionByName(looked.where("linked").select("a", "b"))


def _exact_pairs(units: DataFrame, scratch: Scratch, theta: float) -> DataFrame:
    """(u, v, cosine) as of ``_graph_pairs``, from all pairs: each two blocks of a label's units meet in one task."""
    sizes = units.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / SHARD_MOST).cast("int").alias("blocks"))
    rows = units.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("unit", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("grp", "unit", "vec", "radius", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def compare(table: pa.Table) -> pa.Table:
        data = table.sort_by("unit")
        ids, x, radius, own = data.column("unit").to_numpy(), _matrix(data.column("vec")), data.column("radius").to_numpy(), data.column("own").to_numpy()
        low, high = data.column("low")[0].as_py(), data.column("high")[0].as_py()
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        reach = math.cos(min(math.pi, theta + 2 * float(radius.max()) + 1e-6))
        out = []
        for i in range(0, len(left), 512):
            part = left[i : i + 512]
            cosines = x[part] @ x[right].T
            a, b = np.nonzero(cosines >= reach)
            c, a, b = cosines[a, b], part[a], right[b]
            points = (radius[a] == 0) & (radius[b] == 0)
            hit = np.where(points, c >= math.cos(theta), _angle(c) <= theta + radius[a] + radius[b] + MARGIN)
            hit &= (low != high) | (a < b)
            out.append((ids[a[hit]], ids[b[hit]], c[hit]))
        u, v, c = [np.concatenate(o) if out else np.array([], t) for o, t in zip(list(zip(*out)) or [()] * 3, (np.int64, np.int64, np.float64))]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "cosine": pa.array(c, pa.float64())})

    return scratch.save(rows.groupBy("grp", "low", "high").applyInArrow(compare, "u long, v long, cosine double"), "exact-pairs")


def audit(homes: DataFrame, found: DataFrame, scratch: Scratch, cosine: float, tag: str) -> DataFrame:
    """(grp, recall): by label, the mean share found of the links to other units, over the audited classes that have any.

    ``homes``: cls, grp, vec, w, asked, unit; ``found``: cls, links to other units.
    """
    asked = homes.where("asked").select("cls", "grp", "vec", "unit")
    passes = -(-asked.count() // AUDITED)
    true = []
    for at in range(passes):
        some = asked.where(F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(passes)) == at).collect()  # about AUDITED vectors
        shared = homes.sparkSession.sparkContext.broadcast([(r.cls, r.grp, bytes(r.vec), r.unit) for r in some])

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by: dict[str, list[tuple]] = {}
            for cls, g, vec, unit in shared.value:
                by.setdefault(g, []).append((cls, np.frombuffer(vec, np.float64), unit))
            cls = {g: np.array([r[0] for r in rows]) for g, rows in by.items()}
            x = {g: np.stack([r[1] for r in rows]) for g, rows in by.items()}
            unit = {g: np.array([r[2] for r in rows]) for g, rows in by.items()}
            total = {g: np.zeros(len(rows), np.int64) for g, rows in by.items()}
            for batch in batches:
                group = np.array(batch.column(0).to_pylist(), object)
                for g in set(group.tolist()) & set(by):
                    part = batch.take(pa.array(np.flatnonzero(group == g)))
                    hit = (x[g] @ _matrix(part.column(1)).T) >= cosine
                    hit &= unit[g][:, None] != part.column(3).to_numpy()[None, :]
                    total[g] += hit @ part.column(2).to_numpy()
            for g, n in total.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(cls[g][some], pa.int64()), pa.array(n[some], pa.int64())], ["_cls", "n"])

        counted = homes.select("grp", "vec", "w", "unit").mapInArrow(count, "_cls long, n long").groupBy("_cls").agg(F.sum("n").alias("n"))
        true.append(scratch.save(counted, f"{tag}-true{at}"))
        shared.unpersist()
    if not true:
        return asked.select("grp", F.lit(1.0).alias("recall"))
    rows = asked.join(reduce(DataFrame.unionByName, true), F.col("cls") == F.col("_cls")).join(found, "cls", "left")
    share = F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / F.col("n"))
    return scratch.save(rows.groupBy("grp").agg(F.avg(share).alias("recall")), f"{tag}-recall")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> tuple[DataFrame, float]:
    """((key, n_links, component_id, kept) for every row; the lowest audited recall of a label).

    Vectors are compared within equal labels and equal widths. Rows with a null
    id, label or vector, null or non-finite components, or only zeros have no
    links and are components of their own (null ids: a null component, not kept).
    Repeated rows are vectors of their own and linked; an empty table gives no
    rows; other columns are left out.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    theta = math.acos(cosine)
    valid = scratch.save(unit_vectors(df, key, vector, label), "valid")
    classes = scratch.save(valid.groupBy("cls", "grp", "vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("w"), F.max(F.pmod(F.col("id"), F.lit(100)) == 0).alias("asked")), "classes")

    # balls, among the classes that share their nearest centroid
    near = split(classes.select(F.col("cls").alias("p"), "grp", "vec"), scratch, "near", 1)
    sizes = near.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / SHARD_MOST).alias("salts"))
    parts = near.join(sizes, "grp").withColumn("salt", F.pmod(F.xxhash64("p", F.lit(5)), F.col("salts")))
    parts = parts.join(classes.select(F.col("cls").alias("p"), "w", F.col("grp").alias("base")), "p")

    def gather(table: pa.Table) -> pa.Table:
        data = table.sort_by("p")
        ids, w, vec = data.column("p").to_numpy(), data.column("w").to_numpy(), data.column("vec").to_pylist()
        x, base = _matrix(data.column("vec")), data.column("base")[0].as_py()
        rows = []
        single = np.ones(len(ids), bool)
        for inside, centre, radius in find_balls(x, theta):
            single[inside] = False
            unit, weight = int(ids[inside].min()), int(w[inside].sum())
            rows.append((1, None, unit, weight, np.ascontiguousarray(centre).tobytes(), max(radius, 1e-12), weight))
            rows += [(0, int(ids[i]), unit, int(w[i]), vec[i], 0.0, weight) for i in inside]
        for i in np.flatnonzero(single):
            rows.append((1, None, int(ids[i]), int(w[i]), vec[i], 0.0, int(w[i])))
            rows.append((0, int(ids[i]), int(ids[i]), int(w[i]), vec[i], 0.0, int(w[i])))
        c = list(zip(*rows))
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.int64()]
        names = ["kind", "cls", "unit", "w", "vec", "radius", "weight"]
        return pa.table({**{n: pa.array(v, t) for n, v, t in zip(names, c, types)}, "grp": pa.array([base] * len(rows), pa.string())})

    schema = "kind int, cls long, unit long, w long, vec binary, radius double, weight long, grp string"
    gathered = scratch.save(parts.groupBy("grp", "salt").applyInArrow(gather, schema), "units", ["kind"])
    units = gathered.where("kind = 1").select("unit", "vec", "radius", "weight", "grp")
    members = gathered.where("kind = 0").select("cls", "unit", "w", "vec", "weight")
    # a class's own copies and the rest of its ball
    inner = members.select("cls", (F.col("weight") - 1).alias("more"))

    homes = scratch.save(classes.join(members.select("cls", "unit"), "cls").select("cls", "grp", "vec", "w", "asked", "unit"), "homes")
    todo, settled, exact, recall = units, [], [], 1.0

    def of(labels: DataFrame, counts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        return counts.join(homes.join(labels, "grp", "left_semi").select("cls"), "cls", "left_semi"), edges.join(units.join(labels, "grp", "left_semi").select(F.col("unit").alias("a")), "a", "left_semi")

    for i, overlap in enumerate(OVERLAPS):
        tag = f"o{overlap}"
        pairs = _graph_pairs(todo, scratch, theta, overlap)
        counts, edges = _counted(pairs, todo, members, scratch, theta, cosine, tag)
        found = scratch.save(counts.groupBy("cls").agg(F.sum("more").alias("links")), f"{tag}-found")
        judged = audit(homes.join(todo.select("grp").distinct(), "grp", "left_semi"), found, scratch, cosine, tag)
        sizes = todo.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).join(judged, "grp", "left")
        below = F.lit("exact" if i == len(OVERLAPS) - 1 else "again")
        # without a link to measure by, a label of one block is compared whole
        fate = F.when(F.col("recall") < RECALL, below).when(F.col("recall").isNull() & (F.col("n") <= SHARD_MOST), "exact").otherwise("done")
        fates = scratch.save(sizes.withColumn("fate", fate), f"{tag}-fates")
        ends = {r["fate"]: r["recall"] for r in fates.groupBy("fate").agg(F.min("recall").alias("recall")).collect()}
        if "done" in ends:
            recall = min(recall, 1.0 if ends["done"] is None else ends["done"])
            settled.append(of(fates.where("fate = 'done'").select("grp"), counts, edges) if len(ends) > 1 else (counts, edges))
        if "exact" in ends:
            exact.append(fates.where("fate = 'exact'").select("grp"))
        if "again" not in ends:
            break
        todo = scratch.save(todo.join(fates.where("fate = 'again'").select("grp"), "grp", "left_semi"), f"{tag}-again")
    if exact:
        todo = scratch.save(units.join(reduce(DataFrame.unionByName, exact), "grp", "left_semi"), "exact")
        settled.append(_counted(_exact_pairs(todo, scratch, theta), todo, members, scratch, theta, cosine, "exact"))
    counts = reduce(DataFrame.unionByName, [c for c, _ in settled], inner)
    edges = reduce(DataFrame.unionByName, [e for _, e in settled]) if settled else units.select(F.col("unit").alias("a"), F.col("unit").alias("b")).limit(0)
    totals = scratch.save(counts.groupBy("cls").agg(F.sum("more").alias("n_links")), "totals")
    joined = components(edges, scratch, "links").withColumnsRenamed({"node": "unit"})
    roots = members.join(joined, "unit", "left").select("cls", F.coalesce("root", "unit").alias("root"))
    roots = roots.join(classes.select("cls", "low"), "cls")
    ids = roots.groupBy("root").agg(F.min("low").alias("component"))
    out = roots.join(ids, "root").select("cls", "component").join(totals, "cls")
    linked = scratch.save(out.where("n_links > 0"), "linked").withColumnRenamed("cls", "_cls")
    small = linked.count() <= BROADCAST_ROWS
    rows = valid.select("id", "cls").join(F.broadcast(linked) if small else linked, F.col("cls") == F.col("_cls"))
    # rows that repeat an id share its most links and smallest component
    found = rows.groupBy(F.col("id").alias("_id")).agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    base = df.select(F.col(key).alias("_key"))
    whole = base.join(found, F.col("_key") == F.col("_id"), "left")
    component = F.coalesce("component", "_key")
    return whole.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("_key"), F.lit(False)).alias("kept")), recall
