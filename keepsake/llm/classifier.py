"""Quality classifier by co-training.

Two logistic classifiers see different views of a document: hashed words and
whole-text ratios on one side, page metadata on the other. Each round scores all
documents that are not fitted on yet, on the executors; each view hands the other
its surest ones, by rank within each class, as far down as its held-out labels
bear it out. Both are then calibrated on the held-out labels and their log-odds
added (less the prior, which each of them holds) to score every document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_prefix, slices, trim, worker_cache
from .rules import labelled
from .textstats import COUNTS, counts

#: Labelled rows fitted on at most; the unlabelled pool is all other rows.
LABELLED_ROWS = 5_000
WORD_SLOTS, META_SLOTS, RATIOS = 2048, 256, 9
CACHE_WORDS = 300_000
#: Rounds, and labels that a view hands over in one, at most (shared between the classes as the labels are).
ROUNDS, PER_ROUND = 4, 150
#: Least held-out precision of what a view hands over; for a class more frequent than that, half way from its share to 1.
SURE = 0.9


class _Slots(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = zlib.crc32(word) % WORD_SLOTS
        return found


_slots = _Slots()


def text_view(text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Slots, their values (of length 1 together), and the ratios."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    c = dict(zip(COUNTS, counts(text, words)))
    n, chars = max(1, c["n_words"]), max(1, c["word_chars"])
    ratios = [
        20 * c["n_symbols"] / chars, 20 * c["n_marks"] / chars, 2 * c["n_upper"] / chars, 5 * c["n_digits"] / chars, 2 * c["n_repeat_words"] / n,
        c["n_dup_lines"] / max(1, c["n_lines"]), chars / n / 10, c["n_distinct_words"] / n, np.log1p(c["n_words"]) / 8,
    ]
    worker_cache("word slots", _slots, CACHE_WORDS)
    hits = np.bincount(np.fromiter(map(_slots.__getitem__, words), np.int64, len(words)), minlength=WORD_SLOTS)
    at = np.flatnonzero(hits)
    value = np.log1p(hits[at])
    return at, value / max(1e-12, float(np.sqrt((value**2).sum()))), [min(3.0, float(r)) for r in ratios]


def meta_view(values: list) -> list[int]:
    """Slots of the metadata, one a value and one for all together.

    Strings as they are (of a URL its host), finite numbers by their power of
    two, everything else (null, NaN, infinite, dates, nested values) by how it is
    written.
    """
    known = []
    for v in values:
        if isinstance(v, str):
            known.append(v.split("://", 1)[1].split("/", 1)[0].lower() if "://" in v else v)
        elif isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) and math.isfinite(v):
            known.append(f"{'-' * (v < 0)}{int(abs(v)).bit_length()}")
        else:
            known.append("-" if v is None else repr(v))
    return [zlib.crc32(f"{i}={v}".encode("utf-8", "replace")) % META_SLOTS for i, v in enumerate([*known, "|".join(known)])]


def logistic(x: np.ndarray | list[np.ndarray], y: np.ndarray, start: np.ndarray | None = None, l2: float = 1e-3, steps: int = 250) -> np.ndarray:
    """Weights and intercept, by accelerated gradient descent in the precision of ``x``; classes weigh as they are.

    ``x``: the rows, or blocks of them, which are not copied: the driver holds them once.
    From the weights of an earlier round (``start``) a third of the steps is enough.
    """
    blocks = x if isinstance(x, list) else [x]
    kind = blocks[0].dtype
    ends = np.cumsum([0, *[len(b) for b in blocks]])
    w = v = np.zeros(blocks[0].shape[1] + 1, kind) if start is None else start.astype(kind)
    rate = kind.type(1 / (0.25 * (sum(float(np.einsum("ij,ij->i", b, b).sum()) for b in blocks) / len(y) + 1) + l2))
    for k in range(steps if start is None else steps // 3):
        g = kind.type(l2) * v
        g[-1] = 0
        for b, i, j in zip(blocks, ends[:-1], ends[1:]):
            z = np.clip(b @ v[:-1] + v[-1], -30, 30)
            d = (1 / (1 + np.exp(-z)) - y[i:j]).astype(kind)
            g[:-1] += b.T @ d / len(y)
            g[-1] += d.sum() / len(y)
        new = v - rate * g
        w, v = new, new + kind.type(k / (k + 3)) * (new - w)
    return w.astype(np.float64)


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that calibrate a score on held-out labels; a score that tells nothing gives the prior."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    middle, spread = float(score.mean()), float(score.std())
    if spread < 1e-9:
        return 0.0, prior
    x = np.stack([(score - middle) / spread, np.ones(len(score))])
    t = np.where(y == 1, hi, lo)

    def loss(w: np.ndarray) -> float:
        z = w @ x
        return float((np.logaddexp(0, z) - t * z).sum() + 1e-3 * w[0] ** 2)

    w = np.array([0.0, prior])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -500, 500)))
        grad = x @ (p - t) + np.array([2e-3 * w[0], 0.0])
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)) @ x.T + np.diag([2e-3, 1e-9]), grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    if w[0] <= 0:
        return 0.0, prior
    return float(w[0] / spread), float(w[1] - w[0] * middle / spread)


@dataclass
class CoTrained:
    """Weights of both views (the last is the intercept), their calibrations, the prior log-odds."""

    meta: list[str]
    w_text: np.ndarray = field(default_factory=lambda: np.zeros(WORD_SLOTS + RATIOS + 1))
    w_meta: np.ndarray = field(default_factory=lambda: np.zeros(META_SLOTS + 1))
    c_text: tuple[float, float] = (1.0, 0.0)
    c_meta: tuple[float, float] = (1.0, 0.0)
    prior: float = 0.0
    handed: list[dict[tuple[str, int], int]] = field(default_factory=list)

    def log_odds(self, text: str | None, meta: list) -> tuple[float, float, float]:
        at, value, ratios = text_view(text)
        s = float(self.w_text[at] @ value + self.w_text[WORD_SLOTS:-1] @ ratios + self.w_text[-1])
        m = float(self.w_meta[meta_view(meta)].sum() + self.w_meta[-1])
        s, m = self.c_text[0] * s + self.c_text[1], self.c_meta[0] * m + self.c_meta[1]
        return s, m, s + m - self.prior


@dataclass
class Rows:
    """What both views see of some rows; ``y``: 1 or 0; ``held``: used for calibration and precision only."""

    x: np.ndarray
    m: np.ndarray
    y: np.ndarray
    held: np.ndarray

    @staticmethod
    def of(frame: pd.DataFrame) -> Rows:
        frame = frame.sort_values(["hash", "label", "fold"], ignore_index=True)  # the order of rows decides nothing
        x = np.zeros((len(frame), WORD_SLOTS + RATIOS), np.float32)
        m = np.zeros((len(frame), META_SLOTS), np.float32)
        for i, r in enumerate(frame.itertuples()):
            x[i, np.frombuffer(r.at, "<u2")] = np.frombuffer(r.value, "<f4")
            x[i, WORD_SLOTS:] = np.frombuffer(r.ratios, "<f4")
            np.add.at(m[i], np.frombuffer(r.meta, "<u2"), 1)
        return Rows(x, m, frame["label"].to_numpy(int), frame["fold"].to_numpy(int) == 0)

    def views(self) -> dict[str, np.ndarray]:
        return {"text": self.x, "meta": self.m}


def sure_from(score: np.ndarray, y: np.ndarray, label: int) -> float:
    """The score from which on held-out rows have ``label`` precisely enough (of the largest such set); infinite if there is none."""
    order = np.argsort(-score, kind="stable")
    hits, n = np.cumsum(y[order] == label), np.arange(1, len(y) + 1)
    least = max(SURE, (1 + (y == label).mean()) / 2) if len(y) else 1.0
    last = np.r_[score[order][1:] < score[order][:-1], True] if len(y) else np.array([], bool)  # not within ties
    good = np.flatnonzero(((hits + 1) / (n + 2) >= least) & last)
    return float(score[order][good[-1]]) if len(good) else math.inf


_FEATURES = ["hash", "at", "value", "ratios", "meta"]
_FEATURE_TYPES = "hash long, at binary, value binary, ratios binary, meta binary"


def view_rows(rows: DataFrame, n: int, extra: list[str]) -> DataFrame:
    """The ``extra`` columns and both views, packed, of rows (text, m0, m1, ..., extra). One pass over the texts."""
    schema = T.StructType([*[rows.schema[c] for c in extra], *T._parse_datatype_string(_FEATURE_TYPES).fields])

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [text_view(t) for t in batch.column("text").to_pylist()]
            metas = zip(*[batch.column(f"m{i}").to_pylist() for i in range(n)]) if n else [()] * batch.num_rows
            packed = [(a.astype("<u2").tobytes(), v.astype("<f4").tobytes(), np.array(r, "<f4").tobytes(), np.array(meta_view(list(m)), "<u2").tobytes()) for (a, v, r), m in zip(out, metas)]
            hashes = [xxhash.xxh3_64_intdigest(b"|".join(f)) - 2**63 for f in packed]
            columns = [pa.array(c, pa.binary()) for c in zip(*packed)] if packed else [pa.array([], pa.binary())] * 4
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in extra], pa.array(hashes, pa.int64()), *columns], schema.names)
        trim()

    return rows.mapInArrow(view, schema)


def surest(pool: DataFrame, w: dict[str, np.ndarray], least: dict[tuple[str, int], float], most: dict[int, int], known: dict[str, set[int]]) -> pd.DataFrame:
    """(view, label, features): of all rows of the pool, each view's ``most[label]`` surest of each class.

    Rows are scored in batches on the executors, every task keeps its own best,
    and those are ranked once more; equal rows count as one. At most four times
    PER_ROUND rows reach the driver, whatever the size of the pool.
    """
    shared = pool.sparkSession.sparkContext.broadcast((w, least, most, known))  # weights, and PER_ROUND hashes a round

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, least, most, known = shared.value
        kept: dict[tuple[str, int], list[tuple[float, int, tuple]]] = {k: [] for k in least}
        for batch in slices(batches):
            hashes = batch.column("hash").to_numpy()
            ats, values = batch.column("at").to_pylist(), batch.column("value").to_pylist()
            size = np.array([len(a) // 2 for a in ats], np.int64)
            owner = np.repeat(np.arange(len(ats)), size)
            terms = w["text"][np.frombuffer(b"".join(ats), "<u2")] * np.frombuffer(b"".join(values), "<f4")
            ratios = np.frombuffer(b"".join(batch.column("ratios").to_pylist()), "<f4").reshape(len(ats), RATIOS)
            metas = np.frombuffer(b"".join(batch.column("meta").to_pylist()), "<u2").reshape(len(ats), -1)
            z = {"text": np.bincount(owner, terms, len(ats)) + ratios @ w["text"][WORD_SLOTS:-1] + w["text"][-1], "meta": w["meta"][metas].sum(1) + w["meta"][-1]}
            for (view, label), cut in least.items():
                sign = z[view] if label else -z[view]
                at = np.flatnonzero(sign >= cut)
                at = at[np.lexsort((hashes[at], -sign[at]))]
                have = {h for _, h, _ in kept[view, label]}
                for i in at.tolist():
                    h = int(hashes[i])
                    if h in have or h in known[view]:
                        continue
                    if len(have) >= 2 * most[label]:
                        break
                    have.add(h)
                    kept[view, label].append((-float(sign[i]), h, tuple(batch.column(c)[i].as_py() for c in _FEATURES)))
                kept[view, label] = sorted(kept[view, label])[: most[label]]
        rows = [(view, label, -s, *f) for (view, label), found in kept.items() for s, _, f in found]
        if rows:
            c = list(zip(*rows))
            types = [pa.string(), pa.int32(), pa.float64(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, types)], ["view", "label", "sure", *_FEATURES])
        trim()

    found = pool.mapInArrow(best, f"view string, label int, sure double, {_FEATURE_TYPES}").dropDuplicates(["view", "label", "hash"])
    salt = F.pmod(F.xxhash64("hash"), F.lit(32))
    order = [F.desc("sure"), "hash"]
    limit = F.create_map(*[F.lit(x) for k, v in most.items() for x in (k, v)])[F.col("label")]
    part = found.withColumn("_n", F.row_number().over(Window.partitionBy("view", "label", salt).orderBy(*order))).where(F.col("_n") <= limit)
    top = part.withColumn("_n", F.row_number().over(Window.partitionBy("view", "label").orderBy(*order))).where(F.col("_n") <= limit)
    out = top.drop("_n", "sure").toPandas()
    shared.unpersist()
    return out


def _score(view: np.ndarray, w: np.ndarray) -> np.ndarray:
    return view @ w[:-1].astype(view.dtype) + w[-1]


def calibrated(model: CoTrained, rows: Rows, check: np.ndarray, w: dict[str, np.ndarray]) -> None:
    """Sets the model's weights, and its calibration by the ``check`` rows."""
    y = rows.y[check]
    model.w_text, model.w_meta = w["text"], w["meta"]
    model.c_text, model.c_meta = platt(_score(rows.x[check], w["text"]), y), platt(_score(rows.m[check], w["meta"]), y)
    model.prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))


def cotrain(rows: Rows, pool: Callable[..., pd.DataFrame] | None, meta: list[str], rounds: int = ROUNDS) -> CoTrained:
    """Fits both views; ``pool`` is ``surest`` with its table. ``handed`` of the result counts (from view, label) by round.

    The weights are those of the round with the least held-out loss of both views together.
    """
    model = CoTrained(meta)
    seed = ~rows.held
    if len(set(rows.y[seed].tolist())) < 2:
        return model
    views = rows.views()
    fitted = {k: ([v[seed]], [rows.y[seed]]) for k, v in views.items()}
    check = rows.held if len(set(rows.y[rows.held].tolist())) == 2 else seed
    share = float(rows.y[seed].mean())
    most = {1: max(1, round(PER_ROUND * share)), 0: max(1, round(PER_ROUND * (1 - share)))}
    known: dict[str, set[int]] = {"text": set(), "meta": set()}
    w: dict[str, np.ndarray] = {}
    least_loss = math.inf
    for r in range(rounds + 1):
        w = {k: logistic(x, np.concatenate(y), w.get(k)) for k, (x, y) in fitted.items()}
        calibrated(model, rows, check, w)
        z = model.c_text[0] * _score(rows.x[check], w["text"]) + model.c_text[1] + model.c_meta[0] * _score(rows.m[check], w["meta"]) + model.c_meta[1] - model.prior
        loss = float((np.logaddexp(0, z) - rows.y[check] * z).mean())
        if loss <= least_loss:  # a round that the held-out labels speak against is not kept
            least_loss, best = loss, w
        if r == rounds or pool is None:
            break
        least = {(k, c): sure_from(_score(v[check], w[k]) * (1 if c else -1), rows.y[check], c) for k, v in views.items() for c in (1, 0)}
        least = {k: v for k, v in least.items() if v < math.inf}
        got = pool(w, least, most, known) if least else pd.DataFrame(columns=["view", "label", *_FEATURES])
        model.handed.append({k: int(((got["view"] == k[0]) & (got["label"] == k[1])).sum()) for k in sorted(least)})
        for k, other in (("text", "meta"), ("meta", "text")):
            mine = got[got["view"] == k]
            if len(mine):
                known[k] |= set(mine["hash"].tolist())
                new = Rows.of(mine.assign(fold=1))
                fitted[other][0].append(new.views()[other])
                fitted[other][1].append(new.y)
        if got.empty:
            break
    calibrated(model, rows, check, best)
    return model


def fit(docs: DataFrame, labels: DataFrame, meta: list[str], text: str = "text", key: str = "doc_id", label: str = "quality", rounds: int = ROUNDS) -> CoTrained:
    """Fits on at most LABELLED_ROWS labelled rows, chosen by hash of the key, and on what the views hand over of all other rows.

    Rows that repeat a labelled key are labelled alike; null keys are never
    labelled. Metadata may be of any type.
    """
    scratch = Scratch(docs.sparkSession)
    some = labelled(labels, key, label, LABELLED_ROWS)
    rows = docs.select(docs[key].alias("_id"), docs[text].alias("text"), *[docs[c].alias(f"m{i}") for i, c in enumerate(meta)])
    fold = F.pmod(F.xxhash64("_key", F.lit(5)), F.lit(5)).cast("int")
    marked = rows.join(F.broadcast(some), F.col("_id") == F.col("_key"), "left").withColumn("fold", fold).withColumn("label", F.col("_label").cast("int"))
    seen = scratch.save(view_rows(marked.drop("_id", "_key", "_label"), len(meta), ["fold", "label"]), "views")
    # one row for each different one that is labelled
    own = seen.where("label is not null").dropDuplicates().orderBy("hash").limit(2 * LABELLED_ROWS).toPandas()
    pool = seen.where("label is null")
    model = cotrain(Rows.of(own), lambda *a: surest(pool, *a), meta, rounds)
    del own
    trim()
    return model


def score(docs: DataFrame, model: CoTrained, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The ``keep`` columns and ``prefix`` + p_text, p_meta, p_good, accepted for every row.

    Null and empty texts have no words and zero ratios; null metadata is a value
    of its own; repeated rows score alike; an empty table gives no rows. Without
    labels of both kinds every document has 0.5 and is accepted.
    """
    keep = docs.columns if keep is None else keep
    names = [prefix + c for c in ("p_text", "p_meta", "p_good", "accepted")]
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(c, T.DoubleType()) for c in names[:3]], T.StructField(names[3], T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    own = free_prefix(docs)
    body, meta = own + "text", [f"{own}m{i}" for i in range(len(model.meta))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            rows = zip(*[batch.column(c).to_pylist() for c in meta]) if meta else [()] * batch.num_rows
            z = np.array([model.log_odds(t, list(v)) for t, v in zip(batch.column(body).to_pylist(), rows)], float).reshape(-1, 3)
            p = np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(p[:, i]) for i in range(3)], pa.array(p[:, 2] >= 0.5)], [*keep, *names])
        trim()

    return docs.select(*keep, docs[text].alias(body), *[docs[c].alias(a) for a, c in zip(meta, model.meta)]).mapInArrow(run, schema)


def keep_accepted(docs: DataFrame, model: CoTrained, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with the columns they came with."""
    prefix = free_prefix(docs)
    return score(docs, model, text, None, prefix).where(f"`{prefix}accepted`").select(*docs.columns)
