"""Remember, recall and maintain over a store: what the operators decide is checked, committed and audited.

Writes of one scope are decided one after another, scopes side by side. A call
is one commit: either all of its decisions show, with their audit rows, or none;
a call that raced with another writer raises ``StoreConflict`` and can be repeated.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keepsake.functions import scores, text, vectors
from keepsake.functions.embedding import DeterministicEmbedder, embed_udf, quantize
from keepsake.functions.hashing import content_digest, ulid
from keepsake.functions.scores import BASELINE, Config
from keepsake.operators import admission, auditing, composing, governance, maintenance, retrieval
from keepsake.sources.schema import ITEMS, VECTORS, struct
from keepsake.sources.shared import shared_path
from keepsake.sources.store import MemoryStore, StoreError

SCOPE = ["tenant", "subject", "namespace"]
POLICY, POLICY_VERSION = "baseline", "0.1.0"
#: Items of a scope that are listed as left out of a working set.
OMITTED = 50
# The audit event of each action.
EVENTS = {"retain": "admitted", "merge": "merged", "reject": "rejected"}

#: What a caller gives for a write; ``seq`` orders the writes of a scope, everything but it, the scope and the body may be null.
WRITES = T.StructType([ITEMS[c] if c in ITEMS.fieldNames() else T.StructField(c, t) for c, t in [
    ("subject", None), ("namespace", None), ("seq", T.LongType()), ("key", T.StringType()), ("body", None), ("kind", None), ("source_kind", None), ("source_id", None),
    ("occurred_at_s", None), ("tags", None), ("attrs", None), ("ttl_seconds", None), ("hint", T.StringType()), ("at_s", T.LongType()),
]])
_DECISION = "tenant:string subject:string namespace:string seq:long key:string payload_digest:string outcome:string action:string protection:string reason:string item_id:string evicted:strings sensitivity:string fragility:double at_s:long audit_id:string"
_FOLDED = struct(f"row:string {_DECISION} item:item scale:float q:binary", double=T.DoubleType(), item=ITEMS)


def charge(item: dict) -> int:
    """Bytes an item is charged for, with 64 for its fixed fields."""
    attrs = json.dumps(dict(sorted(dict(item["attrs"] or {}).items())), separators=(",", ":"), ensure_ascii=False)
    parts = [item["body"], item["kind"] or "", attrs, *(item["tags"] or []), item["source_id"] or "", item["subject"], item["namespace"]]
    return sum(len(p.encode()) for p in parts) + 64


def _union(a: list | None, b: list | None) -> list:
    return list(dict.fromkeys([*(a or []), *(b or [])]))


def _folder(cfg: Config, dim: int):
    """One scope's writes (left) against what the scope holds (right): decisions, and the final state of what changed."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        writes, held = sorted(left.to_pylist(), key=lambda w: w["seq"]), sorted(right.to_pylist(), key=lambda i: (i["created_at_s"], i["id"]))
        rows: list[dict] = []
        if writes:
            embedder = DeterministicEmbedder(dim)
            embedder.learn([w["body"] for w in writes if w["body"]])
            state = admission.ScopeState(writes[0]["max_items"], writes[0]["max_bytes"], embedder)
            now: dict[int, dict] = {}
            for n, i in enumerate(held, -len(held)):
                until = admission.FOREVER if i["protection"] == "pinned" else i["protected_until_s"] if i["protection"] == "protected" else None
                whole = i["q"] is not None and len(i["q"]) == dim
                code = np.frombuffer(i["q"], np.int8).astype(np.float32) if whole else np.zeros(dim, np.float32)
                state.add(admission.Item(n, i["body"], i["byte_size"], i["created_at_s"], until), code, i["scale"] if whole else np.nan)
                now[n] = {f: i[f] for f in ITEMS.fieldNames()}
            seen = {w["key"]: json.loads(w["stored"]) for w in writes if w["stored"]}
            changed: set[int] = set()
            for n, w in enumerate(writes):
                head = {c: w[c] for c in ("tenant", "subject", "namespace", "seq", "key", "payload_digest", "at_s")}
                if w["key"] is not None and w["key"] in seen:
                    first = seen[w["key"]]
                    same = first["payload_digest"] == w["payload_digest"]
                    rows.append(head | {"row": "decision"} | (first["outcome"] | {"outcome": "replayed"} if same else {"outcome": "conflict"}))
                    continue
                new = {f: w.get(f) for f in ITEMS.fieldNames()} | {"id": ulid(w["at_s"] * 1000), "created_at_s": w["at_s"], "kind": w["kind"] or "fact", "source_kind": w["source_kind"] or "agent", "tags": w["tags"] or [], "attrs": w["attrs"] or [], "access_count": 0, "last_access_s": None, "pending_embedding": False}
                size = charge(new) if new["body"] is not None else 0
                got = state.write(n, new["body"], w["at_s"], size, w["hint"], cfg)
                lost = [now.pop(s)["id"] for s in state.lost]
                changed -= set(state.lost)
                decided = {"action": got["action"], "protection": got["protection"], "reason": got["reason"], "item_id": None, "evicted": lost, "sensitivity": got["sensitivity"], "fragility": got.get("fragility")}
                if got["action"] == "retain":
                    now[n] = new | {"byte_size": size, "sensitivity": text.LEVELS.index(got["sensitivity"]), "protection": got["protection"], "protected_until_s": got["until"]}
                    decided["item_id"] = new["id"]
                    changed.add(n)
                elif got["action"] == "merge":
                    t = got["into_seq"]
                    at = next(k for k, i in enumerate(state.items) if i.seq == t)
                    # never below what either text was found to be
                    level = max(now[t]["sensitivity"] or 0, admission.sensitivity(new["body"], w["hint"]))
                    now[t] = now[t] | {"body": new["body"], "tags": _union(now[t]["tags"], new["tags"]), "attrs": list((dict(now[t]["attrs"] or {}) | dict(new["attrs"])).items()), "sensitivity": level, "pending_embedding": False}
                    now[t]["byte_size"] = charge(now[t])
                    state.resize(at, now[t]["byte_size"])
                    decided["item_id"] = now[t]["id"]
                    changed.add(t)
                rows.append(head | {"row": "decision", "outcome": "new", "audit_id": ulid(w["at_s"] * 1000)} | decided)
                if w["key"] is not None:
                    seen[w["key"]] = {"payload_digest": w["payload_digest"], "outcome": decided}
            place = {i.seq: k for k, i in enumerate(state.items)}
            for n in sorted(changed):
                k = place[n]
                rows.append({c: now[n][c] for c in SCOPE} | {"row": "item", "item": now[n], "scale": float(state.scales[k]), "q": state.codes[k].astype(np.int8).tobytes()})
        return pa.Table.from_pylist(rows, schema=to_arrow_schema(_FOLDED))

    return run


class Engine:
    """One tenant's memory under a policy."""

    def __init__(self, store: MemoryStore, tenant: str, cfg: Config = BASELINE, dim: int = 256):
        self.store, self.spark, self.tenant, self.cfg, self.dim = store, store.spark, tenant, cfg.validate(), dim
        self.embedder = f"deterministic-{dim}"

    def _saved(self, df: DataFrame, name: str) -> DataFrame:
        """Written once: ids are drawn and vectors made one time only, whatever is read from it later."""
        path = shared_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _own_vectors(self) -> DataFrame:
        return self.store.read("vectors", self.tenant).where((F.col("embedder") == self.embedder) & (F.col("dim") == self.dim))

    def set_policy(self, cfg: Config, now_s: int) -> None:
        """Another policy for this tenant: the change is audited first, then holds."""
        cfg.validate()
        at = self.store.state()
        self.store.commit(at, audit=self.store.read("audit").unionByName(self.store.event(self.tenant, "_admin", "_admin", "policy_changed", now_s, repr(cfg))))
        self.cfg = cfg

    def remember(self, writes: DataFrame) -> DataFrame:
        """Decides and stores the writes (columns of ``WRITES``); one row a write, with its ``outcome``.

        ``new``: decided now. ``replayed``: a write of this scope with this key and
        payload was decided before, in this call or an earlier one; what was decided
        then is returned and nothing changes. ``conflict``: the key came with another
        payload; nothing is decided. An invalid scope or hint refuses the whole call, an
        empty or oversized body is a rejected write.
        """
        at = self.store.state()
        shaped = writes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in writes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in WRITES])
        ok = text.valid_component(F.col("subject")) & text.valid_component(F.col("namespace")) & ~F.col("namespace").isin("_admin", "_purged") & F.col("seq").isNotNull() & F.col("at_s").isNotNull()
        ok = ok & (F.col("hint").isNull() | F.col("hint").isin(*text.LEVELS))
        if not shaped.where(~F.coalesce(ok, F.lit(False))).isEmpty():
            raise StoreError("a write has an invalid scope or hint, no seq or no time")
        payload = F.sha2(F.to_json(F.struct("body", "kind", "source_kind", "source_id", "occurred_at_s", "tags", F.array_sort(F.map_entries("attrs")).alias("attrs"), "ttl_seconds", "hint"), {"ignoreNullFields": "false"}), 256)
        w = shaped.withColumn("tenant", F.lit(self.tenant)).withColumn("payload_digest", payload)
        past = self.store.read("idempotency", self.tenant).select(*SCOPE, "key", F.col("outcome").alias("stored"))
        limits = self.store.read("budgets", self.tenant).select(*SCOPE, "max_items", "max_bytes")
        w = w.join(past, [*SCOPE, "key"], "left").join(limits, SCOPE, "left")
        items, vecs = self.store.read("items"), self.store.read("vectors")
        mine = items.where(F.col("tenant") == self.tenant).join(w.select(*SCOPE).distinct(), SCOPE, "left_semi")
        codes = self._own_vectors().select(*SCOPE, F.col("item_id").alias("id"), "scale", "q")
        held = mine.join(codes, [*SCOPE, "id"], "left").select(*ITEMS.fieldNames(), "scale", "q")
        folded = self._saved(w.groupBy(*SCOPE).cogroup(held.groupBy(*SCOPE)).applyInArrow(_folder(self.cfg, self.dim), _FOLDED), "fold")
        decided = folded.where("row = 'decision'")
        new = decided.where("outcome = 'new'")
        evicted = new.select(*SCOPE, F.explode("evicted").alias("id"))
        changed = folded.where("row = 'item'")
        # pins and unexpired protections hold, whatever a policy says
        guarded = mine.join(evicted, [*SCOPE, "id"], "left_semi").join(new.groupBy(*SCOPE).agg(F.max("at_s").alias("_now")), SCOPE)
        if not guarded.where((F.col("protection") == "pinned") | ((F.col("protection") == "protected") & (F.col("protected_until_s") > F.col("_now")))).isEmpty():
            raise StoreError("a decision evicts a guarded item")
        out = changed.select(*SCOPE, F.col("item.id").alias("id")).unionByName(evicted).distinct()
        digest = F.pandas_udf(lambda b, k, t: pd.Series([content_digest(x, y, list(z)) for x, y, z in zip(b, k, t)]), "string")
        named = changed.select(*SCOPE, F.col("item.id").alias("item_id"), digest("item.body", "item.kind", "item.tags").alias("digest"))
        refs = F.concat(F.when(F.col("item_id").isNotNull(), F.array(F.struct(F.col("item_id").alias("id"), "digest"))).otherwise(F.array()), F.transform("evicted", lambda i: F.struct(i.alias("id"), F.lit(None).cast("string").alias("digest"))))
        event = F.create_map(*[F.lit(x) for p in EVENTS.items() for x in p])[F.col("action")]
        audit = new.join(named, [*SCOPE, "item_id"], "left").select(
            *SCOPE, F.col("audit_id").alias("id"), "at_s", F.floor(F.col("at_s") / maintenance.DAY).alias("day"), event.alias("event"), refs.alias("items"), F.lit(POLICY).alias("policy_name"),
            F.lit(POLICY_VERSION).alias("policy_version"), F.lit(None).cast("float").alias("value"), F.col("fragility").cast("float").alias("fragility"), "reason", F.lit("agent").alias("actor"),
        )
        outcome = F.to_json(F.struct("payload_digest", F.struct("action", "protection", "reason", "item_id", "evicted", "sensitivity", "fragility").alias("outcome")), {"ignoreNullFields": "false"})
        keys = new.where("key is not null").select(*SCOPE, "key", "payload_digest", outcome.alias("outcome"), "at_s")
        gone = out.withColumnRenamed("id", "item_id")
        fresh = changed.select(*SCOPE, F.col("item.id").alias("item_id"), F.lit(self.embedder).alias("embedder"), F.lit(self.dim).alias("dim"), "scale", "q")
        self.store.commit(
            at,
            items=items.join(out, [*SCOPE, "id"], "left_anti").unionByName(changed.select("item.*")),
            vectors=vecs.join(gone, [*SCOPE, "item_id"], "left_anti").unionByName(fresh.select(*VECTORS.fieldNames())),
            audit=self.store.read("audit").unionByName(audit),
            idempotency=self.store.read("idempotency").unionByName(keys),
        )
        return decided.select(*[f.split(":")[0] for f in _DECISION.split()])

    def neighbours(self, items: DataFrame, embedding: list[float]) -> DataFrame:
        """(id, vector) of the items that have a vector of this engine's embedder; none if the probe is of another length."""
        if len(embedding) != self.dim:
            return self.spark.createDataFrame([], "id string, vector double")
        code, scale = quantize(np.asarray(embedding, np.float32))
        probe, by = code.astype(np.float32), float(scale)

        @F.pandas_udf("double")
        def product(q: pd.Series, s: pd.Series) -> pd.Series:
            rows = np.frombuffer(b"".join(q), np.int8).reshape(len(q), -1).astype(np.float32)  # exact: below 2**24
            return pd.Series((rows @ probe).astype(np.float64) * s.to_numpy(np.float64) * by)

        own = self._own_vectors().where(F.length("q") == self.dim)
        both = own.join(items.select(*SCOPE, F.col("id").alias("item_id")), [*SCOPE, "item_id"])
        return both.select(F.col("item_id").alias("id"), F.round(product("q", "scale"), 9).alias("vector"))

    def recall(
        self, subject: str, namespace: str, now_s: int, query: str | None = None, embedding: list[float] | None = None, mode: str = "working_set", max_tokens: int | None = 2000, max_items: int | None = 20,
        exclude_pending: bool = False, record: bool = True, **filters,
    ) -> tuple[list[dict], list[dict], int]:
        """(chosen, the first of the omitted, how many were omitted); ``filters`` are those of ``hard_filters``.

        Filters hold before any limit. A query without an embedding is embedded.
        BM25 statistics are the tenant's. The result is checked against what was
        offered, then recorded: an audit row, and the items' access statistics.
        Everything on the driver is bounded by the engine's limit (500 rows).
        """
        if mode not in ("working_set", "search"):
            raise StoreError(f"unknown mode: {mode}")
        if not (query or "").strip() and embedding is None:
            raise StoreError("a recall needs a query or an embedding")
        items = self.store.read("items", self.tenant)
        scoped = items.where((F.col("subject") == subject) & (F.col("namespace") == namespace))
        offered = retrieval.hard_filters(scoped.where(~F.col("pending_embedding")) if exclude_pending else scoped, **filters)
        if embedding is None:
            embedding = DeterministicEmbedder(self.dim).embed(query).tolist()
        limit = retrieval.engine_limit(max_items)
        none = self.spark.createDataFrame([], "id string, keyword double")
        try:
            words = retrieval.keyword_arm(items, query, ["subject", "namespace"]) if query else None
        except ValueError:
            words = None  # no letter and no digit in the query: the vectors alone decide
        words = none if words is None else words.where((F.col("subject") == subject) & (F.col("namespace") == namespace)).join(offered.select("id"), "id", "left_semi").select("id", F.round("keyword", 9).alias("keyword"))
        ranked = retrieval.fuse(self.neighbours(offered, embedding), words, limit)
        fragile = self.store.read("audit", self.tenant).where((F.col("subject") == subject) & (F.col("namespace") == namespace) & (F.col("event") == "admitted"))
        fragile = fragile.select(F.try_element_at("items", F.lit(1))["id"].alias("id"), "fragility").groupBy("id").agg(F.max("fragility").alias("fragility"))
        due = F.coalesce(scores.replay_due(F.col("fragility"), F.col("last_access_s"), F.col("created_at_s"), now_s, self.cfg), F.lit(False))
        rows = ranked.join(offered, "id").join(fragile, "id", "left").select("id", "body", "kind", "tags", "sensitivity", "relevance", text.estimated_tokens(F.col("body")).alias("estimated_tokens"), due.alias("due"))
        found = [r.asDict() for r in rows.collect()]  # ``limit`` rows at most
        if mode == "working_set":
            chosen, rest = composing.working_set(found, max_tokens, max_items, self.cfg)
        else:
            found.sort(key=lambda c: (-c["relevance"], c["id"]))
            chosen, used = [], 0
            for c in found:
                used += c["estimated_tokens"]
                if (max_tokens is not None and used > max_tokens) or (max_items is not None and len(chosen) >= max_items):
                    break
                chosen.append(c | {"place": len(chosen) + 1, "reason": "search_match"})
            rest = found[len(chosen) :]
        check_working_set(chosen, found, max_tokens, max_items)
        if record:
            row = self.store.event(self.tenant, subject, namespace, "recalled", now_s, mode, "agent", [c["id"] for c in chosen])
            self.store.record_recall(row)
        return chosen, rest[:OMITTED], len(rest)

    def maintain(self, now_s: int) -> dict[str, int]:
        """One run over all scopes, applied: expired and reclaimed items go, protections end or begin, near copies merge.

        A pinned item never goes. A merge appends the absorbed text, unites tags and
        attributes, and the result is embedded anew. Each scope that lost or released
        anything has a ``maintenance_run`` row, each merge a ``merged`` row.
        """
        at = self.store.state()
        items, vecs = self.store.read("items"), self.store.read("vectors")
        mine = items.where(F.col("tenant") == self.tenant)
        budgets = self.store.read("budgets", self.tenant).select(*SCOPE, "max_items", "max_bytes")
        state = mine.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("used_items"), F.sum("byte_size").alias("used_bytes")).join(budgets, SCOPE, "left")
        plan = self._saved(maintenance.run(mine, state, SCOPE, now_s, self.cfg), "maintenance")
        ids = plan.select(*SCOPE, "id", "phase", "into", "until_s")
        pinned = mine.where("protection = 'pinned'").select(*SCOPE, "id")
        gone = ids.where(F.col("phase").isin("expire", "reclaim")).select(*SCOPE, "id", "phase").join(pinned, [*SCOPE, "id"], "left_anti")
        freed = ids.where("phase in ('release', 'regrant')").select(*SCOPE, "id", F.col("phase").alias("_phase"), F.col("until_s").alias("_until"))
        pairs = ids.where("phase = 'merge'").select(*SCOPE, F.col("id").alias("absorbed"), F.col("into").alias("id"))
        source = mine.select(*SCOPE, F.col("id").alias("absorbed"), F.col("body").alias("_body"), F.col("tags").alias("_tags"), F.col("attrs").alias("_attrs"), F.col("sensitivity").alias("_level"))
        target = mine.join(pairs, [*SCOPE, "id"]).join(source, [*SCOPE, "absorbed"])
        attrs = lambda c: F.coalesce(F.col(c), F.create_map().cast("map<string,string>"))
        tags = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
        overlaid = F.map_concat(F.map_filter(attrs("attrs"), lambda k, _: ~F.map_contains_key(attrs("_attrs"), k)), attrs("_attrs"))
        both = target.withColumns({"_size": F.octet_length("body"), "_had": F.aggregate(tags("tags"), F.lit(0), lambda s, t: s + F.octet_length(t)), "_held": F.octet_length(F.to_json(attrs("attrs")))})
        both = both.withColumns({"body": F.concat("body", F.lit("\n\n"), "_body"), "tags": F.array_union(tags("tags"), tags("_tags")), "attrs": overlaid, "sensitivity": F.greatest("sensitivity", "_level")})
        grown = F.octet_length("body") - F.col("_size") + F.aggregate("tags", F.lit(0), lambda s, t: s + F.octet_length(t)) - F.col("_had") + F.octet_length(F.to_json("attrs")) - F.col("_held")
        both = both.withColumn("byte_size", F.col("byte_size") + grown).withColumn("embedding", embed_udf(self.dim)("body")).withColumn("pending_embedding", F.col("embedding").isNull())
        merged = self._saved(both.select(*ITEMS.fieldNames(), "absorbed", "embedding"), "merged")
        out = gone.select(*SCOPE, "id").unionByName(merged.select(*SCOPE, F.col("absorbed").alias("id"))).unionByName(merged.select(*SCOPE, "id"))
        # releases and re-grants name items that stay, merged or not
        kept = items.join(out, [*SCOPE, "id"], "left_anti").unionByName(merged.select(*ITEMS.fieldNames())).join(freed, [*SCOPE, "id"], "left")
        kept = kept.withColumns({
            "protection": F.when(F.col("_phase") == "release", "normal").when(F.col("_phase") == "regrant", "protected").otherwise(F.col("protection")),
            "protected_until_s": F.when(F.col("_phase") == "release", F.lit(None)).when(F.col("_phase") == "regrant", F.col("_until")).otherwise(F.col("protected_until_s")),
        }).drop("_phase", "_until")
        coded = merged.where("embedding is not null").withColumn("scale", vectors.scale(F.col("embedding")))
        fresh = coded.select(*SCOPE, F.col("id").alias("item_id"), F.lit(self.embedder).alias("embedder"), F.lit(self.dim).alias("dim"), "scale", vectors.pack(vectors.codes(F.col("embedding"), F.col("scale"))).alias("q"))
        counts = {r["phase"]: r["n"] for r in gone.groupBy("phase").agg(F.count(F.lit(1)).alias("n")).collect()} | {r["_phase"]: r["n"] for r in freed.groupBy("_phase").agg(F.count(F.lit(1)).alias("n")).collect()}
        report = {"scanned": mine.count(), "forgotten": counts.get("expire", 0) + counts.get("reclaim", 0), "released": counts.get("release", 0), "regranted": counts.get("regrant", 0), "consolidated": merged.count()}
        if any(v for k, v in report.items() if k != "scanned"):
            row_id = F.pandas_udf(lambda s: s.map(lambda _: ulid(now_s * 1000)), "string")
            base = {"at_s": F.lit(now_s), "day": F.lit(now_s // maintenance.DAY), "policy_name": F.lit(POLICY), "policy_version": F.lit(POLICY_VERSION), "value": F.lit(None), "fragility": F.lit(None), "actor": F.lit("system")}
            ref = lambda c: F.struct(F.col(c).alias("id"), F.lit(None).cast("string").alias("digest"))
            ran = gone.select(*SCOPE, "phase").unionByName(freed.where("_phase = 'release'").select(*SCOPE, F.col("_phase").alias("phase")))
            ran = ran.groupBy(*SCOPE).agg(F.count_if(F.col("phase") != "release").alias("f"), F.count_if(F.col("phase") == "release").alias("r"))
            # counts, not ids: a run may touch any number of items
            ran = ran.select(*SCOPE, F.lit("maintenance_run").alias("event"), F.array().cast("array<struct<id:string,digest:string>>").alias("items"), F.concat(F.col("f"), F.lit(" forgotten, "), F.col("r"), F.lit(" released")).alias("reason"))
            mrg = merged.select(*SCOPE, F.lit("merged").alias("event"), F.array(ref("absorbed"), ref("id")).alias("items"), F.lit("high_redundancy").alias("reason"))
            audit = self._saved(ran.unionByName(mrg).withColumn("id", row_id("subject")).withColumns(base).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.store.read("audit").schema]), "audit")
            dead = out.withColumnRenamed("id", "item_id")
            self.store.commit(at, items=kept, vectors=vecs.join(dead, [*SCOPE, "item_id"], "left_anti").unionByName(fresh), audit=self.store.read("audit").unionByName(audit))
        return report

    def stats(self, subject: str, namespace: str) -> dict:
        """Budget, usage, pending embeddings, vectors and the scope's embedder; zeros and None for an empty scope."""
        this = (F.col("subject") == subject) & (F.col("namespace") == namespace)
        items, vecs = self.store.read("items", self.tenant).where(this), self.store.read("vectors", self.tenant).where(this)
        use, limits, probe = governance.scope_stats(items).first(), self.store.read("budgets", self.tenant).where(this).first(), vecs.select("embedder", "dim").first()
        return {
            "item_count": use.item_count if use else 0, "total_bytes": use.total_bytes if use else 0, "median_item_bytes": use.median_item_bytes if use else 0, "pending": items.where("pending_embedding").count(),
            "vectors": vecs.count(), "embedder": probe.embedder if probe else None, "dim": probe.dim if probe else None, "max_items": limits.max_items if limits else None, "max_bytes": limits.max_bytes if limits else None, "mean_similarity": None,
        }

    def namespaces(self, subject: str) -> list[str]:
        return [r.namespace for r in self.store.read("items", self.tenant).where(F.col("subject") == subject).select("namespace").distinct().orderBy("namespace").collect()]

    def aggregates(self, since_day: int | None = None, until_day: int | None = None, policy: tuple[str | None, str | None] | None = None) -> DataFrame:
        """Daily aggregates of the tenant's audit in their order, both days included; ``policy`` may be (None, None)."""
        log = self.store.read("audit", self.tenant)
        for c, bound in ((F.col("day") >= F.lit(since_day), since_day), (F.col("day") <= F.lit(until_day), until_day)):
            log = log if bound is None else log.where(c)
        if policy is not None:
            log = log.where(F.col("policy_name").eqNullSafe(policy[0]) & F.col("policy_version").eqNullSafe(policy[1]))
        pct = {f"{c}_pct": F.floor(F.col(c).cast("double") * 100 + 1e-6) for c in ("value", "fragility")}
        return auditing.aggregates(log.withColumns(pct)).orderBy("day", F.asc_nulls_first("policy_name"), F.asc_nulls_first("policy_version"), "event")


def check_working_set(chosen: list[dict], offered: list[dict], max_tokens: int | None, max_items: int | None) -> None:
    """Refuses a working set that names an item twice or one that was not offered, gives no reason, or breaks its budget."""
    ids, known = [c["id"] for c in chosen], {c["id"]: c for c in offered}
    if len(set(ids)) != len(ids):
        raise StoreError("a working set names an item twice")
    if any(i not in known for i in ids):
        raise StoreError("a working set names an item that was not offered")
    if any(not c.get("reason") for c in chosen):
        raise StoreError("a working set gives no reason")
    if (max_items is not None and len(ids) > max_items) or (max_tokens is not None and sum(known[i]["estimated_tokens"] for i in ids) > max_tokens):
        raise StoreError("a working set is beyond its budget")
