"""A versioned store of Parquet tables: staged writes, one pointer file, tenants as partitions.

A commit writes the changed tables to a new version folder and then a new numbered
pointer, which no other writer can have taken; the highest whole pointer is current,
and nothing is deleted before, so readers see all of a commit or nothing, whenever
a writer dies. Removals are anti-joins and merges are joins on id.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.hashing import ulid

from .schema import TABLES, VERSION

#: Items that one administrative audit row names at most (their number is in its reason).
REFS = 1_000


class StoreError(ValueError):
    """A request the store refuses."""


def _now(given: int | None) -> int:
    return int(time.time()) if given is None else given


class StoreConflict(StoreError):
    """Another writer has committed since this one read; nothing of this commit shows."""


class MemoryStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._latest() is None:
            # a store made before pointers had numbers goes on from its one pointer
            found = self._load("current.json") if self._names("current.json") else None
            if found is None and self._names("v-"):
                raise StoreError("the folder holds versions but no pointer: it is not made anew")
            try:
                self._point(0, found or {"version": VERSION, "tables": {}})
            except StoreConflict:
                pass  # made by another at the same time
        if (found := self._pointer()["version"]) != VERSION:
            raise StoreError(f"the store has version {found}, not {VERSION}")

    def _names(self, prefix: str) -> list[str]:
        where = self._path(self.root)
        return sorted(n for n in (f.getPath().getName() for f in self._fs.listStatus(where)) if n.startswith(prefix)) if self._fs.exists(where) else []

    def _load(self, name: str) -> dict | None:
        """A pointer, or None if its writer died before it was whole."""
        raw = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            held = bytes(raw.readAllBytes())
        finally:
            raw.close()
        try:
            return json.loads(held)
        except ValueError:
            return None

    def _latest(self) -> tuple[int, dict] | None:
        """The highest whole pointer, with the number that a next one takes."""
        names = self._names("pointer-")
        for name in reversed(names):
            if (found := self._load(name)) is not None:
                return int(names[-1][8:-5]) + 1, found
        return None

    def _pointer(self) -> dict:
        return self._latest()[1]

    def _point(self, number: int, to: dict) -> None:
        """Writes a new pointer under a number that nobody has taken: of two writers from the same state, one fails."""
        name = f"{self.root}/pointer-{number:012d}.json"
        try:
            out = self._fs.create(self._path(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise StoreConflict(f"{name} exists") from None
            raise
        out.write(bytearray(json.dumps(to).encode()))
        out.close()

    def read(self, table: str, tenant: str | None = None) -> DataFrame:
        """The current rows; a tenant prunes to its partition."""
        at = self._pointer()["tables"].get(table)
        df = self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{at}/{table}") if at else self.spark.createDataFrame([], TABLES[table])
        return df if tenant is None else df.where(F.col("tenant") == tenant)

    def state(self) -> int:
        """The number of the next commit: a writer that passes it on is refused if anyone commits in between."""
        return self._latest()[0]

    def commit(self, at: int | None = None, **tables: DataFrame) -> None:
        """Writes whole new contents of the named tables and makes them current together.

        ``at``: the ``state`` that the contents were computed from (by default the
        state now). If another commit has been made since, this is a StoreConflict.
        """
        number, _ = self._latest()
        if at is not None and at != number:
            raise StoreConflict("another commit was made since this one's state was read")
        version = f"v-{uuid.uuid4().hex}"
        for name, df in tables.items():
            shaped = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]])
            by = ["tenant", "day"] if name == "audit" else ["tenant"]
            # sorted within files, so that scope filters skip row groups
            order = [c for c in ("subject", "namespace", "id", "item_id", "key") if c in shaped.columns]
            shaped.sortWithinPartitions(*by, *order).write.partitionBy(*by).parquet(f"{self.root}/{version}/{name}")
        now = self._latest()[1] if at is None else self._load_before(number)
        self._point(number, now | {"tables": now["tables"] | dict.fromkeys(tables, version)})

    def _load_before(self, number: int) -> dict:
        return next(p for n in reversed(self._names("pointer-")) if int(n[8:-5]) < number and (p := self._load(n)) is not None)

    def vacuum(self, keep: int = 10) -> int:
        """Deletes all pointers but the latest ``keep`` whole ones, and the versions that none of those names; how many versions went.

        Readers of older states and writers that have not committed yet must be done.
        """
        names = [n for n in self._names("pointer-") if self._load(n) is not None]
        named = {v for n in names[-keep:] for v in self._load(n)["tables"].values()}
        for n in names[:-keep]:
            self._fs.delete(self._path(f"{self.root}/{n}"), False)
        gone = [v for v in self._names("v-") if v not in named]
        for v in gone:
            self._fs.delete(self._path(f"{self.root}/{v}"), True)
        return len(gone)

    def event(self, tenant: str, subject: str, namespace: str, event: str, at_s: int, reason: str | None = None, actor: str = "admin", items: list[str] | None = None) -> DataFrame:
        """One audit row of an administrative event."""
        refs = [(i, None) for i in sorted(items or [])[:REFS]]
        row = {"tenant": tenant, "id": ulid(at_s * 1000), "at_s": at_s, "day": at_s // 86_400, "subject": subject, "namespace": namespace, "event": event, "items": refs, "reason": reason, "actor": actor}
        return self.spark.createDataFrame([tuple(row.get(f.name) for f in TABLES["audit"])], TABLES["audit"])

    def append(self, table: str, rows: DataFrame) -> None:
        self.commit(self.state(), **{table: self.read(table).unionByName(rows, allowMissingColumns=True)})

    def upsert(self, rows: DataFrame) -> None:
        """Items by id; a row that replaces another keeps its access statistics."""
        at, old = self.state(), self.read("items")
        key = ["tenant", "subject", "namespace", "id"]
        stats = old.select(*key, F.col("last_access_s").alias("_at"), F.col("access_count").alias("_n"))
        new = rows.join(stats, key, "left").withColumns({"last_access_s": F.coalesce("_at", "last_access_s"), "access_count": F.coalesce("_n", "access_count", F.lit(0))}).drop("_at", "_n")
        self.commit(at, items=old.join(rows.select(*key), key, "left_anti").unionByName(new))

    def forget(self, tenant: str, subject: str, namespace: str, ids: list[str] | None = None, tag: str | None = None, kind: str | None = None, now_s: int | None = None) -> DataFrame:
        """Removes by ids, a tag or a kind (one of them), pinned or not, with an audit row; returns the removed ids."""
        if sum(x is not None for x in (ids, tag, kind)) != 1:
            raise StoreError("give ids, a tag or a kind: exactly one")
        at, items = self.state(), self.read("items")
        chosen = F.col("id").isin(ids) if ids is not None else F.array_contains("tags", tag) if tag is not None else F.col("kind") == kind
        gone = items.where((F.col("tenant") == tenant) & (F.col("subject") == subject) & (F.col("namespace") == namespace) & chosen).select("tenant", "subject", "namespace", "id")
        named = [r.id for r in gone.orderBy("id").select("id").limit(REFS).collect()]
        row = self.event(tenant, subject, namespace, "forgotten", _now(now_s), f"{gone.count()} items", items=named)
        self._remove(items, gone, at, row)
        return gone.select("id")

    def _remove(self, items: DataFrame, gone: DataFrame, at: int, audit: DataFrame) -> None:
        key = ["tenant", "subject", "namespace"]
        vectors = self.read("vectors").join(gone.withColumnRenamed("id", "item_id"), [*key, "item_id"], "left_anti")
        self.commit(at, items=items.join(gone, [*key, "id"], "left_anti"), vectors=vectors, audit=self.read("audit").unionByName(audit))

    def protect(self, tenant: str, subject: str, namespace: str, item: str, protection: str, until_s: int | None = None, now_s: int | None = None) -> None:
        if (protection == "protected") != (until_s is not None) or protection not in ("normal", "protected", "pinned"):
            raise StoreError("protected needs an end, and only protected has one")
        this = (F.col("tenant") == tenant) & (F.col("subject") == subject) & (F.col("namespace") == namespace) & (F.col("id") == item)
        at, items = self.state(), self.read("items")
        if items.where(this).isEmpty():
            raise StoreError("no such item in this scope")
        new = {"protection": F.when(this, protection).otherwise(F.col("protection")), "protected_until_s": F.when(this, F.lit(until_s).cast("long")).otherwise(F.col("protected_until_s"))}
        row = self.event(tenant, subject, namespace, "protected", _now(now_s), protection, items=[item])
        self.commit(at, items=items.withColumns(new), audit=self.read("audit").unionByName(row))

    def purge_subject(self, tenant: str, subject: str, cascade_audit: bool = False, now_s: int | None = None) -> dict[str, int]:
        """Deletes a subject's rows in every table (its audit only on cascade); counts what went and what stayed.

        A row of the purge itself, which names no item, is added to the audit.
        """
        at = self.state()
        this = (F.col("tenant") == tenant) & (F.col("subject") == subject)
        counts = {f"removed_{t}": self.read(t).where(this).count() for t in ("items", "vectors")}
        counts["removed_audit" if cascade_audit else "preserved_audit"] = self.read("audit").where(this).count()
        tables = {t: self.read(t).where(~this) for t in ("items", "vectors", "budgets", "idempotency")}
        audit = self.read("audit").where(~this) if cascade_audit else self.read("audit")
        row = self.event(tenant, subject, "", "purged", _now(now_s), f"{counts['removed_items']} items")
        self.commit(at, **tables, audit=audit.unionByName(row))
        return counts

    def set_budget(self, tenant: str, subject: str, namespace: str, max_items: int | None, max_bytes: int | None, now_s: int | None = None) -> None:
        at = self.state()
        this = (F.col("tenant") == tenant) & (F.col("subject") == subject) & (F.col("namespace") == namespace)
        row = self.spark.range(1).select(F.lit(tenant).alias("tenant"), F.lit(subject).alias("subject"), F.lit(namespace).alias("namespace"), F.lit(max_items).cast("long").alias("max_items"), F.lit(max_bytes).cast("long").alias("max_bytes"))
        event = self.event(tenant, subject, namespace, "policy_changed", _now(now_s), f"max_items {max_items}, max_bytes {max_bytes}")
        self.commit(at, budgets=self.read("budgets").where(~this).unionByName(row), audit=self.read("audit").unionByName(event))

    def record_recall(self, audit: DataFrame) -> None:
        """Appends the audit rows and bumps the access statistics of the items they name."""
        hits = audit.select("tenant", "subject", "namespace", "at_s", F.explode("items").alias("item")).groupBy("tenant", "subject", "namespace", F.col("item.id").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.max("at_s").alias("_at"))
        at = self.state()
        items = self.read("items").join(hits, ["tenant", "subject", "namespace", "id"], "left")
        new = {"access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0)), "last_access_s": F.coalesce("_at", "last_access_s")}
        self.commit(at, items=items.withColumns(new).drop("_n", "_at"), audit=self.read("audit").unionByName(audit, allowMissingColumns=True))

    def list_page(self, tenant: str, subject: str, namespace: str, offset: int = 0, limit: int = 1000) -> DataFrame:
        rows = self.read("items", tenant).where((F.col("subject") == subject) & (F.col("namespace") == namespace))
        return rows.orderBy("created_at_s", "id").offset(offset).limit(min(limit, 1000))

    def get(self, tenant: str, subject: str, namespace: str, item: str) -> DataFrame:
        return self.read("items", tenant).where((F.col("subject") == subject) & (F.col("namespace") == namespace) & (F.col("id") == item)).limit(1)

