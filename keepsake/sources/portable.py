"""NDJSON and Markdown archives of a store, and hardened import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.functions import text
from keepsake.plans.fixtures import DAY
from keepsake.sources.schema import AUDIT, ITEMS
from keepsake.sources.store import MemoryStore, StoreError

FORMAT_VERSION = 1
_ITEM, _AUDIT = ITEMS.simpleString(), AUDIT.simpleString()
LINE = f"record string, format_version int, exported_at long, item {_ITEM}, vector struct<embedder:string,dim:int,scale:float,q_base64:string>, audit {_AUDIT}"


def export_lines(store: MemoryStore, tenant: str, at_s: int, subject: str | None = None, namespace: str | None = None, with_audit: bool = False) -> DataFrame:
    """(kind_rank, id, value): the header, items by id with their vectors, then audit by id; write in this order."""

    def scoped(df: DataFrame) -> DataFrame:
        for c, v in (("subject", subject), ("namespace", namespace)):
            df = df if v is None else df.where(F.col(c) == v)
        return df

    spark = store.spark
    head = spark.range(1).select(F.lit(0).alias("kind_rank"), F.lit("").alias("id"), F.to_json(F.struct(F.lit("header").alias("record"), F.lit(FORMAT_VERSION).alias("format_version"), F.lit(at_s).alias("exported_at"))).alias("value"))
    items = scoped(store.read("items", tenant))
    v = store.read("vectors", tenant).select("item_id", F.struct("embedder", "dim", "scale", F.base64("q").alias("q_base64")).alias("vector"))
    body = items.join(v, items["id"] == v["item_id"], "left").select(F.lit(1).alias("kind_rank"), "id", F.to_json(F.struct(F.lit("item").alias("record"), F.struct(*[items[c] for c in items.columns]).alias("item"), "vector")).alias("value"))
    out = head.unionByName(body)
    if with_audit:
        audit = scoped(store.read("audit", tenant))
        out = out.unionByName(audit.select(F.lit(2).alias("kind_rank"), "id", F.to_json(F.struct(F.lit("audit").alias("record"), F.struct(*audit.columns).alias("audit"))).alias("value")))
    return out


def write_ndjson(lines: DataFrame, path: str) -> None:
    lines.repartitionByRange("kind_rank", "id").sortWithinPartitions("kind_rank", "id").select("value").write.text(path)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One row a line; blank lines are passed over, a line that is no record is an error."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    rows = raw.select("value", F.from_json("value", LINE, {"mode": "PERMISSIVE"}).alias("r"))
    known = F.col("r.record").isin("header", "item", "audit")
    checked = F.when(F.coalesce(known, F.lit(False)), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("not a record: "), F.substring("value", 1, 200))))
    return rows.select(checked.alias("r")).select("r.*")


def import_into(store: MemoryStore, tenant: str, records: DataFrame, now_s: int, window_days: int = 30) -> int:
    """All or nothing: checks the whole stream, then adds the items whose ids are new.

    Sensitivity is raised to what is detected, pins are dropped, and protection
    ends within the window.
    """
    at = store.state()
    counts = records.agg(
        F.count_if(F.col("record") == "header").alias("heads"), F.count_if((F.col("record") == "header") & (F.col("format_version") != FORMAT_VERSION)).alias("other"),
        F.count_if((F.col("record") == "item") & ~F.col("item.tenant").eqNullSafe(tenant)).alias("items"), F.count_if((F.col("record") == "audit") & ~F.col("audit.tenant").eqNullSafe(tenant)).alias("audit"),
        F.count_if((F.col("record") == "item") & ~F.coalesce(text.valid_component(F.col("item.subject")) & text.valid_component(F.col("item.namespace")), F.lit(False))).alias("scopes"),
    ).first()
    if not counts["heads"] or counts["other"]:
        raise StoreError("the archive needs a header of this version")
    if counts["items"] or counts["audit"]:
        raise StoreError("a record belongs to another tenant")
    if counts["scopes"]:
        raise StoreError("a record has an invalid scope")
    held = store.read("items")
    rows = records.where(F.col("record") == "item").select("item.*").dropDuplicates(["tenant", "subject", "namespace", "id"])
    rows = rows.join(held.select("tenant", "subject", "namespace", "id"), ["tenant", "subject", "namespace", "id"], "left_anti")
    level = rows.withColumns(text.sensitivity(F.col("body"))).withColumn("_level", text.level())
    hardened = level.withColumns({
        "sensitivity": F.greatest("sensitivity", "_level"), "protection": F.when(F.col("protection") == "pinned", "normal").otherwise(F.col("protection")),
        "protected_until_s": F.when(F.col("protection") == "protected", F.least(F.col("protected_until_s"), F.lit(now_s + window_days * DAY))),
    }).select(*ITEMS.fieldNames())
    n = hardened.count()
    # a vector comes with its item; an item without one is found by vector only after a backfill
    new = hardened.select("tenant", "subject", "namespace", F.col("id").alias("item_id"))
    if "vector" not in records.columns:
        records = records.withColumn("vector", F.lit(None).cast("struct<embedder:string,dim:int,scale:float,q_base64:string>"))
    given = records.where((F.col("record") == "item") & F.col("vector").isNotNull()).select("item.tenant", "item.subject", "item.namespace", F.col("item.id").alias("item_id"), "vector.embedder", "vector.dim", "vector.scale", F.unbase64("vector.q_base64").alias("q"))
    whole = given.where((F.col("dim") > 0) & (F.length("q") == F.col("dim")) & (F.col("scale") > 0) & (F.col("embedder") != ""))
    vectors = whole.dropDuplicates(["tenant", "subject", "namespace", "item_id"]).join(new, ["tenant", "subject", "namespace", "item_id"], "left_semi")
    have = vectors.select("tenant", "subject", "namespace", F.col("item_id").alias("id"), F.lit(True).alias("_have"))
    hardened = hardened.join(have, ["tenant", "subject", "namespace", "id"], "left").withColumn("pending_embedding", F.col("_have").isNull()).drop("_have")
    audit = records.where(F.col("record") == "audit").select("audit.*")
    audit = audit.join(store.read("audit").select("tenant", "id"), ["tenant", "id"], "left_anti")
    done = store.event(tenant, "", "", "imported", now_s, f"{n} items")
    store.commit(at, items=held.unionByName(hardened), vectors=store.read("vectors").unionByName(vectors), audit=store.read("audit").unionByName(audit).unionByName(done))
    return n


def markdown(items: DataFrame) -> DataFrame:
    """(subject, namespace, id, value): a scope heading before its first item, then a section per item."""
    first = F.row_number().over(Window.partitionBy("subject", "namespace").orderBy("id")) == 1
    head = F.when(first, F.concat(F.lit("# "), F.concat_ws(" / ", "tenant", "subject", "namespace"), F.lit("\n\n"))).otherwise("")
    return items.select("subject", "namespace", "id", F.concat(head, F.lit("## "), F.col("id"), F.lit("\n\n"), text.markdown_escaped(F.col("body")), F.lit("\n")).alias("value"))


def _digest(lines: DataFrame) -> dict[str, int | str]:
    """Lines, bytes, and a SHA-256 over the lines' sorted SHA-256 digests, in two levels.

    The first level is 4096 parts by the digests' first digits, so a task holds
    the digests of a 4096th of the archive; a changed, added, dropped or repeated
    line shows, the order of lines doesn't.
    """
    rows = lines.select(F.sha2("value", 256).alias("d"), F.octet_length("value").alias("n"))
    part = rows.groupBy(F.substring("d", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("d"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    row = part.agg(F.sum("k").alias("lines"), F.sum("n").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("p", "d"))), ","), 256).alias("sha256")).first()
    return {"lines": row["lines"] or 0, "bytes": row["bytes"] or 0, "sha256": row["sha256"] or ""}


def write_archive(store: MemoryStore, tenant: str, path: str, at_s: int, force: bool = False, with_audit: bool = False) -> dict[str, int | str]:
    """``memories.ndjson``, ``memories.md`` and a manifest; refuses to overwrite unless forced."""
    spark = store.spark
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(where):
        if not force:
            raise StoreError("the archive exists")
        fs.delete(where, True)
    lines = export_lines(store, tenant, at_s, with_audit=with_audit)
    write_ndjson(lines, f"{path}/memories.ndjson")
    markdown(store.read("items", tenant)).repartitionByRange("subject", "namespace", "id").sortWithinPartitions("subject", "namespace", "id").select("value").write.text(f"{path}/memories.md")
    found = _digest(spark.read.text(f"{path}/memories.ndjson"))
    spark.createDataFrame([found]).coalesce(1).write.json(f"{path}/manifest.json")
    return found


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive folder whose manifest holds, or of a bare NDJSON file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return read_ndjson(spark, path)
    held = spark.read.schema("lines long, bytes long, sha256 string").json(f"{path}/manifest.json").first().asDict()
    if held != _digest(spark.read.text(f"{path}/memories.ndjson")):
        raise StoreError("the archive does not match its manifest")
    return read_ndjson(spark, f"{path}/memories.ndjson")
