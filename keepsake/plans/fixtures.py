"""Projections of the driver's tables onto the engine's data model.

``items`` come from documents (and labels), ``vectors`` from embeddings, ``audit``
from events, ``writes`` from conversations. Each has the same text in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-02-01T00:00:00Z, the clock of all queries.
NOW = 1_706_745_600
DAY = 86_400
TENANT = "acme"
# The order in which ids are dealt over kinds and source kinds.
KINDS = ["fact", "preference", "event", "procedure", "entity"]
SOURCE_KINDS = ["agent", "session", "tool", "human"]
EVENTS = {"view": "recalled", "signup": "admitted", "error": "rejected", "click": "merged", "purchase": "forgotten"}
#: Events that carry a policy and an assessment.
DECIDED = ["admitted", "rejected", "merged"]
MAX_ITEMS, MAX_BYTES = 5, 20_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Whole seconds since 1970 in UTC, whatever the session's zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {name})")
    return F.unix_timestamp(name)


def _pick(values: list[str], by: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(by) % len(values) + 1).cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("value_weight"))
    df = docs.join(labels, "doc_id", "left")
    created = F.lit(1_704_067_200) + (F.col("doc_id") % 97) * 3600
    df = df.select(
        "doc_id", F.lpad(F.col("doc_id").cast("string"), 26, "0").alias("id"), F.lit(TENANT).alias("tenant"), F.col("source").alias("subject"), F.col("lang").alias("namespace"),
        F.col("text").alias("body"), _pick(KINDS, "doc_id").alias("kind"), _pick(SOURCE_KINDS, "doc_id").alias("source_kind"), created.alias("created_at_s"),
        F.when(F.col("doc_id") % 3 != 0, created - DAY).alias("occurred_at_s"), F.array("lang", "source").alias("tags"), "value_weight",
        F.when(F.col("doc_id") % 7 == 0, F.lit(30 * DAY)).alias("ttl_seconds"),
        F.when(F.col("doc_id") % 11 == 0, "pinned").when(F.col("doc_id") % 11 == 1, "protected").otherwise("normal").alias("protection"),
        F.when(F.col("doc_id") % 11 == 1, created + 30 * DAY).alias("protected_until_s"),
    )
    # compact JSON with sorted keys: what the storage charge counts
    attrs = F.concat(F.lit('{"source_kind":"'), F.col("source_kind"), F.when(F.col("value_weight").isNull(), F.lit('"}')).otherwise(F.concat(F.lit('","value_weight":'), F.col("value_weight").cast("string"), F.lit("}"))))
    size = F.octet_length("body") + F.octet_length("kind") + F.octet_length("attrs") + 2 * (F.octet_length("subject") + F.octet_length("namespace")) + 64
    return df.withColumn("attrs", attrs).withColumn("byte_size", size.cast("long"))


ITEMS_SQL = """
raw_items AS (
  SELECT d.doc_id, lpad(CAST(d.doc_id AS VARCHAR), 26, '0') AS id, 'acme' AS tenant, source AS subject, lang AS namespace, text AS body,
    ['fact','preference','event','procedure','entity'][CAST(d.doc_id % 5 AS INT) + 1] AS kind,
    ['agent','session','tool','human'][CAST(d.doc_id % 4 AS INT) + 1] AS source_kind,
    1704067200 + (d.doc_id % 97) * 3600 AS created_at_s,
    CASE WHEN d.doc_id % 3 <> 0 THEN 1704067200 + (d.doc_id % 97) * 3600 - 86400 END AS occurred_at_s,
    [lang, source] AS tags, l.quality AS value_weight,
    CASE WHEN d.doc_id % 7 = 0 THEN 2592000 END AS ttl_seconds,
    CASE d.doc_id % 11 WHEN 0 THEN 'pinned' WHEN 1 THEN 'protected' ELSE 'normal' END AS protection,
    CASE WHEN d.doc_id % 11 = 1 THEN 1704067200 + (d.doc_id % 97) * 3600 + 2592000 END AS protected_until_s
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
items AS (
  SELECT *, '{"source_kind":"' || source_kind || CASE WHEN value_weight IS NULL THEN '"}' ELSE '","value_weight":' || value_weight || '}' END AS attrs,
    CAST(strlen(body) + strlen(kind) + strlen('{"source_kind":"' || source_kind || CASE WHEN value_weight IS NULL THEN '"}' ELSE '","value_weight":' || value_weight || '}' END)
      + 2 * (strlen(source_subject(subject)) + strlen(namespace)) + 64 AS BIGINT) AS byte_size
  FROM raw_items)""".replace("source_subject(subject)", "subject")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", F.lpad(F.col("vec_id").cast("string"), 26, "0").alias("id"), F.lit(TENANT).alias("tenant"), F.col("label").cast("string").alias("namespace"),
        F.lit("fixture-64").alias("embedder"), F.size("embedding").alias("dim"), "embedding",
    )


#: int8 codes of every vector: half away from zero, scale = largest magnitude / 127 (1 for a zero vector).
VECTORS_SQL = """
scaled AS (
  SELECT vec_id, lpad(CAST(vec_id AS VARCHAR), 26, '0') AS id, CAST(label AS VARCHAR) AS namespace, embedding,
    coalesce(nullif(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / 127, 0), 1) AS scale
  FROM embeddings),
coded AS (
  SELECT vec_id, id, namespace, scale, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) / scale) AS INT)) AS q FROM scaled)"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "events")
    names = F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair])
    df = raw.select(
        "event_id", F.lpad(F.col("event_id").cast("string"), 26, "0").alias("id"), epoch_seconds(raw, "ts").cast("long").alias("at_s"), F.col("user_id").alias("subject"),
        names[F.col("event_type")].alias("event"), F.lpad(F.get_json_object("props", "$.k"), 26, "0").alias("item_id"), F.col("value").alias("raw_value"),
    )
    decided = F.col("event").isin(DECIDED)
    hundredths = F.when(decided, F.pmod(F.floor(F.col("raw_value") * 100).cast("long"), F.lit(101)))
    return df.select(
        "event_id", "id", "at_s", F.floor(F.col("at_s") / DAY).cast("long").alias("day"), "subject", "event", "item_id", F.array("item_id").alias("items"),
        F.when(decided, "baseline").alias("policy_name"), F.when(decided, "0.1.0").alias("policy_version"), hundredths.alias("value_pct"), F.when(decided, F.col("event_id") % 101).alias("fragility_pct"),
    )


AUDIT_SQL = """
audit AS (
  SELECT event_id, id, at_s, CAST(floor(at_s / 86400) AS BIGINT) AS day, subject, event, item_id,
    CASE WHEN event IN ('admitted','rejected','merged') THEN 'baseline' END AS policy_name,
    CASE WHEN event IN ('admitted','rejected','merged') THEN '0.1.0' END AS policy_version,
    CASE WHEN event IN ('admitted','rejected','merged') THEN ((CAST(floor(value * 100) AS BIGINT) % 101) + 101) % 101 END AS value_pct,
    CASE WHEN event IN ('admitted','rejected','merged') THEN event_id % 101 END AS fragility_pct
  FROM (SELECT event_id, lpad(CAST(event_id AS VARCHAR), 26, '0') AS id, CAST(floor(epoch(ts)) AS BIGINT) AS at_s, user_id AS subject, value,
      CASE event_type WHEN 'view' THEN 'recalled' WHEN 'signup' THEN 'admitted' WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'merged' WHEN 'purchase' THEN 'forgotten' END AS event,
      lpad(json_extract_string(props, '$.k'), 26, '0') AS item_id FROM events))"""


def budgets(scopes: DataFrame) -> DataFrame:
    """max_items, max_bytes of each (subject, namespace): src0 unbounded, src1 by bytes, the others by items."""
    return scopes.select(
        "subject", "namespace", F.when(~F.col("subject").isin("src0", "src1"), F.lit(MAX_ITEMS)).alias("max_items"), F.when(F.col("subject") == "src1", F.lit(MAX_BYTES)).alias("max_bytes")
    )


BUDGET_SQL = "CASE WHEN subject NOT IN ('src0','src1') THEN 5 END AS max_items, CASE WHEN subject = 'src1' THEN 20000 END AS max_bytes"


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(
        F.lit(TENANT).alias("tenant"), F.col("conv_id").cast("string").alias("subject"), F.col("role").alias("namespace"), "turn", F.col("text").alias("body"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"),
    )
