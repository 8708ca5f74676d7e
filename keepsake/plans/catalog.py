"""Name -> query and name -> DuckDB SQL for the memory-engine queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.engine import Engine
from keepsake.functions import scores, text, vectors as vec
from keepsake.operators import admission, auditing, composing, governance, maintenance, retrieval
from keepsake.plans import fixtures as fx
from keepsake.plans.fixtures import AUDIT_SQL, BUDGET_SQL, ITEMS_SQL, NOW, VECTORS_SQL
from keepsake.sources.shared import shared_path
from keepsake.sources.store import MemoryStore
from keepsake.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SCOPE = governance.SCOPE
QUERY = "the license of and version"


def query(sql: str | None = None):
    """Registers a function by its name, with its oracle if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def in_list(values: list) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- projections, filters, scalar functions -------------------------------------------------


@query(f"WITH {ITEMS_SQL} SELECT id, subject, namespace, kind, byte_size, CAST(greatest(1, ceil(strlen(body) / 4.0)) AS BIGINT) AS estimated_tokens FROM items")
def items_projection(spark, sf_dir):
    return fx.items(spark, sf_dir).select("id", "subject", "namespace", "kind", "byte_size", text.estimated_tokens(F.col("body")).alias("estimated_tokens"))


@query(f"WITH {ITEMS_SQL} SELECT id, created_at_s FROM items WHERE subject = 'src0' AND namespace = 'en' ORDER BY created_at_s, id LIMIT 20 OFFSET 3")
def scope_page(spark, sf_dir):
    rows = fx.items(spark, sf_dir).where((F.col("subject") == "src0") & (F.col("namespace") == "en"))
    return rows.orderBy("created_at_s", "id").select("id", "created_at_s").offset(3).limit(min(20, 1000))


@query(f"""WITH {ITEMS_SQL}, wanted AS (SELECT '00000000000000000000000006' AS id, subject, namespace FROM (SELECT DISTINCT subject, namespace FROM items))
SELECT w.subject, w.namespace, w.id, i.id IS NOT NULL AS found FROM wanted w LEFT JOIN items i ON w.id = i.id AND w.subject = i.subject AND w.namespace = i.namespace""")
def point_get_out_of_scope(spark, sf_dir):
    items = fx.items(spark, sf_dir)
    one = "6".zfill(26)
    hit = items.where(F.col("id") == one).select(*SCOPE, F.lit(True).alias("hit"))
    scopes = items.select(*SCOPE).distinct()
    return scopes.join(F.broadcast(hit), SCOPE, "left").select(*SCOPE, F.lit(one).alias("id"), F.coalesce("hit", F.lit(False)).alias("found"))  # one row at most


def _any_sql(markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(body), '{m}')" for m in markers) + ")"


_PARTS = "list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '')"
_TRIM = "regexp_replace(t, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')"
FLAGS_SQL = f"""
flags AS (SELECT *, ({_any_sql(text.CREDENTIAL)} OR len(list_filter({_PARTS}, lambda t: regexp_matches({_TRIM}, '^[A-Za-z0-9_-]{{20,}}$') AND regexp_matches({_TRIM}, '[0-9]') AND regexp_matches({_TRIM}, '[A-Za-z]'))) > 0) AS credential,
  {_any_sql(text.HEALTH)} AS health, {_any_sql(text.FINANCIAL)} AS financial, {_any_sql(text.LEGAL)} AS legal,
  (len(list_filter({_PARTS}, lambda t: instr(t, '@') > 1 AND contains(substr(t, instr(t, '@') + 1), '.') AND NOT suffix(t, '.'))) > 0
   OR (length(regexp_replace(body, '[^0-9]', '', 'g')) >= 10 AND regexp_matches(body, '[-()+]'))) AS pii FROM items),
levels AS (SELECT *, CASE WHEN credential THEN 4 WHEN health OR financial OR legal THEN 3 WHEN pii THEN 2 ELSE 1 END AS sensitivity,
  CASE WHEN credential THEN 0.9 WHEN health OR financial OR legal THEN 0.7 WHEN pii THEN 0.6 ELSE 0.5 END AS confidence FROM flags)"""


def leveled(items: DataFrame) -> DataFrame:
    return text.with_sensitivity(items)


@query(f"WITH {ITEMS_SQL}, {FLAGS_SQL} SELECT id, credential, health, financial, legal, pii, sensitivity, CAST(confidence AS DOUBLE) AS confidence FROM levels")
def sensitivity_scan(spark, sf_dir):
    return leveled(fx.items(spark, sf_dir)).select("id", "credential", "health", "financial", "legal", "pii", "sensitivity", text.confidence().alias("confidence"))


@query(f"WITH {ITEMS_SQL}, {FLAGS_SQL} SELECT subject, namespace, count(*) AS visible, sum(byte_size)::BIGINT AS visible_bytes FROM levels WHERE sensitivity <= 1 GROUP BY ALL")
def sensitivity_ceiling_filter(spark, sf_dir):
    rows = retrieval.hard_filters(leveled(fx.items(spark, sf_dir)), ceiling=1)
    return rows.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("visible"), F.sum("byte_size").alias("visible_bytes"))


@query(f"WITH {ITEMS_SQL} SELECT id, kind, occurred_at_s FROM items WHERE kind IN ('fact','preference') AND list_has_any(tags, ['en','src3']) AND occurred_at_s >= 1704067200 AND occurred_at_s <= 1704240000")
def tags_kind_time_filter(spark, sf_dir):
    rows = retrieval.hard_filters(fx.items(spark, sf_dir), kinds=["fact", "preference"], tags_any=["en", "src3"], after_s=1_704_067_200, before_s=1_704_240_000)
    return rows.select("id", "kind", "occurred_at_s")


STATS_SQL = """
placed AS (SELECT *, row_number() OVER (PARTITION BY subject, namespace ORDER BY byte_size, id) AS rn, count(*) OVER (PARTITION BY subject, namespace) AS n FROM items),
stats AS (SELECT subject, namespace, count(*) AS item_count, CAST(sum(byte_size) AS BIGINT) AS total_bytes, max(CASE WHEN rn = n // 2 + 1 THEN byte_size END) AS median_item_bytes FROM placed GROUP BY ALL)"""


@query(f"WITH {ITEMS_SQL}, {STATS_SQL} SELECT * FROM stats")
def scope_stats(spark, sf_dir):
    return governance.scope_stats(fx.items(spark, sf_dir))


DENSITY_SQL = """
worded AS (SELECT *, list_filter(regexp_split_to_array(lower(body), '\\s+'), lambda x: x <> '') AS words FROM items),
dense AS (SELECT *, len(words) AS n_tokens, len(list_distinct(words)) AS n_distinct, CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_distinct(words)) / len(words) END AS density FROM worded)"""


def with_density(items: DataFrame) -> DataFrame:
    df = items.withColumn("words", text.tokens(F.col("body"))).withColumns({"n_tokens": F.size("words"), "n_distinct": F.size(F.array_distinct("words"))}).drop("words")
    return df.withColumn("density", F.when(F.col("n_tokens") == 0, 0.0).otherwise(F.col("n_distinct") / F.col("n_tokens")))


@query(f"WITH {ITEMS_SQL}, {DENSITY_SQL} SELECT id, CAST(n_tokens AS INT) AS n_tokens, CAST(n_distinct AS INT) AS n_distinct, round(density, 6) AS density FROM dense")
def lexical_density(spark, sf_dir):
    return with_density(fx.items(spark, sf_dir)).select("id", "n_tokens", "n_distinct", F.round("density", 6).alias("density"))


_SPEC_SQL = "(byte_size / greatest(median_item_bytes, 50)) / (1 + byte_size / greatest(median_item_bytes, 50))"
_BASE_SQL = f"(0.8 * (0.6 * {_SPEC_SQL} + 0.4 * density) + 0.2 * CASE source_kind WHEN 'human' THEN 1.0 WHEN 'tool' THEN 0.7 ELSE 0.5 END)"
VALUE_SQL = f"valued AS (SELECT d.*, {_BASE_SQL}::DOUBLE AS base_value, CASE WHEN value_weight IS NULL THEN {_BASE_SQL} ELSE 0.25 * least(1, greatest(0, value_weight)) + 0.75 * {_BASE_SQL} END::DOUBLE AS value FROM dense d JOIN stats USING (subject, namespace))"


def valued(items: DataFrame) -> DataFrame:
    rows = with_density(items).join(governance.scope_stats(items), SCOPE)
    spec = scores.specificity(F.col("byte_size"), F.col("median_item_bytes"))
    return rows.withColumns({
        "base_value": scores.value(spec, F.col("density"), F.col("source_kind")),
        "value": scores.value(spec, F.col("density"), F.col("source_kind"), F.col("value_weight")),
    })


@query(f"WITH {ITEMS_SQL}, {STATS_SQL}, {DENSITY_SQL}, {VALUE_SQL} SELECT id, round(base_value, 6) AS value FROM valued")
def value_score(spark, sf_dir):
    return valued(fx.items(spark, sf_dir)).select("id", F.round("base_value", 6).alias("value"))


@query(f"WITH {ITEMS_SQL}, {STATS_SQL}, {DENSITY_SQL}, {VALUE_SQL} SELECT id, CAST(value_weight AS DOUBLE) AS value_weight, round(value, 6) AS value FROM valued")
def value_score_caller_weight(spark, sf_dir):
    return valued(fx.items(spark, sf_dir)).select("id", F.col("value_weight").cast("double").alias("value_weight"), F.round("value", 6).alias("value"))


# --- token overlap and consolidation ---------------------------------------------------------


@query(f"""WITH {ITEMS_SQL}, docs AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(body), '\\s+'), lambda x: x <> '')) AS tb FROM items),
bench AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS ta FROM benchmark)
SELECT lpad(CAST(item_id AS VARCHAR), 26, '0') AS a_id, id AS b_id, round(len(list_intersect(ta, tb)) / len(ta), 6) AS coverage FROM bench, docs WHERE len(ta) > 0 AND len(list_intersect(ta, tb)) / len(ta) >= 0.75
  AND lpad(CAST(item_id AS VARCHAR), 26, '0') <> id""")
def token_overlap_pairs(spark, sf_dir):
    docs = fx.items(spark, sf_dir).select("tenant", "id", text.token_set(F.col("body")).alias("tokens"))
    bench = fx.read(spark, sf_dir, "benchmark").select(F.lit(fx.TENANT).alias("tenant"), F.lpad(F.col("item_id").cast("string"), 26, "0").alias("id"), text.token_set(F.col("text")).alias("tokens"))
    return retrieval.coverage_pairs(bench, docs, ["tenant"], 0.75).select("a_id", "b_id", F.round("coverage", 6).alias("coverage"))


def consolidation_pairs(items: DataFrame) -> DataFrame:
    """Directed pairs within a scope whose absorbed side is covered to the merge threshold and evictable."""
    sets = items.select(*SCOPE, "id", text.token_set(F.col("body")).alias("tokens"))
    meta = items.select(*SCOPE, "id", "created_at_s", "protection", "protected_until_s")
    pairs = retrieval.coverage_pairs(sets, sets, SCOPE, scores.BASELINE.merge_threshold)
    a = meta.select(*SCOPE, F.col("id").alias("a_id"), F.col("created_at_s").alias("absorbed_created"), scores.evictable(F.col("protection"), F.col("protected_until_s"), NOW).alias("free"))
    b = meta.select(*SCOPE, F.col("id").alias("b_id"), F.col("created_at_s").alias("target_created"))
    return pairs.join(a, [*SCOPE, "a_id"]).join(b, [*SCOPE, "b_id"]).where("free").select(*SCOPE, F.col("a_id").alias("absorbed"), F.col("b_id").alias("target"), "coverage", "absorbed_created", "target_created")


@query(f"""WITH {ITEMS_SQL}, sets AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(body), '\\s+'), lambda x: x <> '')) AS t FROM items)
SELECT a.subject, a.namespace, a.id AS absorbed, b.id AS target, round(len(list_intersect(a.t, b.t)) / len(a.t), 6) AS coverage
FROM sets a JOIN sets b ON a.subject = b.subject AND a.namespace = b.namespace AND a.id <> b.id
WHERE len(a.t) > 0 AND len(list_intersect(a.t, b.t)) / len(a.t) >= 0.93 AND (a.protection = 'normal' OR (a.protection = 'protected' AND a.protected_until_s <= {NOW}))""")
def consolidation_candidates(spark, sf_dir):
    return consolidation_pairs(fx.items(spark, sf_dir)).select(*SCOPE, "absorbed", "target", F.round("coverage", 6).alias("coverage"))


@query()
def consolidation_greedy(spark, sf_dir):
    p = consolidation_pairs(fx.items(spark, sf_dir))
    a, b = F.struct("absorbed_created", "absorbed"), F.struct("target_created", "target")
    early = a < b
    p = p.select("*", F.when(early, F.col("absorbed_created")).otherwise(F.col("target_created")).alias("first_created"), F.when(early, F.col("absorbed")).otherwise(F.col("target")).alias("first_id"), F.when(early, F.col("target_created")).otherwise(F.col("absorbed_created")).alias("second_created"), F.when(early, F.col("target")).otherwise(F.col("absorbed")).alias("second_id"))
    return governance.greedy_consolidation(p)


# --- vectors ---------------------------------------------------------------------------------


@query(f"WITH {VECTORS_SQL} SELECT id, round(scale, 9) AS scale, array_to_string(q, ',') AS q FROM coded")
def quantize_vectors(spark, sf_dir):
    v = fx.vectors(spark, sf_dir).withColumn("scale", vec.scale(F.col("embedding")))
    v = v.withColumn("q", vec.codes(F.col("embedding"), F.col("scale")))  # not beside the rounded "scale": inside a lambda Spark takes a select's own alias
    text_q = F.array_join(F.transform("q", lambda x: x.cast("string")), ",")
    held = F.when((F.size("q") == 0) | F.exists("q", lambda x: x.isNotNull()), text_q)  # of nulls only: null
    return v.select("id", (F.round(F.col("scale") * 1e9) / 1e9).alias("scale"), held.alias("q"))  # rounded as DuckDB does, in doubles


KNN_SQL = f"""{VECTORS_SQL},
pairs AS (SELECT a.id, a.namespace, b.id AS neighbour, list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) * a.scale * b.scale AS relevance FROM coded a JOIN coded b ON a.namespace = b.namespace AND a.id <> b.id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(relevance, 9) DESC, neighbour) AS rank FROM pairs) WHERE rank <= 16)"""


def neighbours(spark, sf_dir) -> DataFrame:
    return vec.top_neighbours(fx.vectors(spark, sf_dir))


@query(f"WITH {KNN_SQL} SELECT id, neighbour, CAST(rank AS INT) AS rank, round(relevance, 6) AS relevance FROM knn")
def knn_neighbours(spark, sf_dir):
    return neighbours(spark, sf_dir).select("id", "neighbour", "rank", F.round("relevance", 6).alias("relevance"))


@query(f"""WITH {KNN_SQL}, best AS (SELECT c.id, least(1, greatest(0, coalesce(max(relevance), 0))) AS score, count(*) FILTER (relevance >= 0.3) AS n_near FROM coded c LEFT JOIN knn k ON c.id = k.id GROUP BY c.id)
SELECT id, round(score, 6) AS score, n_near, CASE WHEN score >= 0.98 THEN 'near_duplicate' WHEN score >= 0.93 THEN 'mergeable' ELSE 'novel' END AS verdict FROM best""")
def redundancy_verdict(spark, sf_dir):
    best = neighbours(spark, sf_dir).groupBy("id").agg(F.max("relevance").alias("score"), F.count_if(F.col("relevance") >= scores.BASELINE.near_duplicate_floor).alias("n_near"))
    out = fx.vectors(spark, sf_dir).select("id").join(best, "id", "left").select("id", scores.clamped(F.col("score")).alias("score"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    return out.select("id", F.round("score", 6).alias("score"), "n_near", scores.verdict(F.col("score")).alias("verdict"))


@query(f"""WITH {KNN_SQL}, dens AS (SELECT c.id, count(k.id) AS n, least(1, greatest(0, coalesce(avg(relevance) FILTER (rank <= 3), 0))) AS density, least(1, greatest(0, coalesce(avg(relevance), 0))) AS baseline FROM coded c LEFT JOIN knn k ON c.id = k.id GROUP BY c.id)
SELECT id, n AS neighbours, round(density, 6) AS density, round(baseline, 6) AS baseline, round(least(1, greatest(0, CASE WHEN n = 0 THEN 1.0 WHEN density < baseline THEN 0.5 + 0.5 * (baseline - density) / baseline WHEN density > baseline THEN 0.5 - 0.5 * (density - baseline) / (1 - baseline) ELSE 0.5 END)), 5) AS fragility FROM dens""")
def fragility(spark, sf_dir):
    near = neighbours(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("rank") <= 3, F.col("relevance"))).alias("density"), F.avg("relevance").alias("baseline"))
    out = fx.vectors(spark, sf_dir).select("id").join(near, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("neighbours"), scores.clamped(F.col("density")).alias("density"), scores.clamped(F.col("baseline")).alias("baseline"))
    return out.select("id", "neighbours", F.round("density", 6).alias("density"), F.round("baseline", 6).alias("baseline"), F.round(scores.fragility(F.col("neighbours"), F.col("density"), F.col("baseline")), 5).alias("fragility"))


@query(f"WITH {KNN_SQL} SELECT id, string_agg(neighbour, ',' ORDER BY round(relevance, 9) DESC, neighbour) AS near FROM knn WHERE relevance >= 0.3 GROUP BY id")
def near_duplicate_list(spark, sf_dir):
    near = neighbours(spark, sf_dir).where(F.col("relevance") >= scores.BASELINE.near_duplicate_floor)
    ranked = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("all"))  # 16 a group at most
    return ranked.select("id", F.array_join("all.neighbour", ",").alias("near"))


# --- retrieval -------------------------------------------------------------------------------

_TERMS = retrieval.query_terms(QUERY)
_TF = ", ".join(f"len(list_filter(words, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_TERMS))
_PART = " + ".join(f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(_TERMS)))
KEYWORD_SQL = f"""
kwords AS (SELECT *, list_filter(regexp_split_to_array(lower(body || ' ' || namespace || ' ' || subject), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM items),
ktf AS (SELECT *, len(words) AS length, {_TF} FROM kwords),
kst AS (SELECT count(*) AS n, avg(length) AS mean, {", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(_TERMS)))} FROM ktf),
kscored AS (SELECT ktf.*, {_PART} AS bm25 FROM ktf, kst WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(_TERMS)))}),
keyword AS (SELECT *, greatest(bm25, 0) / (1 + greatest(bm25, 0)) AS keyword FROM kscored)"""


@query(f"WITH {ITEMS_SQL}, {KEYWORD_SQL} SELECT id, round(bm25, 6) AS bm25, round(keyword, 6) AS keyword FROM keyword")
def keyword_bm25(spark, sf_dir):
    return retrieval.keyword_arm(fx.items(spark, sf_dir), QUERY).select("id", F.round("bm25", 6).alias("bm25"), F.round("keyword", 6).alias("keyword"))


@query(f"""WITH {ITEMS_SQL}, {KEYWORD_SQL}, {VECTORS_SQL}, probe AS (SELECT q, scale FROM coded WHERE vec_id = 0),
varm AS (SELECT c.id, list_dot_product(CAST(c.q AS DOUBLE[]), CAST(p.q AS DOUBLE[])) * c.scale * p.scale AS vector FROM coded c, probe p ORDER BY round(vector, 9) DESC, id LIMIT 640),
karm AS (SELECT id, keyword FROM keyword ORDER BY round(keyword, 9) DESC, id LIMIT 640),
fused AS (SELECT coalesce(v.id, k.id) AS id, CASE WHEN vector IS NOT NULL AND keyword IS NOT NULL THEN 0.7 * vector + 0.3 * keyword ELSE coalesce(vector, keyword) END AS relevance FROM varm v FULL JOIN karm k ON v.id = k.id)
SELECT id, round(relevance, 6) AS relevance FROM fused ORDER BY round(relevance, 9) DESC, id LIMIT 160""")
def hybrid_fusion(spark, sf_dir):
    v = fx.vectors(spark, sf_dir).withColumn("scale", vec.scale(F.col("embedding"))).select("vec_id", "id", "scale", vec.codes(F.col("embedding"), F.col("scale")).alias("q"))
    probe = v.where("vec_id = 0").select("q", "scale").first()  # the query's own vector
    pq, ps = F.array(*[F.lit(x) for x in probe["q"]]), F.lit(probe["scale"])
    arm = v.select("id", F.round(vec.dot(F.col("q"), pq) * F.col("scale") * ps, 9).alias("vector"))
    words = retrieval.keyword_arm(fx.items(spark, sf_dir), QUERY).select("id", F.round("keyword", 9).alias("keyword"))
    out = retrieval.fuse(arm, words, retrieval.engine_limit(20))
    return out.select("id", F.round("relevance", 6).alias("relevance"))


SEARCH_SQL = f"""{ITEMS_SQL}, {FLAGS_SQL}, {KEYWORD_SQL},
cand AS (SELECT l.subject, l.namespace, l.id, round(k.keyword, 9) AS relevance, CAST(greatest(1, ceil(strlen(l.body) / 4.0)) AS BIGINT) AS estimated_tokens FROM levels l JOIN keyword k ON l.id = k.id WHERE l.sensitivity <= 1 AND l.kind IN ('fact','preference','event')),
walk AS (SELECT *, row_number() OVER w AS rank, sum(estimated_tokens) OVER w AS used FROM cand WINDOW w AS (PARTITION BY subject, namespace ORDER BY relevance DESC, id ROWS UNBOUNDED PRECEDING))"""


def searched(spark, sf_dir) -> DataFrame:
    items = leveled(fx.items(spark, sf_dir))
    keep = ["sensitivity", "kind", "subject", "namespace", "estimated_tokens"]
    arm = retrieval.keyword_arm(items.withColumn("estimated_tokens", text.estimated_tokens(F.col("body"))), QUERY, keep)
    rows = retrieval.hard_filters(arm, ceiling=1, kinds=["fact", "preference", "event"]).withColumn("relevance", F.round("keyword", 9))
    return retrieval.search_prefix(rows, SCOPE)


@query(f"WITH {SEARCH_SQL} SELECT subject, namespace, id, CAST(rank AS INT) AS rank, round(relevance, 6) AS relevance, estimated_tokens FROM walk WHERE used <= 2000 AND rank <= 20")
def search_mode_budget(spark, sf_dir):
    return searched(spark, sf_dir).where("selected").select(*SCOPE, "id", "rank", F.round("relevance", 6).alias("relevance"), "estimated_tokens")


@query(f"""WITH {SEARCH_SQL}, rest AS (SELECT *, row_number() OVER (PARTITION BY subject, namespace ORDER BY rank) AS place, count(*) OVER (PARTITION BY subject, namespace) AS omitted_total FROM walk WHERE NOT (used <= 2000 AND rank <= 20))
SELECT subject, namespace, id, CAST(place AS INT) AS place, omitted_total FROM rest WHERE place <= 50""")
def omitted_sample(spark, sf_dir):
    by = Window.partitionBy(*SCOPE)
    rest = searched(spark, sf_dir).where(~F.col("selected")).withColumn("place", F.row_number().over(by.orderBy("rank"))).withColumn("omitted_total", F.count(F.lit(1)).over(by))
    return rest.where("place <= 50").select(*SCOPE, "id", "place", "omitted_total")


ACCESS_SQL = f"{AUDIT_SQL}, access AS (SELECT item_id, count(*) AS access_count, max(at_s) AS last_access_s FROM audit WHERE event = 'recalled' GROUP BY item_id)"


@query(f"""WITH {ITEMS_SQL}, {ACCESS_SQL} SELECT id, CAST(last_access_s AS DOUBLE) AS last_access_s, (doc_id % 101 >= 80 OR ({NOW} - coalesce(last_access_s, created_at_s) >= 2592000 AND doc_id % 101 >= 50)) AS due FROM items LEFT JOIN access ON id = item_id""")
def replay_due(spark, sf_dir):
    items = fx.items(spark, sf_dir)
    rows = items.join(auditing.access_stats(fx.audit(spark, sf_dir)), F.col("id") == F.col("item_id"), "left")
    fragile = (F.col("doc_id") % 101) / 100
    return rows.select("id", F.col("last_access_s").cast("double").alias("last_access_s"), scores.replay_due(fragile, F.col("last_access_s"), F.col("created_at_s"), NOW).alias("due"))


# --- capacity and maintenance ----------------------------------------------------------------

USED_SQL = f"used AS (SELECT subject, namespace, count(*) AS used_items, CAST(sum(byte_size) AS BIGINT) AS used_bytes, {BUDGET_SQL} FROM items GROUP BY subject, namespace)"
_OVER = "coalesce({i} > max_items, false) OR coalesce({b} > max_bytes, false)"


def capacity(items: DataFrame) -> DataFrame:
    state = governance.used(items)
    return state.join(fx.budgets(state.select(*SCOPE)), SCOPE)


@query(f"""WITH {ITEMS_SQL}, {USED_SQL} SELECT subject, namespace, used_items, used_bytes, CAST(max_items AS DOUBLE) AS max_items, CAST(max_bytes AS DOUBLE) AS max_bytes, round(greatest(coalesce(CASE WHEN max_items = 0 THEN 1.0 ELSE least(1, used_items / max_items) END, 0), coalesce(CASE WHEN max_bytes = 0 THEN 1.0 ELSE least(1, used_bytes / max_bytes) END, 0)), 6) AS pressure,
({_OVER.format(i="used_items + 1", b="used_bytes + 1000")}) AS would_exceed FROM used""")
def capacity_state(spark, sf_dir):
    c = capacity(fx.items(spark, sf_dir))
    both = F.greatest(F.coalesce(scores.pressure(F.col("used_items"), F.col("max_items")), F.lit(0.0)), F.coalesce(scores.pressure(F.col("used_bytes"), F.col("max_bytes")), F.lit(0.0)))
    return c.withColumn("pressure", F.round(both, 6)).withColumn("would_exceed", scores.would_exceed(F.col("used_items"), F.col("used_bytes"), F.col("max_items"), F.col("max_bytes"), 1, 1000)).withColumns({c: F.col(c).cast("double") for c in ("max_items", "max_bytes")})


_FREE_SQL = f"(protection = 'normal' OR (protection = 'protected' AND protected_until_s <= {NOW}))"


@query(f"""WITH {ITEMS_SQL}, {USED_SQL},
page AS (SELECT *, row_number() OVER (PARTITION BY subject, namespace ORDER BY created_at_s, id) AS pos FROM items),
ranked AS (SELECT p.id, p.byte_size, u.*, row_number() OVER w AS place, coalesce(sum(byte_size) OVER (PARTITION BY subject, namespace ORDER BY created_at_s, p.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed
  FROM page p JOIN used u USING (subject, namespace) WHERE pos <= 128 AND {_FREE_SQL} AND (max_items IS NOT NULL OR max_bytes IS NOT NULL) WINDOW w AS (PARTITION BY subject, namespace ORDER BY created_at_s, p.id))
SELECT subject, namespace, id, CAST(place AS INT) AS place FROM ranked WHERE {_OVER.format(i="greatest(used_items - (place - 1), 0) + 1", b="greatest(used_bytes - freed, 0) + 1000")}""")
def admission_evictions(spark, sf_dir):
    """What a new item of 1000 bytes evicts in each bounded scope: the oldest evictable of the first 128 (all cost the same)."""
    items = fx.items(spark, sf_dir)
    page = items.withColumn("at", F.row_number().over(Window.partitionBy(*SCOPE).orderBy("created_at_s", "id"))).where(F.col("at") <= governance.EVICTION_CANDIDATES)
    free = page.where(scores.evictable(F.col("protection"), F.col("protected_until_s"), NOW))
    bounded = capacity(items).where("max_items is not null or max_bytes is not null")
    ranked = free.join(bounded, SCOPE)
    return governance.prefix_evictions(ranked, ["created_at_s", "id"], 1, 1000).where("evicted").select(*SCOPE, "id", "place")


_EXPIRED_SQL = f"(ttl_seconds IS NOT NULL AND created_at_s + ttl_seconds <= {NOW})"


@query(f"""WITH {ITEMS_SQL}, {USED_SQL},
after_expiry AS (SELECT u.subject, u.namespace, max_items, max_bytes, used_items - coalesce(n, 0) AS used_items, used_bytes - coalesce(b, 0) AS used_bytes FROM used u LEFT JOIN (SELECT subject, namespace, count(*) AS n, sum(byte_size) AS b FROM items WHERE {_EXPIRED_SQL} GROUP BY ALL) e ON u.subject = e.subject AND u.namespace = e.namespace),
ranked AS (SELECT i.id, i.byte_size, a.*, row_number() OVER (PARTITION BY subject, namespace ORDER BY created_at_s, i.id) AS place, coalesce(sum(byte_size) OVER (PARTITION BY subject, namespace ORDER BY created_at_s, i.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed
  FROM items i JOIN after_expiry a USING (subject, namespace) WHERE {_FREE_SQL} AND NOT {_EXPIRED_SQL})
SELECT subject, namespace, id, CAST(place AS INT) AS place FROM ranked WHERE {_OVER.format(i="greatest(used_items - (place - 1), 0)", b="greatest(used_bytes - freed, 0)")}""")
def capacity_reclaim(spark, sf_dir):
    items = fx.items(spark, sf_dir).withColumn("gone", scores.expired(F.col("created_at_s"), F.col("ttl_seconds"), NOW))
    state = items.groupBy(*SCOPE).agg(F.count_if(~F.col("gone")).alias("used_items"), F.sum(F.when(~F.col("gone"), F.col("byte_size")).otherwise(0)).alias("used_bytes"))
    state = state.join(fx.budgets(state.select(*SCOPE)), SCOPE)
    free = items.where(~F.col("gone") & scores.evictable(F.col("protection"), F.col("protected_until_s"), NOW))
    return governance.prefix_evictions(free.join(state, SCOPE), ["created_at_s", "id"], 0, 0).where("evicted").select(*SCOPE, "id", "place")


@query(f"WITH {ITEMS_SQL} SELECT subject, namespace, id, ({NOW} - created_at_s) // 86400 AS age_days, byte_size FROM items WHERE {_EXPIRED_SQL}")
def ttl_expiry(spark, sf_dir):
    rows = fx.items(spark, sf_dir).where(scores.expired(F.col("created_at_s"), F.col("ttl_seconds"), NOW))
    return rows.select(*SCOPE, "id", F.floor((NOW - F.col("created_at_s")) / fx.DAY).cast("long").alias("age_days"), "byte_size")


@query(f"WITH {ITEMS_SQL} SELECT subject, namespace, id, protected_until_s FROM items WHERE protection = 'protected' AND protected_until_s <= {NOW} AND NOT {_EXPIRED_SQL}")
def protection_release(spark, sf_dir):
    rows = fx.items(spark, sf_dir).where((F.col("protection") == "protected") & (F.col("protected_until_s") <= NOW) & ~scores.expired(F.col("created_at_s"), F.col("ttl_seconds"), NOW))
    return rows.select(*SCOPE, "id", "protected_until_s")


# --- audit -----------------------------------------------------------------------------------

_SINCE, _UNTIL = 1_704_153_600, 1_706_000_000


@query(f"WITH {AUDIT_SQL} SELECT id, at_s, event FROM audit WHERE event IN ('admitted','rejected') AND at_s >= {_SINCE} AND at_s <= {_UNTIL} AND id < '{'9' * 26}' ORDER BY id DESC LIMIT 100")
def audit_filter_page(spark, sf_dir):
    rows = auditing.filtered(fx.audit(spark, sf_dir), ["admitted", "rejected"], since_s=_SINCE, until_s=_UNTIL, after="9" * 26)
    return auditing.page(rows).select("id", "at_s", "event")


@query(f"WITH {AUDIT_SQL} SELECT id, at_s, event, item_id FROM audit WHERE item_id = '{'42'.zfill(26)}'")
def audit_item_contains(spark, sf_dir):
    return auditing.filtered(fx.audit(spark, sf_dir), item="42".zfill(26)).select("id", "at_s", "event", "item_id")


_HIST = lambda c: "concat_ws(',', " + ", ".join(f"count(*) FILTER (least(9, {c}_pct // 10) = {i})" for i in range(10)) + f") AS {c}_histogram"
AGGREGATES_SQL = f"{AUDIT_SQL}, aggregates AS (SELECT day, policy_name, policy_version, event, count(*) AS \"count\", {_HIST('value')}, {_HIST('fragility')} FROM audit GROUP BY day, policy_name, policy_version, event)"


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("value_histogram", "fragility_histogram")})


@query(f"WITH {AGGREGATES_SQL} SELECT * FROM aggregates")
def audit_aggregates(spark, sf_dir):
    return _joined(auditing.aggregates(fx.audit(spark, sf_dir)))


@query(f"""WITH {AGGREGATES_SQL} SELECT day, policy_name, policy_version, event, "count" FROM aggregates WHERE (day, policy_name IS NOT NULL, coalesce(policy_name, ''), coalesce(policy_version, ''), event) > (19730, true, 'baseline', '0.1.0', 'admitted')""")
def audit_aggregate_cursor(spark, sf_dir):
    return auditing.aggregates(fx.audit(spark, sf_dir)).where(auditing.after_cursor(19_730, "baseline", "0.1.0", "admitted")).select(*auditing.KEY, "count")


@query(f"WITH {AUDIT_SQL} SELECT item_id, id AS audit_id, event FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY id DESC) AS rn FROM audit WHERE policy_name IS NOT NULL) WHERE rn = 1")
def latest_reason_per_item(spark, sf_dir):
    return auditing.latest_reason(fx.audit(spark, sf_dir))


@query(f"WITH {ACCESS_SQL} SELECT * FROM access")
def access_stats(spark, sf_dir):
    return auditing.access_stats(fx.audit(spark, sf_dir))


@query(f"WITH {AUDIT_SQL} SELECT day, event, count(*) AS kept FROM audit WHERE at_s >= {NOW} - 20 * 86400 GROUP BY day, event")
def retention_filter(spark, sf_dir):
    """Detail rows inside a profile's span (20 days); daily aggregates outlive them."""
    return auditing.retained(fx.audit(spark, sf_dir), NOW, 20).groupBy("day", "event").agg(F.count(F.lit(1)).alias("kept"))


# --- mutations, portability ------------------------------------------------------------------


@query(f"""WITH {ITEMS_SQL}, firsts AS (SELECT subject, namespace, arg_min(id, (created_at_s, id)) AS target_id FROM items GROUP BY ALL)
SELECT t.id, n.id AS new_id, array_to_string(list_concat(t.tags, list_filter(n.tags, lambda x: NOT list_contains(t.tags, x))), ',') AS tags, n.source_kind, CAST(coalesce(n.value_weight, t.value_weight) AS DOUBLE) AS value_weight, md5(n.body) AS body_digest
FROM items n JOIN firsts f ON n.subject = f.subject JOIN items t ON t.id = f.target_id WHERE n.id <> t.id AND n.namespace <> t.namespace""")
def merge_tags_attrs(spark, sf_dir):
    """Every item merged into the oldest item of each other namespace of its subject, one row per pair."""
    items = fx.items(spark, sf_dir)
    firsts = items.groupBy(*SCOPE).agg(F.min(F.struct("created_at_s", "id"))["id"].alias("target_id")).select("subject", F.col("namespace").alias("target_namespace"), "target_id")
    new = items.join(firsts, "subject").where("namespace <> target_namespace").select("target_id", "tags", "source_kind", "value_weight", "id", "body")
    out = governance.merged(items, new)
    return out.select("id", "new_id", F.array_join("tags", ",").alias("tags"), "source_kind", F.col("value_weight").cast("double").alias("value_weight"), F.md5("body").alias("body_digest"))


@query("""WITH w AS (SELECT CAST(conv_id AS VARCHAR) AS subject, role AS namespace, conv_id || '-' || turn AS key, 0 AS delivery, text AS body FROM conversations
  UNION ALL SELECT CAST(conv_id AS VARCHAR), role, conv_id || '-' || turn, 1, CASE WHEN role = 'user' THEN text ELSE text || '!' END FROM conversations),
seen AS (SELECT *, row_number() OVER k AS n, first_value(md5(body)) OVER k AS first_digest FROM w WINDOW k AS (PARTITION BY subject, namespace, key ORDER BY delivery, md5(body)))
SELECT subject, namespace, key, delivery, CASE WHEN n = 1 THEN 'new' WHEN md5(body) = first_digest THEN 'replayed' ELSE 'conflict' END AS outcome FROM seen""")
def idempotency_replay(spark, sf_dir):
    """Every write delivered twice, the second time with another body unless the user wrote it."""
    first = fx.writes(spark, sf_dir).withColumn("delivery", F.lit(0))
    again = first.withColumn("delivery", F.lit(1)).withColumn("body", F.when(F.col("namespace") == "user", F.col("body")).otherwise(F.concat("body", F.lit("!"))))
    rows = governance.idempotent(first.unionByName(again).withColumn("_order", F.struct("delivery", F.md5("body"))), "_order")
    return rows.select("subject", "namespace", "key", "delivery", "outcome")


@query(f"""WITH {ITEMS_SQL} SELECT subject = 'src3' AS purged, count(*) AS items, CAST(sum(byte_size) AS BIGINT) AS bytes, count(e.vec_id) AS vectors FROM items LEFT JOIN embeddings e ON doc_id = e.vec_id GROUP BY ALL""")
def purge_subject_report(spark, sf_dir):
    """What purging one subject removes, and what stays."""
    items = fx.items(spark, sf_dir).join(fx.vectors(spark, sf_dir).select("vec_id"), F.col("doc_id") == F.col("vec_id"), "left")
    return items.groupBy((F.col("subject") == "src3").alias("purged")).agg(F.count(F.lit(1)).alias("items"), F.sum("byte_size").alias("bytes"), F.count("vec_id").alias("vectors"))


@query(f"WITH {ITEMS_SQL} SELECT subject, namespace, id FROM items WHERE list_contains(tags, 'fr')")
def forget_by_tag(spark, sf_dir):
    return fx.items(spark, sf_dir).where(F.array_contains("tags", "fr")).select(*SCOPE, "id")


@query(f"""WITH {ITEMS_SQL}, {AUDIT_SQL}, stream AS (SELECT 0 AS kind_rank, 'header' AS record, '' AS id, NULL AS embedder UNION ALL SELECT 1, 'item', i.id, CASE WHEN e.vec_id IS NOT NULL THEN 'fixture-64' END FROM items i LEFT JOIN embeddings e ON i.doc_id = e.vec_id UNION ALL SELECT 2, 'audit', id, NULL FROM audit)
SELECT * FROM stream ORDER BY kind_rank, id""")
def export_stream_order(spark, sf_dir):
    items = fx.items(spark, sf_dir).join(fx.vectors(spark, sf_dir).select("vec_id", "embedder"), F.col("doc_id") == F.col("vec_id"), "left")
    head = spark.range(1).select(F.lit(0).alias("kind_rank"), F.lit("header").alias("record"), F.lit("").alias("id"), F.lit(None).cast("string").alias("embedder"))
    body = items.select(F.lit(1).alias("kind_rank"), F.lit("item").alias("record"), "id", "embedder")
    tail = fx.audit(spark, sf_dir).select(F.lit(2).alias("kind_rank"), F.lit("audit").alias("record"), "id", F.lit(None).cast("string").alias("embedder"))
    return head.unionByName(body).unionByName(tail).orderBy("kind_rank", "id")


@query(f"WITH {ITEMS_SQL} SELECT subject, namespace, count(*) AS imported, CAST(sum(byte_size) AS BIGINT) AS imported_bytes FROM items WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL")
def import_skip_existing(spark, sf_dir):
    """All documents imported into a store that holds the labelled ones."""
    held = fx.read(spark, sf_dir, "labels").select("doc_id")
    return fx.items(spark, sf_dir).join(held, "doc_id", "left_anti").groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("imported"), F.sum("byte_size").alias("imported_bytes"))


@query(f"""WITH {ITEMS_SQL}, {FLAGS_SQL} SELECT id, greatest(CAST(doc_id % 5 AS INT), sensitivity) AS sensitivity, CASE WHEN protection = 'pinned' THEN 'normal' ELSE protection END AS protection, CASE WHEN protection = 'protected' THEN CAST(least(protected_until_s, 1706000000 + 2592000) AS DOUBLE) END AS protected_until_s FROM levels""")
def import_hardening(spark, sf_dir):
    """Imported rows: sensitivity raised to what is detected, pins dropped, protection clamped to the window."""
    at = 1_706_000_000
    rows = leveled(fx.items(spark, sf_dir))
    return rows.select(
        "id", text.raised(F.col("sensitivity"), (F.col("doc_id") % 5).cast("int")).alias("sensitivity"), F.when(F.col("protection") == "pinned", "normal").otherwise(F.col("protection")).alias("protection"),
        F.when(F.col("protection") == "protected", F.least(F.col("protected_until_s"), F.lit(at + 30 * fx.DAY))).cast("double").alias("protected_until_s"),
    )


@query(f"""WITH {ITEMS_SQL} SELECT id, row_number() OVER (PARTITION BY subject, namespace ORDER BY id) = 1 AS heading, md5(regexp_replace(body, '(?m)^(\\s*)#', '\\1\\\\#', 'g')) AS body_digest FROM items""")
def markdown_headings(spark, sf_dir):
    """A scope heading stands before a scope's first item in (scope, id) order."""
    items = fx.items(spark, sf_dir)
    first = items.groupBy(*SCOPE).agg(F.min("id").alias("first_id"))
    rows = items.join(first, SCOPE)
    return rows.select("id", (F.col("id") == F.col("first_id")).alias("heading"), F.md5(text.markdown_escaped(F.col("body"))).alias("body_digest"))


# --- sequential and streaming ----------------------------------------------------------------


@query()
def working_set_mmr(spark, sf_dir):
    """One request per scope over its best candidates (the engine's limit of 160)."""
    items = fx.items(spark, sf_dir).withColumn("estimated_tokens", text.estimated_tokens(F.col("body")))
    arm = retrieval.keyword_arm(items, QUERY, SCOPE).withColumn("relevance", F.round("keyword", 9))
    best = arm.withColumn("rank", F.row_number().over(Window.partitionBy(*SCOPE).orderBy(F.desc("relevance"), "id"))).where(F.col("rank") <= retrieval.engine_limit(20))
    due = scores.replay_due((F.col("doc_id") % 101) / 100, F.lit(None).cast("long"), F.col("created_at_s"), NOW)
    rows = best.join(items.select("id", "body", "estimated_tokens", due.alias("due")), "id").select(*SCOPE, "id", "body", "relevance", "estimated_tokens", "due")
    return composing.compose(rows, SCOPE)


def admitted(spark, sf_dir, cfg: scores.Config) -> DataFrame:
    w = fx.writes(spark, sf_dir)
    size = F.octet_length("body") + F.octet_length("subject") + F.octet_length("namespace") + 64 + 2 + 4
    rows = w.select(*SCOPE, F.col("turn").cast("long").alias("seq"), "body", (F.lit(NOW) + F.col("turn")).alias("at_s"), size.alias("size"), F.lit(None).cast("string").alias("hint"), F.lit(fx.MAX_ITEMS).alias("max_items"), F.lit(None).cast("long").alias("max_bytes"))
    return admission.fold(rows, SCOPE, cfg)


@query()
def remember_fold(spark, sf_dir):
    return admitted(spark, sf_dir, scores.BASELINE)


@query("""WITH w AS (SELECT CAST(conv_id AS VARCHAR) AS subject, role AS namespace, conv_id || '-' || turn AS key, 0 AS delivery, turn, text AS body FROM conversations
  UNION ALL SELECT CAST(conv_id AS VARCHAR), role, conv_id || '-' || turn, 1, turn, CASE WHEN role = 'user' THEN text ELSE text || '!' END FROM conversations),
seen AS (SELECT *, row_number() OVER k AS n, first_value(body) OVER k AS first_body FROM w WINDOW k AS (PARTITION BY subject, namespace, key ORDER BY delivery, body))
SELECT subject, namespace, key, delivery, CASE WHEN n = 1 THEN 'new' WHEN body = first_body THEN 'replayed' ELSE 'conflict' END AS outcome FROM seen""")
def remember_replayed(spark, sf_dir):
    """All turns remembered in a new store, then delivered again (in another body unless the user wrote them)."""
    engine = Engine(MemoryStore(spark, shared_path(spark, "store")), fx.TENANT)
    first = fx.writes(spark, sf_dir).withColumns({"seq": F.col("turn").cast("long"), "at_s": F.lit(NOW) + F.col("turn")})
    again = first.withColumn("body", F.when(F.col("namespace") == "user", F.col("body")).otherwise(F.concat("body", F.lit("!"))))
    told = [engine.remember(w).select("subject", "namespace", "key", F.lit(n).alias("delivery"), "outcome") for n, w in enumerate((first, again))]
    return told[0].unionByName(told[1])


@query()
def shadow_diff(spark, sf_dir):
    """How the decisions change under a policy that merges and rejects sooner."""
    sooner = scores.Config(duplicate_threshold=0.80, merge_threshold=0.60).validate()
    return admission.diff(admitted(spark, sf_dir, scores.BASELINE), admitted(spark, sf_dir, sooner), SCOPE)


@query()
def maintenance_run(spark, sf_dir):
    """All five phases over every scope, in pages of 200."""
    items = fx.items(spark, sf_dir)
    return maintenance.run(items, capacity(items), SCOPE, NOW)


@query("SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_day_aggregates(spark, sf_dir):
    return streams.drain(streams.day_counts(streams.events(spark, f"{sf_dir}/events.parquet")), "complete", "days")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe_keys(spark, sf_dir):
    return streams.drain(streams.first_keys(streams.events(spark, f"{sf_dir}/events.parquet"), ["user_id", "event_type"]), "append", "keys")


@query("""WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM marked)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM numbered GROUP BY user_id, session""")
def stream_session_activity(spark, sf_dir):
    return streams.drain(streams.sessions(streams.events(spark, f"{sf_dir}/events.parquet")), "complete", "sessions")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
