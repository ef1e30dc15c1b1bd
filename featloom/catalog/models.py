"""Scoring, model lookup, traffic split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featloom.catalog.base import SQL_LOG, Tables, query
from featloom.plans import models as M

WEIGHTS = {"l_quantity": 0.5, "l_discount": -2.0, "l_tax": 4.0}


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, ((1.25e0 + l_quantity * 0.5e0) + l_discount * -2.0e0) + l_tax * 4.0e0 AS prediction,
'linear' AS model_name, '3' AS model_version, CAST(NULL AS VARCHAR) AS error FROM lineitem""")
def batch_score(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", *WEIGHTS)
    scored = M.score(rows, M.linear_model(WEIGHTS, 1.25), list(WEIGHTS), "linear", "3")
    return scored.drop("latency_ms", *WEIGHTS)


def model_registry(t: Tables) -> DataFrame:
    """Parts as model versions: the brand is the model, the part key its version."""
    stage = F.element_at(F.array(F.lit("None"), F.lit("Staging"), F.lit("Production"), F.lit("Archived")),
                         (F.col("p_size") % 4 + 1).cast("int"))
    return t.raw("part").select(F.col("p_brand").alias("name"), F.col("p_partkey").cast("int").alias("version"),
                                stage.alias("stage"), F.col("p_name").alias("description"),
                                F.concat(F.lit("run-"), F.col("p_partkey")).alias("run_id"))


SQL_MODELS = """(SELECT p_brand AS name, CAST(p_partkey AS INTEGER) AS version,
  (['None', 'Staging', 'Production', 'Archived'])[CAST(p_size % 4 + 1 AS INTEGER)] AS stage, 'run-' || p_partkey AS run_id FROM part)"""


@query(f"SELECT name, stage, MAX(version) AS version, 'run-' || MAX(version) AS run_id FROM {SQL_MODELS} GROUP BY 1, 2")
def latest_model_versions(t: Tables) -> DataFrame:
    return M.latest_versions(model_registry(t)).select("name", "stage", "version", "run_id")


def model_requests(t: Tables) -> DataFrame:
    """Orders asking for a model by stage (any case), by number, or by a word that is no stage."""
    k = F.col("o_orderkey")
    wanted = (F.when(k % 5 == 0, "production").when(k % 5 == 1, "STAGING")
              .when(k % 5 == 2, (k % 300).cast("string")).when(k % 5 == 3, "Archived").otherwise("canary"))
    return t.raw("orders").select(k.alias("request_id"), F.concat(F.lit("Brand#"), F.col("o_custkey") % 30).alias("model_name"),
                                  wanted.alias("version_or_stage"))


@query(f"""WITH r AS (SELECT o_orderkey AS request_id, 'Brand#' || (o_custkey % 30) AS model_name,
 CASE o_orderkey % 5 WHEN 0 THEN 'production' WHEN 1 THEN 'STAGING' WHEN 2 THEN CAST(o_orderkey % 300 AS VARCHAR)
 WHEN 3 THEN 'Archived' ELSE 'canary' END AS w FROM orders),
l AS (SELECT name, stage, MAX(version) AS version FROM {SQL_MODELS} GROUP BY 1, 2)
SELECT request_id, r.model_name, w AS version_or_stage, COALESCE(m.version, l.version) AS version,
COALESCE(m.stage, l.stage) AS stage, 'run-' || COALESCE(m.version, l.version) AS run_id,
CASE WHEN w = 'canary' THEN 'Invalid stage name: canary'
 WHEN regexp_full_match(w, '[0-9]+') AND m.version IS NULL THEN 'Model version not found: ' || w
 WHEN m.version IS NULL AND l.version IS NULL THEN 'No model version found with stage ' || upper(w[1]) || lower(w[2:]) END AS error
FROM r LEFT JOIN l ON r.model_name = l.name AND lower(w) = lower(l.stage)
LEFT JOIN {SQL_MODELS} m ON r.model_name = m.name AND TRY_CAST(w AS INTEGER) = m.version""")
def model_resolve(t: Tables) -> DataFrame:
    return M.resolve(model_requests(t), model_registry(t)).drop("description")


@query(f"""SELECT environment, name, version, status, deployed_at FROM (
SELECT r_name AS environment, p_brand AS name, CAST(p_partkey AS INTEGER) AS version, o_orderstatus AS status, o_orderdate AS deployed_at,
 row_number() OVER (PARTITION BY r_name, p_brand ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
FROM orders JOIN part ON o_orderkey % 1000 = p_partkey JOIN region ON o_custkey % 5 = r_regionkey) WHERE n = 1""")
def current_deployments(t: Tables) -> DataFrame:
    models = t.raw("part").select(F.col("p_partkey").alias("model_id"), F.col("p_brand").alias("name"),
                                  F.col("p_partkey").cast("int").alias("version"), F.col("p_type").alias("framework"))
    places = t.raw("region").select(F.col("r_regionkey").alias("place"), F.col("r_name").alias("environment"))
    deployments = (t.raw("orders").select(
        F.col("o_orderkey").alias("deployment_id"), (F.col("o_orderkey") % 1000).alias("model_id"),
        (F.col("o_custkey") % 5).cast("int").alias("place"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("deployed_at")).join(places, "place").drop("place"))
    return M.current_deployments(models, deployments).select("environment", "name", "version", "status", "deployed_at")


def _requests(t: Tables) -> DataFrame:
    return t.prediction_log().withColumn("request_id", F.md5("request_id"))


@query(f"""SELECT md5(request_id) AS request_id, CASE WHEN regexp_matches(md5(request_id), '[0-1][0-9]') THEN 'B' ELSE 'A' END AS arm
FROM {SQL_LOG}""")
def ab_regex(t: Tables) -> DataFrame:
    return M.assign(_requests(t), "request_id", mode="regex").select("request_id", "arm")


SQL_ARM = """CASE WHEN ('0x' || substr(md5('ab' || md5(request_id)), 1, 8))::BIGINT % 10000 < 8000 THEN 'A' ELSE 'B' END"""


@query(f"SELECT md5(request_id) AS request_id, {SQL_ARM} AS arm FROM {SQL_LOG}")
def ab_weighted(t: Tables) -> DataFrame:
    return M.assign(_requests(t), "request_id").select("request_id", "arm")


@query(f"""SELECT {SQL_ARM} AS arm, COUNT(*) AS requests, COUNT(*) FILTER (error IS NULL) AS successes,
CAST(COUNT(*) FILTER (error IS NULL) AS DOUBLE) / COUNT(*) * 100 AS success_rate,
ROUND(AVG(latency_ms) FILTER (error IS NULL), 4) AS avg_latency_ms FROM {SQL_LOG} GROUP BY 1""")
def ab_compare(t: Tables) -> DataFrame:
    return M.compare_arms(M.assign(_requests(t), "request_id")).withColumn("avg_latency_ms", F.round("avg_latency_ms", 4))
