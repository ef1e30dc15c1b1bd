"""Model lookup, batch scoring, traffic split and comparison of arms."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from featloom.functions.hashing import hash_bucket
from featloom.operators.latest import latest_by_key
from featloom.plans.serving import client_summary

# Stage names a request may use, and the pattern of the literal split rule.
STAGES = ("Production", "Staging", "Archived", "None")
SPLIT_PATTERN = "[0-1][0-9]"


def latest_versions(registry: DataFrame) -> DataFrame:
    """The newest version per model and stage."""
    return latest_by_key(registry, ["name", "stage"], ["version"])


def resolve(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Each request (`model_name`, `version_or_stage`) with its model version or an error.

    Digits name a version; a stage name in any case means its newest version.
    """
    wanted = F.col("version_or_stage").cast("string")
    by_number = wanted.rlike("^[0-9]+$")
    stage = F.initcap(F.lower(wanted))
    asked = (requests.withColumn("_version", F.when(by_number, wanted.try_cast("int")))
             .withColumn("_stage", F.when(~by_number & stage.isin(*STAGES), stage)))
    bad_stage = ~by_number & F.col("_stage").isNull()
    # only the newest version of a stage can answer a stage request
    newest = latest_versions(registry).select("name", "stage", F.col("version").alias("newest"))
    told = (asked.join(newest.select(F.col("name").alias("model_name"), F.col("stage").alias("_stage"), "newest"),
                       ["model_name", "_stage"], "left")
            .withColumn("_version", F.coalesce("_version", "newest")))
    info = registry.select(F.col("name").alias("model_name"), F.col("version").alias("_version"),
                           F.col("version"), "stage",
                           *[c for c in registry.columns if c not in ("name", "version", "stage")])
    found = told.join(info, ["model_name", "_version"], "left")
    error = (F.when(bad_stage, F.concat(F.lit("Invalid stage name: "), F.lower(wanted)))
             .when(F.col("version").isNull() & by_number,
                   F.concat(F.lit("Model version not found: "), wanted))
             .when(F.col("version").isNull(),
                   F.concat(F.lit("No model version found with stage "), F.col("_stage"))))
    return found.withColumn("error", error).drop("_version", "_stage", "newest")



def score(df: DataFrame, predict: Callable[[pd.DataFrame], object], features: Sequence[str],
          model_name: str, model_version: str, prediction_type: str = "double",
          give_up: int | None = None) -> DataFrame:
    """Rows with prediction, model, batch latency per row and error text.

    `predict` is any function of a pandas frame. It is sent to the executors with the
    task and called once per Arrow batch, with the feature columns only. A batch that
    fails, or gives another number of predictions than rows, is halved until the rows that
    fail stand alone: one bad row becomes one error row. With `give_up` a model that has
    failed on so many single rows in succession is not asked about the rest of the batch,
    whose rows get the last error.
    """
    features = list(features)
    result = T.StructType([
        T.StructField("prediction", T.DoubleType() if prediction_type == "double" else T.StringType()),
        T.StructField("latency_ms", T.DoubleType()), T.StructField("error", T.StringType())])
    plain = float if prediction_type == "double" else str

    def asked(x: pd.DataFrame) -> list:
        values = list(predict(x))
        if len(values) != len(x):
            raise ValueError(f"{len(values)} predictions for {len(x)} rows")
        return [None if v is None else plain(v) for v in values]

    def answers(x: pd.DataFrame) -> tuple[list, list]:
        values, errors = [None] * len(x), [None] * len(x)
        todo, failed = [(0, len(x))], 0
        while todo:
            start, end = todo.pop()
            if give_up is not None and failed >= give_up:
                errors[start:end] = [errors[last]] * (end - start)
                continue
            try:
                values[start:end] = asked(x.iloc[start:end])
                failed = 0
            except Exception as e:  # the error becomes the row's result
                if end - start == 1:
                    errors[start], last = str(e), start
                    failed += 1
                else:
                    middle = (start + end) // 2
                    todo += [(middle, end), (start, middle)]
        return values, errors

    @F.pandas_udf(result)
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            start = time.perf_counter()
            values, errors = answers(x)
            spent = (time.perf_counter() - start) * 1000 / max(len(x), 1)
            yield pd.DataFrame({"prediction": pd.Series(values, dtype="float64" if plain is float else "object"),
                                "latency_ms": spent, "error": pd.Series(errors, dtype="object")})

    out = df.withColumn("_scored", scored(F.struct(*features)))
    return out.select(*df.columns, F.nanvl("_scored.prediction", F.lit(None).cast("double")).alias("prediction")
                      if plain is float else F.col("_scored.prediction").alias("prediction"),
                      F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version"),
                      F.col("_scored.latency_ms").alias("latency_ms"), F.col("_scored.error").alias("error"))


def linear_model(weights: dict[str, float], intercept: float) -> Callable[[pd.DataFrame], pd.Series]:
    def predict(x: pd.DataFrame) -> pd.Series:
        out = intercept
        for name, w in weights.items():
            out = out + x[name].astype("float64") * w
        return out
    return predict


def prediction_facts(scored: DataFrame, entity: str, moment: Column, label: Column | None = None,
                     probability: Column | None = None) -> DataFrame:
    """Scored rows in the layout of the prediction fact."""
    return scored.select(
        F.concat_ws(":", "model_name", "model_version").alias("model_id"),
        F.col(entity).cast("string").alias("entity_id"), F.col("prediction").alias("prediction_value"),
        (label if label is not None else F.lit(None).cast("string")).alias("prediction_label"),
        (probability if probability is not None else F.lit(None).cast("double")).alias("prediction_probability"),
        moment.alias("prediction_timestamp"), "latency_ms")


def assign(df: DataFrame, id_column: str, weights: dict[str, float] | None = None,
           salt: str = "ab", mode: str = "hash", method: str = "md5") -> DataFrame:
    """Rows with their `arm`. An id always gets the same arm.

    `hash` follows the weights. `regex` is the literal gateway rule: B if the id holds a
    0 or 1 followed by a digit, which sends most hexadecimal ids to B.
    """
    if mode == "regex":
        return df.withColumn("arm", F.when(F.col(id_column).rlike(SPLIT_PATTERN), "B").otherwise("A"))
    weights = weights or {"A": 0.8, "B": 0.2}
    if abs(sum(weights.values()) - 1.0) > 1e-9:
        raise ValueError("weights must add up to 1")
    bucket = hash_bucket(F.col(id_column), 10_000, salt, method)
    arm, upper = None, 0.0
    for name, w in weights.items():
        upper += w
        edge = bucket < int(round(upper * 10_000))
        arm = F.when(edge, name) if arm is None else arm.when(edge, name)
    return df.withColumn("arm", arm)


def compare_arms(requests: DataFrame) -> DataFrame:
    """Client summary per arm."""
    return client_summary(requests, ["arm"])


def current_deployments(models: DataFrame, deployments: DataFrame) -> DataFrame:
    """The latest deployment per environment and model name, with its model."""
    known = models.select("model_id", "name", "version", "framework")
    both = deployments.join(known, "model_id")
    return latest_by_key(both, ["environment", "name"], ["deployed_at", "deployment_id"])
