"""Evidence roll-ups and verification outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import evidence as rule
from .partitioned import with_previous


def source_rollup(entries: DataFrame, by: Sequence[str] = ("source_type",)) -> DataFrame:
    """Per source: evaluated and crossed stations, status and observation bounds.

    Entries fold to one row per station before any list is built.
    """
    stations = entries.groupBy(*by, "station_id").agg(
        F.bool_or(F.col("evaluation_status") != "NOT_EVALUATED").alias("evaluated"),
        F.bool_or(
            (F.col("evaluation_status") != "NOT_EVALUATED") & (F.col("threshold_result") == "CONFIGURED_ENSEMBLE_THRESHOLD_MET")
        ).alias("crossed"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )
    out = stations.groupBy(*by).agg(
        F.count_if("evaluated").alias("n_evaluated"),
        F.count_if("crossed").alias("n_crossed"),
        F.sort_array(F.collect_list(F.when(F.col("crossed"), F.col("station_id")))).alias("crossed_station_ids"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
    )
    return out.withColumn(
        "status",
        F.when(F.col("n_crossed") > 0, "SOURCE_CONFIGURED_THRESHOLD_MET")
        .when(F.col("n_evaluated") > 0, "SOURCE_NO_CONFIGURED_THRESHOLD_MET_IN_EVALUATED_WINDOWS")
        .otherwise("SOURCE_NOT_EVALUATED"),
    )


def with_checks(assessments: DataFrame, checks: Sequence[rule.Check]) -> DataFrame:
    """Add `checks`: every check of the row with its applicability at the row's stage."""
    return assessments.withColumn("checks", F.array(*[rule.scoped_check(F.col("stage"), c) for c in checks]))


def explode_checks(checked: DataFrame) -> DataFrame:
    """One row per (assessment, check)."""
    return checked.select("assessment_id", "stage", F.explode("checks").alias("c")).select("assessment_id", "stage", "c.*")


def verification_outcome(checked: DataFrame) -> DataFrame:
    """Outcome per assessment: any failure, then missing required input, then concerns.

    All checks of an assessment sit in its row, so nothing is regrouped.
    """

    def applies(c):
        return c["applicability"] != "NOT_APPLICABLE"

    def blocked(c):
        return c["prerequisite"].isin("MISSING", "ERROR")

    def named(test):
        return F.sort_array(F.transform(F.filter("checks", test), lambda c: c["check"]))

    judged = checked.select(
        "assessment_id",
        F.exists("checks", applies).alias("_any"),
        named(lambda c: applies(c) & (c["result"] == "FAIL")).alias("_failed"),
        named(lambda c: (c["applicability"] == "REQUIRED") & blocked(c)).alias("_blocked"),
        F.exists("checks", lambda c: (applies(c) & (c["result"] == "CONCERN")) | ((c["applicability"] == "OPTIONAL") & blocked(c))).alias("_c"),
    )
    failed, lacking = F.size("_failed") > 0, F.size("_blocked") > 0
    outcome = (
        F.when(~F.col("_any"), "INCOMPLETE")
        .when(failed, "FAIL")
        .when(lacking, "INCOMPLETE")
        .when(F.col("_c"), "PASS_WITH_CONCERNS")
        .otherwise("PASS")
    )
    reason = (
        F.when(~F.col("_any"), "no applicable checks")
        .when(failed, F.concat(F.lit("failed: "), F.array_join("_failed", "; ")))
        .when(lacking, F.concat(F.lit("without input: "), F.array_join("_blocked", "; ")))
    )
    out = judged.select("assessment_id", outcome.alias("outcome"), reason.alias("abstain_reason"))
    return out.withColumn("abstain", F.col("outcome").isin("FAIL", "INCOMPLETE"))


def model_bias(residuals: DataFrame, key: str = "event_id") -> DataFrame:
    """Systematic offset over stations: mean of station means against its standard error, above a floor."""
    means = residuals.groupBy(key, "station_id").agg(F.avg("residual_m").alias("_m"))
    out = means.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_stations"), F.avg("_m").alias("grand_mean_m"), F.stddev_samp("_m").alias("_sd")
    )
    z = F.abs("grand_mean_m") / (F.col("_sd") / F.sqrt("n_stations"))
    large = F.abs("grand_mean_m") * 100 > rule.BIAS_FLOOR_CM
    biased = (F.col("n_stations") >= 2) & large & ((F.col("_sd") == 0) | (z > rule.BIAS_SIGMAS))
    return out.select(key, "n_stations", "grand_mean_m", F.when(F.col("_sd") > 0, z).alias("z"), F.coalesce(biased, F.lit(False)).alias("biased"))


def leading_set_changed(assessments: DataFrame, key: str, order: Sequence[str], ids: str, bucket) -> DataFrame:
    """Whether the set of leading sources differs from the assessment before; null for the first."""
    sets = assessments.withColumn("_set", F.array_sort(F.array_distinct(ids)))
    stepped = with_previous(sets, [key], order, ["_set"], bucket)
    return stepped.withColumn("changed", F.col("prev")["_set"] != F.col("_set")).drop("prev", "_set")
