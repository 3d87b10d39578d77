"""Status rules of evidence entries and verification checks as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CALIBRATION_ADEQUATE_MIN, T1

PREVENT, LIMIT, INFORM = "PREVENTS_EVALUATION", "LIMITS_INTERPRETATION", "INFORMATIONAL"

# Condition registry, (axis, value) to (limitation code, effect).
LIMITATIONS = {
    ("CalibrationStatus", "LIMITED_PRE_EVENT_BASELINE"): ("CALIBRATION_LIMITED_PRE_EVENT_BASELINE", LIMIT),
    ("CalibrationStatus", "EVENT_WINDOW_FALLBACK"): ("CALIBRATION_EVENT_WINDOW_FALLBACK", LIMIT),
    ("CalibrationStatus", "UNAVAILABLE"): ("CALIBRATION_UNAVAILABLE", PREVENT),
    ("CalibrationStatus", "ERROR"): ("CALIBRATION_ERROR", PREVENT),
    ("QCExecutionStatus", "PARTIAL"): ("QC_EXECUTION_PARTIAL", LIMIT),
    ("QCExecutionStatus", "FAILED"): ("QC_EXECUTION_FAILED", LIMIT),
    ("QCExecutionStatus", "NOT_RUN"): ("QC_NOT_RUN", LIMIT),
    ("QCAggregateCondition", "NO_RETAINED_QC"): ("QC_ABSENT_FOR_RETAINED_WINDOW", LIMIT),
    ("QCAggregateCondition", "WORST_FLAG_NOT_EVALUATED"): ("QC_WORST_FLAG_NOT_EVALUATED", INFORM),
    ("QCAggregateCondition", "WORST_FLAG_SUSPECT"): ("QC_WORST_FLAG_SUSPECT", INFORM),
    ("QCAggregateCondition", "WORST_FLAG_FAIL"): ("QC_WORST_FLAG_FAIL", LIMIT),
    ("QCAggregateCondition", "WORST_FLAG_MISSING"): ("QC_WORST_FLAG_MISSING", LIMIT),
    ("CadenceCondition", "IRREGULAR"): ("CADENCE_IRREGULAR", INFORM),
    ("CadenceCondition", "UNKNOWN"): ("CADENCE_UNKNOWN", INFORM),
    ("FilteringCondition", "DEGRADED_NYQUIST"): ("FILTER_DEGRADED_NYQUIST", LIMIT),
    ("FilteringCondition", "UNKNOWN"): ("FILTERING_STATE_UNKNOWN", INFORM),
    ("ConfounderResultValue", "FLAG_RAISED"): ("CONFOUNDER_FLAG_RAISED", LIMIT),
    ("ConfounderResultValue", "NOT_EVALUATED"): ("CONFOUNDER_NOT_EVALUATED", INFORM),
    ("SourceValidationStatus", "VALIDATION_LIMITED"): ("SOURCE_VALIDATION_LIMITED", LIMIT),
    ("SourceValidationStatus", "VALIDATION_NOT_EVALUATED"): ("SOURCE_VALIDATION_NOT_EVALUATED", LIMIT),
    ("ProvenanceStatus", "PARTIAL"): ("PROVENANCE_PARTIAL", INFORM),
    ("ProvenanceStatus", "UNAVAILABLE"): ("PROVENANCE_UNAVAILABLE", LIMIT),
    ("StationScope", "OBSERVED_RECORDS_ONLY"): ("NETWORK_COVERAGE_NOT_EVALUATED", INFORM),
    ("StationManifestCondition", "OUT_OF_MANIFEST"): ("OUT_OF_MANIFEST_OBSERVATION", INFORM),
    ("MixedProductCondition", "MIXED_PRODUCTS"): ("MIXED_PRODUCT_WINDOW", LIMIT),
}


def limitations(conditions: dict[str, Column]) -> Column:
    """Distinct (code, effect) structs, sorted by code, that a row's conditions carry.

    The registry is a small constant map, so the lookup stays inside the row: no
    join, no regrouping.
    """
    pairs = [F.lit(x) for (axis, value), held in LIMITATIONS.items() for x in (f"{axis}:{value}", "|".join(held))]
    registry = F.create_map(*pairs)
    found = F.array_compact(F.array(*[F.try_element_at(registry, F.concat(F.lit(axis + ":"), v)) for axis, v in conditions.items()]))
    return F.transform(
        F.array_sort(F.array_distinct(found)),
        lambda x: F.struct(F.split_part(x, F.lit("|"), F.lit(1)).alias("code"), F.split_part(x, F.lit("|"), F.lit(2)).alias("effect")),
    )


def calibration_status(source_type: Column, scored: Column, fit_source: Column, fit_span_min: Column, span_min: Column) -> Column:
    """Calibration state of a station; gauges need none, buoys need three days."""

    def by_span(span: Column) -> Column:
        return F.when(F.coalesce(span, F.lit(0.0)) >= CALIBRATION_ADEQUATE_MIN, "ADEQUATE_PRE_EVENT_BASELINE").otherwise(
            "LIMITED_PRE_EVENT_BASELINE"
        )

    from_score = (
        F.when(fit_source == "separate calibration series", by_span(fit_span_min))
        .when(fit_source == "event window", "EVENT_WINDOW_FALLBACK")
        .otherwise("UNAVAILABLE")
    )
    return (
        F.when(source_type != "dart", "NOT_REQUIRED")
        .when(scored, from_score)
        .when(span_min.isNotNull(), by_span(span_min))
        .otherwise("UNAVAILABLE")
    )


def evaluation_status(scoring_status: Column, effects: Column) -> Column:
    return (
        F.when((scoring_status != "SCORING_SUCCEEDED") | F.array_contains(effects, PREVENT), "NOT_EVALUATED")
        .when(F.array_contains(effects, LIMIT), "EVALUATED_WITH_LIMITATIONS")
        .otherwise("EVALUATED")
    )


def threshold_result(evaluation: Column, score: Column) -> Column:
    return (
        F.when((evaluation == "NOT_EVALUATED") | score.isNull(), "NOT_EVALUATED")
        .when(score >= T1, "CONFIGURED_ENSEMBLE_THRESHOLD_MET")
        .otherwise("NO_CONFIGURED_ENSEMBLE_THRESHOLD_MET_IN_EVALUATED_WINDOW")
    )


def run_outcome(outcome: Column, state_after: Column, seismic_only: Column) -> Column:
    continues = (outcome == "insufficient_evidence") & state_after.isin("MONITOR", "INVESTIGATE")
    return F.when(seismic_only | (outcome == "abstain"), "ABSTAIN").when(continues, "MONITORING_CONTINUES").otherwise("PROCESSING_INCOMPLETE")


# Check limits.
ARRIVAL_CONCERN_MIN, ARRIVAL_FAIL_MIN = 3.0, 5.0
AMPLITUDE_CONCERN, AMPLITUDE_FAIL, AMPLITUDE_FLOOR = 0.30, 0.50, 1e-12
MW_CONCERN, MW_FAIL = 0.3, 0.6
RMSE_CONCERN_CM, RMSE_FAIL_CM = 3.0, 5.0
METEO_CONCERN, METEO_FAIL = 0.3, 0.6
MIN_STATIONS, SPREAD_CONCERN_DEG = 2, 90.0
BIAS_SIGMAS, BIAS_FLOOR_CM = 3.0, 1.0


def graded(x: Column, concern: float, fail: float) -> Column:
    return F.when(x > fail, "FAIL").when(x > concern, "CONCERN").otherwise("PASS")


@dataclass(frozen=True)
class Check:
    """One check of an assessment: when its input is missing, and its result otherwise."""

    name: str
    missing: Column
    result: Column


def holdout_check(arrival_error_min: Column, observed_peak: Column, predicted_peak: Column) -> Check:
    tiny = observed_peak < AMPLITUDE_FLOOR
    error = (
        F.when(tiny & (predicted_peak < AMPLITUDE_FLOOR), 0.0)
        .when(tiny, F.abs(predicted_peak - observed_peak) / F.greatest(predicted_peak, F.lit(AMPLITUDE_FLOOR)))
        .otherwise(F.abs(predicted_peak - observed_peak) / observed_peak)
    )
    late = F.coalesce(arrival_error_min, F.lit(0.0))
    fail = (late > ARRIVAL_FAIL_MIN) | (error > AMPLITUDE_FAIL)
    concern = (late > ARRIVAL_CONCERN_MIN) | (error > AMPLITUDE_CONCERN)
    return Check(
        "holdout_station_validation",
        observed_peak.isNull() | predicted_peak.isNull(),
        F.when(fail, "FAIL").when(concern, "CONCERN").otherwise("PASS"),
    )


def coverage_check(n_stations: Column, spread_deg: Column) -> Check:
    few = n_stations < MIN_STATIONS
    return Check(
        "data_coverage",
        ~few & spread_deg.isNull(),
        F.when(few, "FAIL").when(spread_deg < SPREAD_CONCERN_DEG, "CONCERN").otherwise("PASS"),
    )


def consistency_check(mw_fit: Column, mw_seismic: Column) -> Check:
    delta = F.abs(mw_fit - mw_seismic)
    return Check("physical_consistency", delta.isNull(), graded(delta, MW_CONCERN, MW_FAIL))


def fit_check(rmse_cm: Column, biased: Column) -> Check:
    return Check(
        "model_fit_quality",
        rmse_cm.isNull(),
        F.when(F.coalesce(biased, F.lit(False)), "FAIL").otherwise(graded(rmse_cm, RMSE_CONCERN_CM, RMSE_FAIL_CM)),
    )


def tidal_check(n_proxies: Column, n_uncorrected: Column, needed: Column) -> Check:
    return Check(
        "tidal_state_review",
        n_proxies == 0,
        F.when(n_uncorrected == 0, "PASS").when(needed, "FAIL").otherwise("CONCERN"),
    )


def weather_check(score: Column) -> Check:
    return Check("meteotsunami_discriminator", score.isNull(), graded(score, METEO_CONCERN, METEO_FAIL))


def surface_wave_check(suspect: Column) -> Check:
    return Check("rayleigh_wave_suspect", suspect.isNull(), F.when(suspect, "CONCERN").otherwise("PASS"))


def stability_check(changed: Column) -> Check:
    return Check("posterior_stability", changed.isNull(), F.when(changed, "CONCERN").otherwise("PASS"))


def sensitivity_check(result: Column) -> Check:
    return Check("sensitivity_analysis", result.isNull(), result)


# Checks a stage requires, and those that do not apply to it; all others are optional.
REQUIRED = {
    "SEISMIC_ONLY": ("physical_consistency",),
    "DART_CONSTRAINED": ("data_coverage", "physical_consistency", "model_fit_quality"),
    "MULTI_STATION": ("sensitivity_analysis", "data_coverage", "physical_consistency", "model_fit_quality"),
}
NOT_APPLICABLE = {
    "SEISMIC_ONLY": ("holdout_station_validation", "sensitivity_analysis", "data_coverage", "model_fit_quality"),
}


def applicability(stage: Column, name: str) -> Column:
    needed = [s for s, names in REQUIRED.items() if name in names]
    skipped = [s for s, names in NOT_APPLICABLE.items() if name in names]
    return F.when(stage.isin(skipped), "NOT_APPLICABLE").when(stage.isin(needed), "REQUIRED").otherwise("OPTIONAL")


def scoped_check(stage: Column, c: Check) -> Column:
    """The check as a struct at the row's stage."""
    skipped = stage.isin([s for s, names in NOT_APPLICABLE.items() if c.name in names])
    return F.struct(
        F.lit(c.name).alias("check"),
        applicability(stage, c.name).alias("applicability"),
        F.when(skipped, "NOT_APPLICABLE").when(c.missing, "NOT_EVALUATED").otherwise(c.result).alias("result"),
        F.when(skipped, "NOT_REQUIRED").when(c.missing, "MISSING").otherwise("AVAILABLE").alias("prerequisite"),
    )


# Confidence weights, outcome and spread scores, and report levels.
OUTCOME_SCORE = {"PASS": 1.0, "PASS_WITH_CONCERNS": 0.6}
SPREAD_SCORE = {"LOW": 1.0, "MODERATE": 0.5}
WEIGHT_OUTCOME, WEIGHT_STATIONS, WEIGHT_SPREAD = 0.40, 0.25, 0.35
SURFACE_WAVE_DISCOUNT = 0.7


def system_confidence(outcome: Column, n_stations: Column, spread: Column, suspect: Column) -> Column:
    by_outcome = F.lit(0.2)
    for name, value in OUTCOME_SCORE.items():
        by_outcome = F.when(outcome == name, value).otherwise(by_outcome)
    by_spread = F.lit(0.0)
    for name, value in SPREAD_SCORE.items():
        by_spread = F.when(spread == name, value).otherwise(by_spread)
    coverage = F.least(n_stations / 5.0, F.lit(1.0))
    base = WEIGHT_OUTCOME * by_outcome + WEIGHT_STATIONS * coverage + WEIGHT_SPREAD * by_spread
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * F.when(suspect, SURFACE_WAVE_DISCOUNT).otherwise(1.0)))


def confidence_level(outcome: Column, spread: Column) -> Column:
    """Report level; a failed or incomplete verification has none."""
    low = spread == "LOW"
    return F.when(outcome == "PASS", F.when(low, "high").otherwise("moderate")).when(
        outcome == "PASS_WITH_CONCERNS", F.when(low, "moderate").otherwise("low")
    )


def ensemble_spread(p10: Column, p90: Column) -> Column:
    return F.when(p10 <= 0, "HIGH").when(p90 / p10 < 2.0, "LOW").when(p90 / p10 <= 5.0, "MODERATE").otherwise("HIGH")


def any_effect(found: Column) -> Column:
    return F.transform(found, lambda x: x["effect"])


def joined_codes(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: x["code"]), ",")
