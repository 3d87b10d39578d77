"""Evidence, verification, lineage and policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as R
from ..operators import evidence as V
from ..operators import joins as J
from ..operators import lineage as L
from ..operators.partitioned import time_bucket
from ..session import spread
from . import Catalog
from .adapters import OBS, QUAKES, SCORES, observations, quakes, scores, table, with_cte
from .quality import FLAGS_SQL, flagged

C = Catalog()

AXES = {
    "QCExecutionStatus": ("SUCCEEDED", "PARTIAL", "FAILED", "NOT_RUN"),
    "QCAggregateCondition": ("WORST_FLAG_PASS", "WORST_FLAG_SUSPECT", "WORST_FLAG_FAIL", "WORST_FLAG_MISSING", "WORST_FLAG_NOT_EVALUATED", "NO_RETAINED_QC"),
    "CadenceCondition": ("NOMINAL", "IRREGULAR", "UNKNOWN"),
    "FilteringCondition": ("NOMINAL", "DEGRADED_NYQUIST", "UNKNOWN"),
    "ConfounderResultValue": ("FLAG_RAISED", "FLAG_NOT_RAISED", "NOT_EVALUATED", "NOT_APPLICABLE"),
    "ProvenanceStatus": ("RESOLVED", "PARTIAL", "UNAVAILABLE"),
    "MixedProductCondition": ("SINGLE_PRODUCT", "MIXED_PRODUCTS"),
}
STEPS = (7, 11, 13, 17, 19, 23, 29)


def pick(k, values, step):
    return F.array(*[F.lit(v) for v in values])[((k * step + F.floor(k / step)) % len(values)).cast("int")]


def pick_sql(values, step):
    listed = ", ".join(f"'{v}'" for v in values)
    return f"[{listed}][CAST((window_id * {step} + window_id // {step}) % {len(values)} AS INT) + 1]"


CAL_SQL = """CASE WHEN source_type <> 'dart' THEN 'NOT_REQUIRED'
    WHEN window_id % 6 <> 0 THEN CASE window_id % 4 WHEN 0 THEN CASE WHEN (window_id % 10) * 1000.0 >= 4320 THEN 'ADEQUATE_PRE_EVENT_BASELINE' ELSE 'LIMITED_PRE_EVENT_BASELINE' END
      WHEN 1 THEN 'EVENT_WINDOW_FALLBACK' ELSE 'UNAVAILABLE' END
    WHEN window_id % 5 <> 0 THEN CASE WHEN (window_id % 8) * 1000.0 >= 4320 THEN 'ADEQUATE_PRE_EVENT_BASELINE' ELSE 'LIMITED_PRE_EVENT_BASELINE' END
    ELSE 'UNAVAILABLE' END"""
REGISTRY_SQL = ", ".join(f"('{a}', '{v}', '{c}', '{e}')" for (a, v), (c, e) in R.LIMITATIONS.items())
ENTRIES = SCORES + f""",
ent AS (SELECT *, {CAL_SQL} AS calibration, """ + ", ".join(
    f"{pick_sql(v, s)} AS {a}" for (a, v), s in zip(AXES.items(), STEPS)
) + f""" FROM scores),
reg(axis, val, code, effect) AS (VALUES {REGISTRY_SQL}),
cond AS (SELECT window_id, 'CalibrationStatus' AS axis, calibration AS val FROM ent """ + " ".join(
    f"UNION ALL SELECT window_id, '{a}', {a} FROM ent" for a in AXES
) + """),
lim AS (SELECT window_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, bool_or(effect = 'PREVENTS_EVALUATION') AS prevents,
  bool_or(effect = 'LIMITS_INTERPRETATION') AS limits FROM cond JOIN reg USING (axis, val) GROUP BY 1),
judged AS (SELECT e.*, coalesce(codes, '') AS codes, CASE WHEN window_id % 9 = 0 OR coalesce(prevents, false) THEN 'NOT_EVALUATED'
    WHEN coalesce(limits, false) THEN 'EVALUATED_WITH_LIMITATIONS' ELSE 'EVALUATED' END AS evaluation_status
  FROM ent e LEFT JOIN lim USING (window_id)),
entries AS (SELECT *, CASE WHEN evaluation_status = 'NOT_EVALUATED' THEN 'NOT_EVALUATED' WHEN score >= 0.35 THEN 'CONFIGURED_ENSEMBLE_THRESHOLD_MET'
  ELSE 'NO_CONFIGURED_ENSEMBLE_THRESHOLD_MET_IN_EVALUATED_WINDOW' END AS threshold_result FROM judged)"""


def entries(spark, sf_dir):
    rows = scores(spark, sf_dir)
    k = F.col("window_id")
    calibration = R.calibration_status(
        F.col("source_type"),
        k % 6 != 0,
        F.when(k % 4 == 0, "separate calibration series").when(k % 4 == 1, "event window").otherwise(""),
        (k % 10) * 1000.0,
        F.when(k % 5 != 0, (k % 8) * 1000.0),
    )
    conditions = {"CalibrationStatus": calibration} | {a: pick(k, v, s) for (a, v), s in zip(AXES.items(), STEPS)}
    held = rows.withColumn("calibration", calibration).withColumn("limits", R.limitations(conditions))
    scoring = F.when(k % 9 == 0, "SCORING_FAILED").otherwise("SCORING_SUCCEEDED")
    judged = held.withColumn("evaluation_status", R.evaluation_status(scoring, R.any_effect(F.col("limits"))))
    return judged.withColumn("threshold_result", R.threshold_result(F.col("evaluation_status"), F.col("score")))


@C.add("calibration_status", with_cte(SCORES, body=f"SELECT window_id, {CAL_SQL} AS calibration FROM scores"))
def calibration_status(spark, sf_dir):
    return entries(spark, sf_dir).select("window_id", "calibration")


@C.add("apply_registry", with_cte(ENTRIES, body="SELECT window_id, codes FROM entries"))
def apply_registry(spark, sf_dir):
    return entries(spark, sf_dir).select("window_id", R.joined_codes(F.col("limits")).alias("codes"))


@C.add("evaluation_status", with_cte(ENTRIES, body="SELECT window_id, evaluation_status, threshold_result FROM entries"))
def evaluation_status(spark, sf_dir):
    return entries(spark, sf_dir).select("window_id", "evaluation_status", "threshold_result")


@C.add(
    "run_outcome",
    with_cte(SCORES, body="""SELECT window_id, CASE WHEN window_id % 13 = 0 OR window_id % 3 = 0 THEN 'ABSTAIN'
  WHEN window_id % 3 = 1 AND (score < 0.60) THEN 'MONITORING_CONTINUES' ELSE 'PROCESSING_INCOMPLETE' END AS outcome FROM scores"""),
)
def run_outcome(spark, sf_dir):
    from ..functions.scores import reached_tier

    k = F.col("window_id")
    said = F.when(k % 3 == 0, "abstain").when(k % 3 == 1, "insufficient_evidence").otherwise("verified_pending_report")
    return scores(spark, sf_dir).select("window_id", R.run_outcome(said, reached_tier(F.col("score")), k % 13 == 0).alias("outcome"))


@C.add(
    "source_rollup",
    with_cte(ENTRIES, body="""SELECT day, source_type, count(*) FILTER (ev) AS n_evaluated, count(*) FILTER (cr) AS n_crossed,
  coalesce(string_agg(CASE WHEN cr THEN CAST(station_id AS VARCHAR) END, ',' ORDER BY station_id), '') AS crossed, min(f) AS first_us, max(l) AS last_us,
  CASE WHEN count(*) FILTER (cr) > 0 THEN 'SOURCE_CONFIGURED_THRESHOLD_MET' WHEN count(*) FILTER (ev) > 0
    THEN 'SOURCE_NO_CONFIGURED_THRESHOLD_MET_IN_EVALUATED_WINDOWS' ELSE 'SOURCE_NOT_EVALUATED' END AS status FROM (
  SELECT ts_us // 86400000000 AS day, source_type, station_id, bool_or(evaluation_status <> 'NOT_EVALUATED') AS ev,
    bool_or(evaluation_status <> 'NOT_EVALUATED' AND threshold_result = 'CONFIGURED_ENSEMBLE_THRESHOLD_MET') AS cr, min(ts_us) AS f, max(ts_us) AS l
  FROM entries GROUP BY 1, 2, 3) GROUP BY 1, 2"""),
)
def source_rollup(spark, sf_dir):
    rows = entries(spark, sf_dir).withColumn("day", F.expr("ts_us div 86400000000"))
    out = V.source_rollup(rows, ["day", "source_type"])
    text = F.array_join(F.transform("crossed_station_ids", lambda x: x.cast("string")), ",")
    return out.withColumn("crossed", text).drop("crossed_station_ids")


@C.add(
    "assessment_scope",
    with_cte(SCORES, body="""SELECT DISTINCT source_type, station_id FROM scores WHERE ts_us < 1704153600000000
UNION SELECT DISTINCT source_type, station_id FROM scores WHERE score >= 0.85"""),
)
def assessment_scope(spark, sf_dir):
    rows = scores(spark, sf_dir)
    window = rows.where(F.col("ts_us") < 1_704_153_600_000_000).select("source_type", "station_id")
    return window.union(rows.where(F.col("score") >= 0.85).select("source_type", "station_id")).distinct()


# ---- verification

VERIF = """asm AS (SELECT o_orderkey AS id, ['SEISMIC_ONLY', 'DART_CONSTRAINED', 'MULTI_STATION'][CAST(o_orderkey % 3 AS INT) + 1] AS stage,
  CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 9)::DOUBLE END AS arr, CASE WHEN o_orderkey % 10 <> 0 THEN 1.0::DOUBLE END AS obs_peak,
  1.0::DOUBLE + (o_orderkey % 13) / 20.0::DOUBLE AS pred_peak, o_orderkey % 5 AS n_st, CASE WHEN o_orderkey % 8 <> 0 THEN (o_orderkey * 31 % 360)::DOUBLE END AS spread,
  6.0::DOUBLE + (o_orderkey % 10) / 10.0::DOUBLE AS mw_fit, CASE WHEN o_orderkey % 12 <> 0 THEN 6.45::DOUBLE END AS mw_seis,
  CASE WHEN o_orderkey % 14 <> 0 THEN (o_orderkey % 60) / 10.0::DOUBLE END AS rmse, o_orderkey % 50 = 0 AS biased, o_orderkey % 4 AS n_prox,
  o_orderkey % 3 AS n_unc, o_orderkey % 6 = 0 AS needed, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 11) / 15.0::DOUBLE END AS meteo,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 15 = 1 END AS rayleigh, CASE WHEN o_orderkey % 6 <> 1 THEN o_orderkey % 4 = 1 END AS changed,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'CONCERN' WHEN 2 THEN 'FAIL' ELSE 'PASS' END AS sens FROM orders),
raw AS (
  SELECT id, stage, 'holdout_station_validation' AS chk, obs_peak IS NULL AS miss, CASE WHEN coalesce(arr, 0) > 5 OR abs(pred_peak - obs_peak) / obs_peak > 0.5::DOUBLE THEN 'FAIL'
    WHEN coalesce(arr, 0) > 3 OR abs(pred_peak - obs_peak) / obs_peak > 0.3::DOUBLE THEN 'CONCERN' ELSE 'PASS' END AS res FROM asm
  UNION ALL SELECT id, stage, 'sensitivity_analysis', sens IS NULL, sens FROM asm
  UNION ALL SELECT id, stage, 'posterior_stability', changed IS NULL, CASE WHEN changed THEN 'CONCERN' ELSE 'PASS' END FROM asm
  UNION ALL SELECT id, stage, 'data_coverage', n_st >= 2 AND spread IS NULL, CASE WHEN n_st < 2 THEN 'FAIL' WHEN spread < 90 THEN 'CONCERN' ELSE 'PASS' END FROM asm
  UNION ALL SELECT id, stage, 'physical_consistency', mw_seis IS NULL, CASE WHEN abs(mw_fit - mw_seis) > 0.6::DOUBLE THEN 'FAIL' WHEN abs(mw_fit - mw_seis) > 0.3::DOUBLE THEN 'CONCERN' ELSE 'PASS' END FROM asm
  UNION ALL SELECT id, stage, 'model_fit_quality', rmse IS NULL, CASE WHEN biased OR rmse > 5 THEN 'FAIL' WHEN rmse > 3 THEN 'CONCERN' ELSE 'PASS' END FROM asm
  UNION ALL SELECT id, stage, 'tidal_state_review', n_prox = 0, CASE WHEN n_unc = 0 THEN 'PASS' WHEN needed THEN 'FAIL' ELSE 'CONCERN' END FROM asm
  UNION ALL SELECT id, stage, 'meteotsunami_discriminator', meteo IS NULL, CASE WHEN meteo > 0.6::DOUBLE THEN 'FAIL' WHEN meteo > 0.3::DOUBLE THEN 'CONCERN' ELSE 'PASS' END FROM asm
  UNION ALL SELECT id, stage, 'rayleigh_wave_suspect', rayleigh IS NULL, CASE WHEN rayleigh THEN 'CONCERN' ELSE 'PASS' END FROM asm),
app AS (SELECT *, CASE WHEN stage = 'SEISMIC_ONLY' AND chk IN ('holdout_station_validation', 'sensitivity_analysis', 'data_coverage', 'model_fit_quality') THEN 'NOT_APPLICABLE'
    WHEN chk = 'physical_consistency' OR (stage <> 'SEISMIC_ONLY' AND chk IN ('data_coverage', 'model_fit_quality'))
      OR (stage = 'MULTI_STATION' AND chk = 'sensitivity_analysis') THEN 'REQUIRED' ELSE 'OPTIONAL' END AS applicability FROM raw),
checks AS (SELECT id AS assessment_id, stage, chk AS "check", applicability, CASE WHEN applicability = 'NOT_APPLICABLE' THEN 'NOT_APPLICABLE' WHEN miss THEN 'NOT_EVALUATED' ELSE res END AS result,
    CASE WHEN applicability = 'NOT_APPLICABLE' THEN 'NOT_REQUIRED' WHEN miss THEN 'MISSING' ELSE 'AVAILABLE' END AS prerequisite FROM app),
sums AS (SELECT assessment_id, bool_or(result = 'FAIL') AS f, bool_or(applicability = 'REQUIRED' AND prerequisite = 'MISSING') AS r,
    bool_or(result = 'CONCERN' OR (applicability = 'OPTIONAL' AND prerequisite = 'MISSING')) AS c,
    string_agg(CASE WHEN result = 'FAIL' THEN "check" END, '; ' ORDER BY "check") AS failed,
    string_agg(CASE WHEN applicability = 'REQUIRED' AND prerequisite = 'MISSING' THEN "check" END, '; ' ORDER BY "check") AS blocked FROM checks GROUP BY 1),
outcomes AS (SELECT assessment_id, CASE WHEN f THEN 'FAIL' WHEN r THEN 'INCOMPLETE' WHEN c THEN 'PASS_WITH_CONCERNS' ELSE 'PASS' END AS outcome, f OR r AS abstain,
    CASE WHEN f THEN 'failed: ' || failed WHEN r THEN 'without input: ' || blocked END AS abstain_reason FROM sums)"""


def checked_assessments(spark, sf_dir):
    k = F.col("o_orderkey")
    stage = F.array(F.lit("SEISMIC_ONLY"), F.lit("DART_CONSTRAINED"), F.lit("MULTI_STATION"))[(k % 3).cast("int")]
    asm = spread(table(spark, sf_dir, "orders").select("o_orderkey")).select(k.alias("assessment_id"), stage.alias("stage"), k)
    checks = [
        R.holdout_check(
            F.when(k % 7 != 0, (k % 9).cast("double")), F.when(k % 10 != 0, F.lit(1.0)), F.lit(1.0) + (k % 13) / F.lit(20.0)
        ),
        R.sensitivity_check(F.when(k % 5 == 1, "CONCERN").when(k % 5 == 2, "FAIL").when(k % 5 > 2, "PASS")),
        R.stability_check(F.when(k % 6 != 1, k % 4 == 1)),
        R.coverage_check(k % 5, F.when(k % 8 != 0, ((k * 31) % 360).cast("double"))),
        R.consistency_check(F.lit(6.0) + (k % 10) / F.lit(10.0), F.when(k % 12 != 0, F.lit(6.45))),
        R.fit_check(F.when(k % 14 != 0, (k % 60) / F.lit(10.0)), k % 50 == 0),
        R.tidal_check(k % 4, k % 3, k % 6 == 0),
        R.weather_check(F.when(k % 9 != 0, (k % 11) / F.lit(15.0))),
        R.surface_wave_check(F.when(k % 5 != 0, k % 15 == 1)),
    ]
    return V.with_checks(asm, checks)


@C.add("verification_checks", with_cte(VERIF, body='SELECT assessment_id, stage, "check", applicability, result, prerequisite FROM checks'))
def verification_checks(spark, sf_dir):
    return V.explode_checks(checked_assessments(spark, sf_dir))


@C.add("verification_outcome", with_cte(VERIF, body="SELECT * FROM outcomes"))
def verification_outcome(spark, sf_dir):
    return V.verification_outcome(checked_assessments(spark, sf_dir))


@C.add(
    "system_confidence",
    with_cte(VERIF, body="""SELECT assessment_id, round(greatest(0, least(1, (0.4::DOUBLE * CASE outcome WHEN 'PASS' THEN 1.0::DOUBLE WHEN 'PASS_WITH_CONCERNS' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END
  + 0.25::DOUBLE * least((assessment_id % 8) / 5.0::DOUBLE, 1) + 0.35::DOUBLE * CASE assessment_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0 END)
  * CASE WHEN assessment_id % 4 = 0 THEN 0.7::DOUBLE ELSE 1 END)), 6) AS confidence,
  CASE WHEN outcome = 'PASS' THEN CASE WHEN assessment_id % 3 = 0 THEN 'high' ELSE 'moderate' END
    WHEN outcome = 'PASS_WITH_CONCERNS' THEN CASE WHEN assessment_id % 3 = 0 THEN 'moderate' ELSE 'low' END END AS level FROM outcomes"""),
)
def system_confidence(spark, sf_dir):
    k = F.col("assessment_id")
    spread = F.when(k % 3 == 0, "LOW").when(k % 3 == 1, "MODERATE").otherwise("HIGH")
    return V.verification_outcome(checked_assessments(spark, sf_dir)).select(
        "assessment_id",
        F.round(R.system_confidence(F.col("outcome"), k % 8, spread, k % 4 == 0), 6).alias("confidence"),
        R.confidence_level(F.col("outcome"), spread).alias("level"),
    )


@C.add(
    "leading_set_changed",
    """WITH a AS (SELECT o_custkey AS event_id, o_orderkey AS assessment_id, CASE WHEN o_orderkey % 3 = 0 THEN [1, 2] WHEN o_orderkey % 3 = 1 THEN [2, 1, 1] ELSE [3] END AS ids FROM orders)
SELECT event_id, assessment_id, lag(s) OVER (PARTITION BY event_id ORDER BY assessment_id) <> s AS changed
FROM (SELECT *, list_sort(list_distinct(ids)) AS s FROM a)""",
)
def leading_set_changed(spark, sf_dir):
    k = F.col("o_orderkey")
    ids = F.when(k % 3 == 0, F.array(F.lit(1), F.lit(2))).when(k % 3 == 1, F.array(F.lit(2), F.lit(1), F.lit(1))).otherwise(F.array(F.lit(3)))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event_id"), k.alias("assessment_id"), ids.alias("ids"))
    return V.leading_set_changed(rows, "event_id", ["assessment_id"], "ids", F.floor(F.col("assessment_id") / 100_000).cast("long")).drop("ids")


@C.add(
    "model_bias",
    """WITH m AS (SELECT l_partkey % 50 AS event_id, l_suppkey AS station_id, avg((l_quantity - 24) / 100) AS m FROM lineitem GROUP BY 1, 2),
g AS (SELECT event_id, count(*) AS n_stations, avg(m) AS gm, stddev_samp(m) AS sd FROM m GROUP BY 1)
SELECT event_id, n_stations, round(gm, 8) AS grand_mean_m, round(CASE WHEN sd > 0 THEN abs(gm) / (sd / sqrt(n_stations)) END, 5) AS z,
  n_stations >= 2 AND abs(gm) * 100 > 1 AND (sd = 0 OR abs(gm) / (sd / sqrt(n_stations)) > 3) AS biased FROM g""",
)
def model_bias(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 50).alias("event_id"), F.col("l_suppkey").alias("station_id"), ((F.col("l_quantity") - 24) / 100).alias("residual_m")
    )
    out = V.model_bias(rows)
    return out.withColumn("grand_mean_m", F.round("grand_mean_m", 8)).withColumn("z", F.round("z", 5))


# ---- lineage

AUDIT = """audit AS (SELECT event_id AS audit_id, user_id AS event_id, event_type, epoch_us(ts) AS recorded_us, props AS data,
  CASE WHEN event_id % 4 <> 0 THEN user_id || '-' || (epoch_us(ts) // 86400000000) END AS trace_id, 'agent_' || user_id % 6 AS producer,
  user_id * 100000 + epoch_us(ts) // 86400000000 AS handoff_id FROM events)"""


def audit(spark, sf_dir):
    day = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 86400000000")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("audit_id"),
        F.col("user_id").alias("event_id"),
        "event_type",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("recorded_us"),
        F.col("props").alias("data"),
        F.when(F.col("event_id") % 4 != 0, F.concat_ws("-", F.col("user_id"), day)).alias("trace_id"),
        F.concat(F.lit("agent_"), F.col("user_id") % 6).alias("producer"),
        (F.col("user_id") * 100_000 + day).alias("handoff_id"),
    )


@C.add(
    "attach_qc",
    with_cte(FLAGS_SQL, body="""SELECT j.seq, CASE WHEN r.payload_hash IS NOT NULL THEN CASE WHEN j.seq % 3 = 2 THEN NOT j.usable ELSE j.usable END END AS usable
FROM judged j LEFT JOIN (SELECT payload_hash FROM judged WHERE seq % 10 <> 0) r USING (payload_hash)"""),
)
def attach_qc(spark, sf_dir):
    judged = flagged(spark, sf_dir)
    first = judged.where(F.col("seq") % 10 != 0).select("payload_hash", F.lit(1).alias("report_no"), "usable", "confidence", "seq")
    again = first.where(F.col("seq") % 3 == 2).withColumn("report_no", F.lit(2)).withColumn("usable", ~F.col("usable"))
    reports = first.unionByName(again).drop("seq")
    return L.attach_qc(observations(spark, sf_dir).select("seq", "payload_hash"), reports).select("seq", "usable")


CHAIN = AUDIT + """,
feat AS (SELECT audit_id AS feature_id, trace_id, handoff_id FROM audit WHERE event_type = 'purchase'),
aud AS (SELECT audit_id, recorded_us, trace_id, handoff_id,
  CASE WHEN audit_id % 7 = 0 THEN NULL WHEN audit_id % 7 = 1 THEN [] ELSE [audit_id + 1, audit_id + 2] END AS refs FROM audit WHERE event_type IN ('view', 'click')),
noted AS (SELECT f.feature_id, f.trace_id, f.handoff_id, a.audit_id, a.recorded_us, a.refs FROM feat f LEFT JOIN aud a ON f.handoff_id = a.handoff_id AND f.trace_id = a.trace_id),
hashed AS (SELECT * EXCLUDE (refs), r.ref FROM noted LEFT JOIN LATERAL (SELECT unnest(refs) AS ref) r ON true)"""


@C.add(
    "provenance_chain",
    with_cte(CHAIN, OBS, body="""SELECT feature_id, raw_id, recorded_us, audit_id, trace_id, handoff_id, station_id FROM (
  SELECT h.*, o.seq AS raw_id, o.station_id FROM hashed h LEFT JOIN (SELECT * FROM obs WHERE seq % 10 <> 0) o ON o.seq = h.ref)
QUALIFY row_number() OVER (PARTITION BY feature_id, raw_id ORDER BY recorded_us DESC NULLS LAST, audit_id DESC) = 1"""),
)
def provenance_chain(spark, sf_dir):
    log = audit(spark, sf_dir)
    obs = observations(spark, sf_dir)
    features = log.where(F.col("event_type") == "purchase").select(F.col("audit_id").alias("feature_id"), "trace_id", "handoff_id")
    k = F.col("audit_id")
    hash_of = obs.select(F.col("seq").alias("ref"), "payload_hash")
    noted = log.where(F.col("event_type").isin("view", "click")).select(
        k, "recorded_us", "trace_id", "handoff_id",
        F.when(k % 7 == 1, F.array().cast("array<long>")).when(k % 7 != 0, F.array(k + 1, k + 2)).alias("refs"),
    )
    named = noted.withColumn("ref", F.explode_outer("refs")).join(hash_of, "ref", "left").groupBy(
        "audit_id", "recorded_us", "trace_id", "handoff_id"
    ).agg(F.collect_list(F.when(F.col("ref").isNotNull(), F.coalesce("payload_hash", F.lit("unknown")))).alias("input_hashes"))
    raw = obs.where(F.col("seq") % 10 != 0).select("payload_hash", F.col("seq").alias("raw_id"), "station_id")
    return L.provenance_chain(features, named, raw)


@C.add(
    "query_audit",
    with_cte(AUDIT, body="SELECT audit_id, event_id, recorded_us, trace_id FROM audit WHERE event_type = 'click' AND producer = 'agent_2'"),
)
def query_audit(spark, sf_dir):
    return L.query_audit(audit(spark, sf_dir), event_type="click", producer="agent_2").select("audit_id", "event_id", "recorded_us", "trace_id")


@C.add("audit_page", with_cte(AUDIT, body="SELECT audit_id, recorded_us, event_type FROM audit ORDER BY recorded_us DESC, audit_id DESC LIMIT 50 OFFSET 100"))
def audit_page(spark, sf_dir):
    return L.audit_page(audit(spark, sf_dir).select("audit_id", "recorded_us", "event_type"), 50, 100)


@C.add("audit_count", with_cte(AUDIT, body="SELECT count(*) AS n FROM audit WHERE producer = 'agent_2'"))
def audit_count(spark, sf_dir):
    return L.query_audit(audit(spark, sf_dir), producer="agent_2").agg(F.count(F.lit(1)).alias("n"))


@C.add(
    "activity_report",
    with_cte(AUDIT, body="""SELECT event_id, event_type, count(*) AS n_entries, CAST(sum(CAST(data->>'$.k' AS BIGINT)) AS BIGINT) AS total_k,
  count(*) FILTER (CAST(data->>'$.k' AS BIGINT) >= 50) AS n_high FROM audit GROUP BY 1, 2"""),
)
def activity_report(spark, sf_dir):
    return L.activity_report(audit(spark, sf_dir), "event_id")


@C.add(
    "lineage_by_event",
    with_cte(AUDIT, body="""SELECT event_id, coalesce(trace_id, '__no_trace__') AS trace, audit_id, event_type,
  row_number() OVER (PARTITION BY event_id ORDER BY recorded_us, audit_id) AS event_position, count(*) OVER (PARTITION BY event_id) AS total_entries,
  row_number() OVER (PARTITION BY event_id, coalesce(trace_id, '__no_trace__') ORDER BY recorded_us, audit_id) AS position,
  count(*) OVER (PARTITION BY event_id, coalesce(trace_id, '__no_trace__')) AS entry_count FROM audit"""),
)
def lineage_by_event(spark, sf_dir):
    out = L.lineage_by_event(audit(spark, sf_dir), time_bucket("recorded_us", 3_600))
    return out.select("event_id", "trace", "audit_id", "event_type", "event_position", "total_entries", "position", "entry_count")


MESSAGES = """msg AS (SELECT event_type AS topic, CAST(user_id % 4 AS INT) AS "partition", event_id AS "offset", event_id % 10 = 3 AS rejected, epoch_us(ts) // 86400000000 AS day FROM events),
rng AS (SELECT day, topic, "partition", min("offset") AS first_offset, max("offset") AS last_offset FROM msg GROUP BY 1, 2, 3)"""


def messages(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        (F.col("event_id") % 10 == 3).alias("rejected"),
        F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 86400000000").alias("day"),
    )


@C.add("offset_ranges", with_cte(MESSAGES, body="SELECT * FROM rng"))
def offset_ranges(spark, sf_dir):
    return L.offset_ranges(messages(spark, sf_dir), "day")


@C.add(
    "checkpoint_id",
    with_cte(MESSAGES, body="""SELECT day, sha256('workers|[' || r.j || ']|[' || coalesce(b.j, '') || ']') AS checkpoint_id FROM (
  SELECT day, string_agg('{"topic":"' || topic || '","partition":' || "partition" || ',"first_offset":' || first_offset || ',"last_offset":' || last_offset || '}', ',' ORDER BY topic, "partition") AS j FROM rng GROUP BY 1) r
LEFT JOIN (SELECT day, string_agg('{"topic":"' || topic || '","partition":' || "partition" || ',"block":' || block || ',"digest":"' || d || '"}', ',' ORDER BY topic, "partition", block) AS j FROM (
  SELECT day, topic, "partition", "offset" // 10000 AS block, sha256(string_agg("offset", ',' ORDER BY "offset")) AS d FROM msg WHERE rejected GROUP BY 1, 2, 3, 4) GROUP BY 1) b USING (day)"""),
)
def checkpoint_id(spark, sf_dir):
    return L.checkpoint_id(messages(spark, sf_dir), "day", "workers")


@C.add(
    "policy_audit",
    """WITH req AS (SELECT event_id AS request_id, user_id % 7 AS agent, event_type AS capability, event_id % 3 = 0 AS human,
  ['IDLE', 'MONITOR', 'ASSESS', 'ESCALATE'][CAST(event_id % 4 AS INT) + 1] AS state FROM events),
mat AS (SELECT DISTINCT s_suppkey % 5 AS agent, ['view', 'click', 'error', 'purchase', 'signup'][s_nationkey % 5 + 1] AS capability FROM supplier)
SELECT request_id, CASE WHEN agent NOT IN (SELECT agent FROM mat) THEN 'AGENT_NOT_REGISTERED'
  WHEN NOT EXISTS (SELECT 1 FROM mat m WHERE m.agent = req.agent AND m.capability = req.capability) THEN 'CAPABILITY_NOT_ALLOWED'
  WHEN capability IN ('purchase', 'signup') AND state IN ('ASSESS', 'ESCALATE') AND NOT human THEN 'HUMAN_APPROVAL_REQUIRED' ELSE 'ALLOWED' END AS verdict FROM req""",
)
def policy_audit(spark, sf_dir):
    k = F.col("event_id")
    states = F.array(*[F.lit(s) for s in ("IDLE", "MONITOR", "ASSESS", "ESCALATE")])
    requests = table(spark, sf_dir, "events").select(
        k.alias("request_id"), (F.col("user_id") % 7).alias("agent"), F.col("event_type").alias("capability"),
        (k % 3 == 0).alias("human_decision"), states[(k % 4).cast("int")].alias("state"),
    )
    kinds = F.array(*[F.lit(s) for s in ("view", "click", "error", "purchase", "signup")])
    matrix = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5).alias("agent"), kinds[F.col("s_nationkey") % 5].alias("capability"))
    return L.policy_audit(requests, matrix, matrix, ["purchase", "signup"], ["ASSESS", "ESCALATE"]).select("request_id", "verdict")


@C.add(
    "packet_of_record",
    """SELECT o_custkey AS event_id, o_orderkey // 3 AS assessment_id, o_orderkey % 3 AS renderer, o_orderkey AS packet_id FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey // 3, o_orderkey % 3 DESC) = 1""",
)
def packet_of_record(spark, sf_dir):
    k = F.col("o_orderkey")
    packets = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("event_id"), F.floor(k / 3).cast("long").alias("assessment_id"), (k % 3).alias("renderer"), k.alias("packet_id")
    )
    assessed = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("event_id"))
    return L.packet_of_record(packets, assessed)


@C.add(
    "latest_per_key",
    """SELECT o_custkey AS event_id, epoch_us(o_orderdate) AS produced_us, o_orderkey AS assessment_id, o_orderstatus AS status FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("event_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("produced_us"),
        F.col("o_orderkey").alias("assessment_id"), F.col("o_orderstatus").alias("status"),
    )
    return J.latest_by(rows, ["event_id"], ["produced_us", "assessment_id"], ["status"])


@C.add(
    "event_provenance",
    with_cte(OBS, body="""SELECT event_id, payload_hash, first_us, rank, n_hashes FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY first_us, payload_hash) AS rank, count(*) OVER (PARTITION BY event_id) AS n_hashes FROM (
    SELECT seq % 5 AS event_id, payload_hash, min(ts_us) AS first_us FROM obs GROUP BY 1, 2))"""),
)
def event_provenance(spark, sf_dir):
    bound = observations(spark, sf_dir).select((F.col("seq") % 5).alias("event_id"), "payload_hash", "ts_us")
    return L.event_provenance(bound).select("event_id", "payload_hash", "first_us", "rank", "n_hashes")


@C.add(
    "similar_events",
    with_cte(QUAKES, body="""SELECT event_id, CAST(rank - 1 AS BIGINT) AS rank, n_name AS name, d AS difference FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, n_nationkey) AS rank FROM (
    SELECT q.event_id, n.n_name, n.n_nationkey, round(abs(7.0::DOUBLE + (n.n_nationkey * 7 % 25) / 10.0::DOUBLE - q.magnitude), 9) AS d
    FROM quakes q CROSS JOIN nation n WHERE q.magnitude >= 6.0)) WHERE rank <= 3"""),
)
def similar_events(spark, sf_dir):
    k = F.col("n_nationkey")
    history = table(spark, sf_dir, "nation").select(
        k.alias("position"), F.col("n_name").alias("name"), (F.lit(7.0) + (k * 7 % 25) / F.lit(10.0)).alias("mw")
    )
    out = L.similar_events(quakes(spark, sf_dir).where(F.col("magnitude") >= 6.0), history)
    return out.withColumn("rank", F.col("rank").cast("long"))
