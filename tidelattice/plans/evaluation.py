"""Alert machine, evaluation and operations queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import reached_tier, threshold_score as threshold_map
from ..operators import alerts as A
from ..operators import evaluate as E
from ..operators import joins as J
from ..operators import series as S
from ..operators.partitioned import ranked_percentiles, exact_percentiles, time_bucket, with_previous
from ..session import cut_lineage
from . import Catalog
from .adapters import OBS, SCORES, SERIES, ZQUAKES, observations, scores, series, table, with_cte, zoned_quakes

C = Catalog()


def rounded(df, *names, digits=6):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


FALSE_SQL = """rep AS (SELECT source_type, station_id, count(*) AS n_windows, count(*) FILTER (score >= 0.35) AS triggers_t1,
  count(*) FILTER (score >= 0.60) AS triggers_t2, count(*) FILTER (score >= 0.85) AS triggers_t3,
  (max(ts_us) - min(ts_us)) / (86400000000.0::DOUBLE * 30) AS months, max(score) AS max_score, avg(score) AS mean_score,
  stddev_pop(score) AS std_score, quantile_cont(score, 0.95) AS p95_score, quantile_cont(score, 0.99) AS p99_score FROM scores GROUP BY 1, 2)"""


@C.add(
    "false_trigger_report",
    with_cte(SCORES, FALSE_SQL, body="""SELECT source_type, station_id, n_windows, triggers_t1, triggers_t2, triggers_t3, max_score,
  round(mean_score, 10) AS mean_score, round(std_score, 6) AS std_score, round(p95_score, 6) AS p95_score, round(p99_score, 6) AS p99_score,
  round(CASE WHEN months > 0 THEN triggers_t1 / months ELSE 0 END, 4) AS t1_per_month,
  round(CASE WHEN months > 0 THEN triggers_t2 / months ELSE 0 END, 4) AS t2_per_month FROM rep"""),
)
def false_trigger_report(spark, sf_dir):
    out = E.false_trigger_report(scores(spark, sf_dir), ["source_type", "station_id"])
    out = rounded(rounded(out, "mean_score", digits=10), "std_score", "p95_score", "p99_score")
    return rounded(out, "t1_per_month", "t2_per_month", digits=4)


@C.add(
    "false_trigger_totals",
    with_cte(SCORES, body="""SELECT count(*) AS n_windows, count(*) FILTER (score >= 0.35) AS triggers_t1,
  count(*) FILTER (score >= 0.60) AS triggers_t2, count(*) FILTER (score >= 0.85) AS triggers_t3, max(score) AS max_score FROM scores"""),
)
def false_trigger_totals(spark, sf_dir):
    return E.false_trigger_totals(E.false_trigger_report(scores(spark, sf_dir), ["source_type", "station_id"]))


ABLATION_SQL = """cfg AS (SELECT * FROM (VALUES ('full_ensemble', 0.5::DOUBLE, 0.35::DOUBLE, 0.15::DOUBLE), ('threshold_only', 1, 0, 0),
  ('statistical_only', 0, 1, 0), ('threshold_statistical', 0.588::DOUBLE, 0.412::DOUBLE, 0), ('equal_weights', 1, 1, 1)) v(config, a, b, c)),
re AS (SELECT config, station_id, minutes, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN ml_score IS NULL
    THEN (a * threshold_score + b * greatest(wavelet_score, bocpd_score)) / (a + b)
    ELSE a * threshold_score + b * greatest(wavelet_score, bocpd_score) + c * ml_score END)) AS e FROM scores CROSS JOIN cfg)"""


@C.add(
    "ablation",
    with_cte(SCORES, ABLATION_SQL, body="""SELECT config, station_id, count(*) AS n_windows, count(*) FILTER (e >= 0.35) AS crosses_t1,
  count(*) FILTER (e >= 0.60) AS crosses_t2, count(*) FILTER (e >= 0.85) AS crosses_t3,
  round(min(CASE WHEN minutes >= 0 AND e >= 0.35 THEN minutes END), 4) AS first_t1_min,
  round(min(CASE WHEN minutes >= 0 AND e >= 0.60 THEN minutes END), 4) AS first_t2_min,
  round(min(CASE WHEN minutes >= 0 AND e >= 0.85 THEN minutes END), 4) AS first_t3_min FROM re GROUP BY 1, 2"""),
)
def ablation(spark, sf_dir):
    return rounded(E.ablation(scores(spark, sf_dir)), "first_t1_min", "first_t2_min", "first_t3_min", digits=4)


@C.add(
    "threshold_sweep",
    with_cte(SCORES, body="""SELECT t1, count(*) FILTER (top >= t1) AS stations_crossing, round(min(f), 4) AS earliest_min, round(max(f), 4) AS latest_min FROM (
  SELECT t1, station_id, max(score) AS top, min(CASE WHEN minutes >= 0 AND score >= t1 THEN minutes END) AS f
  FROM scores CROSS JOIN (VALUES (0.25::DOUBLE), (0.30), (0.35), (0.40), (0.45), (0.99)) v(t1) GROUP BY 1, 2) GROUP BY 1"""),
)
def threshold_sweep(spark, sf_dir):
    out = E.threshold_sweep(scores(spark, sf_dir), [0.25, 0.30, 0.35, 0.40, 0.45, 0.99])
    return rounded(out, "earliest_min", "latest_min", digits=4)


@C.add(
    "first_crossing",
    with_cte(SCORES, body="""SELECT station_id, round(min(CASE WHEN minutes >= 0 AND score >= 0.35 THEN minutes END), 4) AS first_t1_min,
  round(min(CASE WHEN minutes >= 0 AND score >= 0.60 THEN minutes END), 4) AS first_t2_min,
  round(min(CASE WHEN minutes >= 0 AND score >= 0.85 THEN minutes END), 4) AS first_t3_min FROM scores GROUP BY 1"""),
)
def first_crossing(spark, sf_dir):
    return rounded(E.first_crossing(scores(spark, sf_dir), ["station_id"]), "first_t1_min", "first_t2_min", "first_t3_min", digits=4)


PERIODS = (5, 10, 20, 30, 60, 90, 120)
RUNS = SCORES + """,
runs AS (SELECT window_id % 10 + 1 AS amplitude, [5, 10, 20, 30, 60, 90, 120][CAST(window_id // 10 % 7 AS INT) + 1] AS period,
  CASE WHEN window_id // 70 % 2 = 0 THEN 15 ELSE 60 END AS sampling_sec, score FROM scores)"""


def runs(spark, sf_dir):
    k = F.col("window_id")
    return scores(spark, sf_dir).select(
        (k % 10 + 1).alias("amplitude"),
        F.array(*[F.lit(p) for p in PERIODS])[(F.floor(k / 10) % 7).cast("int")].alias("period"),
        F.when(F.floor(k / 70) % 2 == 0, 15).otherwise(60).alias("sampling_sec"),
        "score",
    )


@C.add(
    "sensitivity_grid",
    with_cte(RUNS, body="SELECT amplitude, " + ", ".join(
        f"CASE WHEN max(score) FILTER (period = {p}) >= 0.85 THEN 'ESCALATE' WHEN max(score) FILTER (period = {p}) >= 0.60 THEN 'ASSESS' "
        f"WHEN max(score) FILTER (period = {p}) >= 0.35 THEN 'INVESTIGATE' WHEN max(score) FILTER (period = {p}) IS NOT NULL THEN 'MONITOR' END AS p{p}"
        for p in PERIODS) + " FROM runs GROUP BY 1"),
)
def sensitivity_grid(spark, sf_dir):
    return E.sensitivity_grid(runs(spark, sf_dir), PERIODS)


@C.add(
    "least_detectable",
    with_cte(RUNS, body="""SELECT period, min(CASE WHEN top >= 0.35 THEN amplitude END) AS least_amplitude FROM (
  SELECT period, amplitude, max(score) AS top FROM runs GROUP BY 1, 2) GROUP BY 1"""),
)
def least_detectable(spark, sf_dir):
    return E.least_detectable(runs(spark, sf_dir))


@C.add(
    "detection_rates",
    with_cte(RUNS, body="""SELECT sampling_sec, count(*) AS n_runs, round(avg((score >= 0.35)::INT), 6) AS rate_t1,
  round(avg((score >= 0.60)::INT), 6) AS rate_t2, round(avg((score >= 0.85)::INT), 6) AS rate_t3 FROM runs GROUP BY 1"""),
)
def detection_rates(spark, sf_dir):
    return rounded(E.detection_rates(runs(spark, sf_dir), "sampling_sec"), "rate_t1", "rate_t2", "rate_t3")


@C.add(
    "duplicate_sensitivity",
    with_cte(SERIES, body="""SELECT station_id, round(max(s) FILTER (policy = 'first'), 6) AS base_score,
  round(greatest(max(s) - max(s) FILTER (policy = 'first'), max(s) FILTER (policy = 'first') - min(s)), 6) AS max_abs_delta,
  count(DISTINCT tier) > 1 AS tier_flip FROM (
  SELECT *, CASE WHEN s >= 0.85 THEN 'ESCALATE' WHEN s >= 0.60 THEN 'ASSESS' WHEN s >= 0.35 THEN 'INVESTIGATE' ELSE 'MONITOR' END AS tier FROM (
    SELECT station_id, year, policy, CASE WHEN max(v) / 65000.0::DOUBLE <= 1 THEN 0 ELSE least(1.0::DOUBLE, max(v) / 65000.0::DOUBLE - 1) END AS s FROM (
      UNPIVOT (SELECT station_id, ts_us, ts_us // 31536000000000 AS year, min_by(value, seq) AS first, max_by(value, seq) AS last,
        min(value) AS min, max(value) AS max, avg(value) AS mean FROM series GROUP BY 1, 2, 3)
      ON first, last, min, max, mean INTO NAME policy VALUE v) GROUP BY 1, 2, 3)) GROUP BY 1"""),
)
def duplicate_sensitivity(spark, sf_dir):
    wide = S.dedup_policies(series(spark, sf_dir), ["station_id"]).withColumn("year", F.expr("ts_us div 31536000000000"))
    names = ("first", "last", "min", "max", "mean")
    long = wide.select(
        "station_id", "year", F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), F.col(n).alias("v")) for n in names])).alias("p")
    )
    peaks = long.groupBy("station_id", "year", F.col("p.policy").alias("policy")).agg(F.max("p.v").alias("peak"))
    scored = peaks.withColumn("score", threshold_map(F.col("peak"), F.lit(65_000.0), F.lit(False)))
    out = E.duplicate_sensitivity(scored.withColumn("tier", reached_tier(F.col("score"))), ["station_id"])
    return rounded(out, "base_score", "max_abs_delta")


@C.add(
    "ops_metrics",
    """SELECT span, epoch_us(ts) - epoch_us(ts) % w AS start_us, event_type, count(*) AS n FROM events
CROSS JOIN (VALUES ('5m', 300000000), ('1h', 3600000000), ('24h', 86400000000)) s(span, w) GROUP BY ALL""",
)
def ops_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.windowed_counts(rows, "event_type", "ts")


@C.add(
    "ops_latency",
    "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
)
def ops_latency(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    return rounded(exact_percentiles(rows, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}), "p50", "p95")


@C.add(
    "latency_profile",
    """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median_ms,
  list_sort(list(value))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95_ms,
  list_sort(list(value))[CAST(floor(count(*) * 0.99::DOUBLE) AS BIGINT) + 1] AS p99_ms, max(value) AS max_ms FROM events GROUP BY 1""",
)
def latency_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    ranks = ranked_percentiles(rows, ["event_type"], "value", {"p95_ms": 0.95, "p99_ms": 0.99}, zero_based=True)
    middle = exact_percentiles(rows, ["event_type"], "value", {"median_ms": 0.5})
    top = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_ms"))
    return rounded(top.join(ranks, "event_type").join(middle, "event_type"), "median_ms")


def tier_changes(spark, sf_dir):
    """State changes per station: rows whose tier differs from the one before."""
    rows = scores(spark, sf_dir).select(
        "station_id", "ts_us", F.col("window_id").alias("step"), "score", reached_tier(F.col("score")).alias("to_state")
    )
    stepped = with_previous(rows, ["station_id"], ["ts_us", "step"], ["to_state"], time_bucket("ts_us", 86_400))
    before = F.col("prev")["to_state"]
    return stepped.where(before.isNull() | (before != F.col("to_state"))).select(
        "station_id", "ts_us", "step", "score", before.alias("from_state"), "to_state"
    )


CHANGES = SCORES + """,
tiers AS (SELECT station_id, ts_us, window_id AS step, score, CASE WHEN score >= 0.85 THEN 'ESCALATE' WHEN score >= 0.60 THEN 'ASSESS'
  WHEN score >= 0.35 THEN 'INVESTIGATE' ELSE 'MONITOR' END AS to_state FROM scores),
lagged AS (SELECT *, lag(to_state) OVER (PARTITION BY station_id ORDER BY ts_us, step) AS from_state FROM tiers),
changes AS (SELECT * FROM lagged WHERE from_state IS NULL OR from_state <> to_state)"""


@C.add("event_timeline", with_cte(CHANGES, body="SELECT station_id, ts_us, step, score, from_state, to_state FROM changes"))
def event_timeline(spark, sf_dir):
    return tier_changes(spark, sf_dir)


@C.add(
    "dwell_times",
    with_cte(CHANGES, body="""SELECT station_id, ts_us, to_state,
  round((lead(ts_us) OVER (PARTITION BY station_id ORDER BY ts_us, step) - ts_us) / 1000000.0::DOUBLE, 6) AS dwell_sec FROM changes"""),
)
def dwell_times(spark, sf_dir):
    out = E.dwell_times(tier_changes(spark, sf_dir), ["station_id"])
    return rounded(out.select("station_id", "ts_us", "to_state", "dwell_sec"), "dwell_sec")


@C.add(
    "best_station",
    with_cte(SCORES, body="""SELECT basin, ts_us // 3600000000 AS hour, source_type, station_id, score FROM scores
QUALIFY row_number() OVER (PARTITION BY basin, ts_us // 3600000000 ORDER BY score DESC, source_type, station_id) = 1"""),
)
def best_station(spark, sf_dir):
    out = scores(spark, sf_dir).groupBy("basin", F.expr("ts_us div 3600000000").alias("hour")).agg(A.best_station().alias("b"))
    return out.select("basin", "hour", "b.source_type", "b.station_id", (-F.col("b.neg_score")).alias("score"))


def basin_scores(spark, sf_dir):
    return scores(spark, sf_dir).withColumn("event_mode", F.col("window_id") % 97 == 0)


def basin_quakes(spark, sf_dir):
    return zoned_quakes(spark, sf_dir).withColumn("basin", F.col("event_id") % 5)


def alert_log(spark, sf_dir):
    """Triggers, best scores and the decisions that end escalations."""
    big = basin_quakes(spark, sf_dir)
    decisions = big.where(F.col("event_id") % 40 < 5).select("basin", (F.col("origin_us") + 1_000_000).alias("ts_us"))
    return A.machine_input(basin_scores(spark, sf_dir), big, decisions)


def transitions(spark, sf_dir):
    return A.replay(alert_log(spark, sf_dir))


# The machine as a recursion over the numbered log of each basin: time out what ended before
# this tick (e), take the row (t: trigger, decision or evidence), time out after evidence (x).
MACHINE_SQL = f"""WITH RECURSIVE {SCORES}, {ZQUAKES},
log AS (
  SELECT event_id % 5 AS basin, origin_us // 60000000 AS tick, 0 AS rank, origin_us AS ts_us, event_id, magnitude, depth_km, NULL::DOUBLE AS score, NULL::BIGINT AS mode_us
  FROM zquakes WHERE magnitude >= 6.0 AND zone <> 'unknown'
  UNION ALL SELECT basin, ts_us // 60000000, 1, max(ts_us), NULL, NULL, NULL, max(score), max(ts_us) FILTER (window_id % 97 = 0)
  FROM scores WHERE score BETWEEN 0 AND 1 GROUP BY 1, 2
  UNION ALL SELECT event_id % 5, (origin_us + 1000000) // 60000000, 2, origin_us + 1000000, NULL, NULL, NULL, NULL, NULL FROM zquakes WHERE event_id % 40 < 5),
num AS (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY tick, rank, ts_us, event_id NULLS LAST) AS rn FROM log),
m AS (
  SELECT DISTINCT basin, 0::BIGINT AS rn, 'IDLE' AS state, -1::BIGINT AS event, 0.0::DOUBLE AS mag, 0::BIGINT AS trig, false AS conf, 0.0::DOUBLE AS held,
    []::STRUCT(ts_us BIGINT, event_id BIGINT, from_state VARCHAR, to_state VARCHAR, score DOUBLE, reason VARCHAR)[] AS moves FROM num
  UNION ALL
  SELECT basin, rn, CASE WHEN x THEN 'IDLE' ELSE state3 END, CASE WHEN x THEN -1 ELSE event3 END, CASE WHEN x THEN 0 ELSE mag3 END, trig3,
    CASE WHEN x THEN false ELSE conf3 END, CASE WHEN x THEN 0 ELSE held3 END,
    list_concat(moves3, CASE WHEN x THEN [{{'ts_us': ts_us, 'event_id': event3, 'from_state': 'MONITOR', 'to_state': 'IDLE', 'score': held3, 'reason': 'monitor timeout'}}] ELSE [] END)
  FROM (SELECT *, rank = 1 AND state3 = 'MONITOR' AND state2 <> 'IDLE' AND held3 < 0.35 AND ts_us >= trig3 + 43200000000 AS x FROM (
    SELECT *,
      CASE WHEN t = 'open' THEN CASE WHEN magnitude >= 7.5 AND depth_km < 100 THEN 'ESCALATE' ELSE 'MONITOR' END WHEN t = 'close' THEN 'IDLE'
        WHEN t IN ('rise', 'override') THEN CASE state2 WHEN 'MONITOR' THEN 'INVESTIGATE' WHEN 'INVESTIGATE' THEN 'ASSESS' ELSE 'ESCALATE' END
        WHEN t = 'fall' THEN CASE state2 WHEN 'ASSESS' THEN 'INVESTIGATE' ELSE 'MONITOR' END ELSE state2 END AS state3,
      CASE t WHEN 'open' THEN event_id WHEN 'close' THEN -1 ELSE event2 END AS event3, CASE t WHEN 'open' THEN magnitude WHEN 'close' THEN 0 ELSE mag2 END AS mag3,
      CASE t WHEN 'open' THEN ts_us ELSE trig END AS trig3, CASE WHEN t IN ('open', 'close') THEN false ELSE conf_now END AS conf3,
      CASE WHEN t IN ('open', 'close') THEN 0 WHEN rank = 1 AND state2 <> 'IDLE' THEN score ELSE held2 END AS held3,
      list_concat(moves2, CASE
        WHEN t = 'open' AND magnitude >= 7.5 AND depth_km < 100 THEN [
          {{'ts_us': ts_us, 'event_id': event_id, 'from_state': 'IDLE', 'to_state': 'MONITOR', 'score': NULL::DOUBLE, 'reason': 'seismic trigger'}},
          {{'ts_us': ts_us, 'event_id': event_id, 'from_state': 'MONITOR', 'to_state': 'ESCALATE', 'score': NULL::DOUBLE, 'reason': 'seismic-only escalation'}}]
        WHEN t = 'open' THEN [{{'ts_us': ts_us, 'event_id': event_id, 'from_state': 'IDLE', 'to_state': 'MONITOR', 'score': NULL::DOUBLE, 'reason': 'seismic trigger'}}]
        WHEN t = 'close' THEN [{{'ts_us': ts_us, 'event_id': event2, 'from_state': 'ESCALATE', 'to_state': 'IDLE', 'score': NULL::DOUBLE, 'reason': 'resolved'}}]
        WHEN t IN ('rise', 'override', 'fall') THEN [{{'ts_us': ts_us, 'event_id': event2, 'from_state': state2,
          'to_state': CASE WHEN t = 'fall' THEN CASE state2 WHEN 'ASSESS' THEN 'INVESTIGATE' ELSE 'MONITOR' END
            ELSE CASE state2 WHEN 'MONITOR' THEN 'INVESTIGATE' WHEN 'INVESTIGATE' THEN 'ASSESS' ELSE 'ESCALATE' END END,
          'score': score, 'reason': CASE t WHEN 'rise' THEN 'score reached threshold' WHEN 'override' THEN 'seismic override' ELSE 'score fell below threshold' END}}]
        ELSE [] END) AS moves3
    FROM (SELECT *, CASE WHEN rank = 0 AND state2 = 'IDLE' THEN 'open' WHEN rank = 2 AND state2 = 'ESCALATE' THEN 'close'
        WHEN rank = 1 AND state2 IN ('MONITOR', 'INVESTIGATE', 'ASSESS') THEN CASE
          WHEN score >= CASE state2 WHEN 'MONITOR' THEN 0.35 WHEN 'INVESTIGATE' THEN 0.60 ELSE 0.85 END THEN 'rise'
          WHEN mag2 >= 7.5 AND conf_now THEN 'override'
          WHEN state2 = 'INVESTIGATE' AND score < 0.35 OR state2 = 'ASSESS' AND score < 0.60 THEN 'fall' ELSE 'stay' END ELSE 'stay' END AS t
      FROM (SELECT *, CASE WHEN rank = 1 AND state2 <> 'IDLE' THEN conf2 OR coalesce(mode_us >= trig, false) ELSE conf2 END AS conf_now
        FROM (SELECT *, CASE WHEN e THEN 'IDLE' ELSE state END AS state2, CASE WHEN e THEN -1 ELSE event END AS event2, CASE WHEN e THEN 0 ELSE mag END AS mag2,
          CASE WHEN e THEN false ELSE conf END AS conf2, CASE WHEN e THEN 0 ELSE held END AS held2,
          CASE WHEN e THEN [{{'ts_us': trig + 43200000000, 'event_id': event, 'from_state': 'MONITOR', 'to_state': 'IDLE', 'score': held, 'reason': 'monitor timeout'}}] ELSE [] END AS moves2
          FROM (SELECT m.basin, n.rn, m.state, m.event, m.mag, m.trig, m.conf, m.held, n.tick, n.rank, n.ts_us, n.event_id, n.magnitude, n.depth_km, n.score, n.mode_us,
              m.state = 'MONITOR' AND m.held < 0.35 AND (m.trig + 43200000000) // 60000000 < n.tick AS e
            FROM m JOIN num n ON n.basin = m.basin AND n.rn = m.rn + 1)))))))
SELECT basin, row_number() OVER (PARTITION BY basin ORDER BY rn, i) - 1 AS step, mv.ts_us AS ts_us, mv.event_id AS event_id, mv.from_state AS from_state,
  mv.to_state AS to_state, mv.score AS score, mv.reason AS reason
FROM (SELECT basin, rn, unnest(moves) AS mv, generate_subscripts(moves, 1) AS i FROM m)"""


@C.add("alert_state_machine", MACHINE_SQL)
def alert_state_machine(spark, sf_dir):
    return transitions(spark, sf_dir)


@C.add(
    "confirmation_latch",
    with_cte(SCORES, ZQUAKES, body="""SELECT event_id, station_id, confirmed_us, row_number() OVER (PARTITION BY event_id ORDER BY confirmed_us, station_id) AS n_stations FROM (
  SELECT t.event_id, s.station_id, min(s.ts_us) AS confirmed_us FROM scores s ASOF JOIN (
    SELECT event_id % 5 AS basin, origin_us AS trigger_us, max(event_id) AS event_id FROM zquakes WHERE magnitude >= 6.0 AND zone <> 'unknown' GROUP BY 1, 2) t
    ON s.basin = t.basin AND s.ts_us >= t.trigger_us WHERE s.ts_us < t.trigger_us + 43200000000 AND s.window_id % 7 = 0 GROUP BY 1, 2)"""),
)
def confirmation_latch(spark, sf_dir):
    rows = scores(spark, sf_dir).select("basin", "ts_us", "station_id", "window_id", (F.col("window_id") % 7 == 0).alias("event_mode"))
    marks = basin_quakes(spark, sf_dir).where((F.col("magnitude") >= 6.0) & (F.col("zone") != "unknown")).select(
        "basin", F.col("origin_us").alias("trigger_us"), "event_id"
    )
    bound = J.bind_to_event(rows, marks, ["basin"], 43_200_000_000, ["window_id"], 3_600_000_000)
    out = A.confirmation_timeline(bound)
    return out.withColumn("n_stations", F.col("n_stations").cast("long"))


@C.add(
    "escalations",
    f"""WITH {OBS}, {SCORES}, moved AS ({MACHINE_SQL}),
steps AS (SELECT basin, event_id, count(*) AS n_steps, min(ts_us) FILTER (to_state = 'ESCALATE') AS escalated_us,
  string_agg('{{"step":' || step || ',"from_state":"' || from_state || '","to_state":"' || to_state || '","ts_us":' || ts_us || '}}', ',' ORDER BY step) AS timeline
  FROM moved GROUP BY 1, 2),
best AS (SELECT basin, ts_us // 60000000 AS tick, source_type, station_id FROM scores
  QUALIFY row_number() OVER (PARTITION BY basin, ts_us // 60000000 ORDER BY score DESC, source_type, station_id) = 1),
bound AS (SELECT t.event_id, o.payload_hash FROM (SELECT *, seq % 5 AS basin FROM obs) o ASOF JOIN (
  SELECT basin, ts_us AS trigger_us, max(event_id) AS event_id FROM moved WHERE from_state = 'IDLE' GROUP BY 1, 2) t
  ON o.basin = t.basin AND o.ts_us >= t.trigger_us WHERE o.ts_us < t.trigger_us + 43200000000),
refs AS (SELECT event_id, count(DISTINCT payload_hash) AS n_refs FROM bound GROUP BY 1)
SELECT s.basin, s.event_id, s.escalated_us, s.n_steps, b.source_type, b.station_id, r.n_refs,
  sha256('{{"event_id":' || s.event_id || ',"escalated_us":' || s.escalated_us || ',"timeline":[' || s.timeline || ']}}') AS packet_hash
FROM steps s LEFT JOIN best b ON b.basin = s.basin AND b.tick = s.escalated_us // 60000000 LEFT JOIN refs r ON r.event_id = s.event_id
WHERE s.escalated_us IS NOT NULL""",
)
def escalations(spark, sf_dir):
    moved = cut_lineage(transitions(spark, sf_dir))
    obs = observations(spark, sf_dir).select("ts_us", "seq", "payload_hash", (F.col("seq") % 5).alias("basin"))
    marks = moved.where(F.col("from_state") == "IDLE").select("basin", F.col("ts_us").alias("trigger_us"), "event_id")
    bound = J.bind_to_event(obs, marks, ["basin"], 43_200_000_000, ["seq"], 3_600_000_000)
    refs = bound.where(F.col("event_id").isNotNull()).select("event_id", F.lit(1).alias("source_rank"), "payload_hash")
    return A.escalations(moved, basin_scores(spark, sf_dir), refs).select(
        "basin", "event_id", "escalated_us", F.size("timeline").cast("long").alias("n_steps"), "best.source_type", "best.station_id",
        "n_refs", "packet_hash",
    )


@C.add(
    "online_offline",
    with_cte(SCORES, body="""SELECT station_id, station_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AS online FROM (SELECT DISTINCT station_id FROM scores)"""),
)
def online_offline(spark, sf_dir):
    down = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("station_id"))
    stations = scores(spark, sf_dir).select("station_id").distinct()
    on = stations.join(down, "station_id", "left_anti").withColumn("online", F.lit(True))
    return on.unionByName(stations.join(down, "station_id", "left_semi").withColumn("online", F.lit(False)))
