"""Tidal fits and inversions on Spark against closed forms."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidelattice.functions import signals
from tidelattice.functions.tides import SPEEDS, basis_matrix, fit_robust
from tidelattice.operators import detect as D
from tidelattice.operators import inversion as I
from tidelattice.operators import tide as T


def two_series():
    """A short and a longer series with drift and outliers."""
    rng = np.random.default_rng(9)
    parts = []
    for k, level, n in (("a", 1.0, 800), ("b", -2.0, 1500)):
        hours = 3.0 + np.arange(n) * 0.5
        y = basis_matrix(hours) @ np.r_[level, rng.normal(size=16)] + 0.01 * rng.normal(size=n)
        y += 0.004 * hours + 2e-6 * hours**2
        y[::97] += 3
        y *= 0.01
        parts.append(pd.DataFrame({"k": k, "hours": hours, "v": y}))
    return pd.concat(parts)


def plain_fit(hours, y, drift, rounds=20):
    """Reweighted least squares written out; the columns, too, are built here."""
    columns = [np.ones(len(hours))]
    for speed in SPEEDS:
        columns += [np.cos(speed * hours), np.sin(speed * hours)]
    if drift:
        u = (hours - np.mean(hours)) / (np.max(hours) - np.min(hours))
        columns += [u, u * u]
    x = np.stack(columns, axis=1)
    c = np.linalg.lstsq(x, y, rcond=None)[0]
    plain = c
    for _ in range(rounds):
        r = y - x @ c
        s = 1.4826 * np.median(np.abs(r - np.median(r)))
        w = np.sqrt(1 / (1 + (r / s) ** 2))
        new = np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]
        done = np.max(np.abs(new - c)) < 1e-6
        c = new
        if done:
            break
    return plain, c, y - x @ c


def test_fits_of_every_size_equal_plain_numpy(spark):
    """A short key beside one over the limit, at production rounds, with drift."""
    data = two_series()
    df = spark.createDataFrame(data).repartition(3)
    fits = {
        "by size": T.fit_tide_robust(df, ["k"], "v", True, gather_limit=1000),
        "grouped": T.fit_tide_robust(df, ["k"], "v", True),
        "plain": T.fit_tide(df, ["k"], "v", True),
    }
    got = {name: {r["k"]: r for r in f.collect()} for name, f in fits.items()}
    left = T.detide(df, fits["by size"], ["k"], "v").orderBy("k", "hours").toPandas()
    for k, part in data.groupby("k"):
        h, y = part["hours"].to_numpy(), part["v"].to_numpy()
        plain, robust, residual = plain_fit(h, y, True)
        assert np.max(np.abs(plain - robust)) > 1e-3
        for name, want in (("grouped", robust), ("by size", robust), ("plain", plain)):
            r = got[name][k]
            assert np.allclose(r["coefficients"], want, rtol=0, atol=1e-9), name
            assert r["n_fit"] == len(h) and np.allclose((r["t_mean"], r["t_range"]), (h.mean(), np.ptp(h)))
        assert np.allclose(left[left.k == k].residual, residual, rtol=0, atol=1e-9)


def test_distributed_rounds_equal_plain_rounds_without_drift(spark):
    data = two_series()
    df = spark.createDataFrame(data).repartition(3)
    rounds = {r["k"]: r["coefficients"] for r in T.fit_tide_rounds(df, ["k"], "v", rounds=2).collect()}
    for k, part in data.groupby("k"):
        want = plain_fit(part["hours"].to_numpy(), part["v"].to_numpy(), False, 2)[1]
        assert np.allclose(rounds[k], want, rtol=0, atol=1e-9)


def test_fit_of_no_rows_and_of_one_instant(spark):
    empty = spark.createDataFrame([], "k string, hours double, v double")
    assert not T.fit_tide_robust(empty, ["k"], "v", True).count() and not T.fit_tide(empty, ["k"], "v", True).count()
    one = spark.createDataFrame([("a", 2.0, 5.0)] * 3, "k string, hours double, v double")
    fits = T.fit_tide_robust(one, ["k"], "v", True)
    assert T.detide(one, fits, ["k"], "v").agg(F.max(F.abs("residual"))).first()[0] < 1e-9


def test_detide_leaves_nothing_of_a_pure_tide(spark):
    hours = np.arange(0, 600, 1.0)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "hours": hours, "v": basis_matrix(hours) @ np.linspace(1, 2, 17)}))
    left = T.detide(df, T.fit_tide(df, ["k"], "v"), ["k"], "v").agg(F.max(F.abs("residual"))).first()[0]
    assert left < 1e-6


def test_inversion_recovers_weights_and_resampling_is_stable(spark):
    rng = np.random.default_rng(10)
    k, stations, steps = 4, 5, 40
    h = rng.normal(size=(stations, steps, k))
    true = np.array([2.0, 0.0, 1.0, 0.5])
    greens = pd.DataFrame([(s, t, j, h[s, t, j]) for s in range(stations) for t in range(steps) for j in range(k)], columns=["station_id", "t", "source_id", "h"])
    waves = pd.DataFrame([(1, s, t, float(h[s, t] @ true)) for s in range(stations) for t in range(steps)], columns=["event_id", "station_id", "t", "d"])
    blocks = I.gram_blocks(spark.createDataFrame(greens), spark.createDataFrame(waves), range(k))
    row = I.invert_sources(blocks, k, [5e9] * k, [4e10] * k).first()
    assert np.allclose(row["weights"], true, atol=1e-8) and row["rmse_cm"] < 1e-3
    assert abs(row["mw"] - 2 / 3 * (np.log10(3.5 * 2e20) - 9.1)) < 1e-9
    one = I.bootstrap_inversion(blocks, k, 20).orderBy("iteration").toPandas()
    two = I.bootstrap_inversion(blocks.repartition(3), k, 20).orderBy("iteration").toPandas()
    assert len(one) == 20 and np.allclose(np.stack(one["weights"]), np.stack(two["weights"]))
    assert np.allclose(np.stack(one["weights"]), true, atol=1e-6)
    loo = I.leave_one_out(blocks, k).first()
    assert loo["n_active"] == 3 and loo["result"] in {"PASS", "CONCERN", "FAIL"}


def test_window_scores_find_the_burst(spark):
    rng = np.random.default_rng(11)
    rows = []
    for w in range(4):
        t = np.arange(0, 21_600, 60)
        y = 0.002 * rng.normal(size=len(t)) + (0.2 * np.sin(2 * np.pi * t / 1200) * (t > 10_000) if w == 3 else 0)
        rows += [("dart", "21401", int((w * 21_600 + s) * 1e6), i, float(v)) for i, (s, v) in enumerate(zip(t, y))]
    df = spark.createDataFrame(rows, "source_type string, station_id string, ts_us long, seq long, value_m double").repartition(4)
    found = D.window_features(D.collect_windows(df))
    scored = D.score_features(found, D.calibrate_baseline(found, 3 * 21_600_000_000), F.lit(False)).orderBy("window_no").collect()
    assert [r["status"] for r in scored] == ["SCORING_SUCCEEDED"] * 4
    assert all(r["ensemble_score"] < 0.35 for r in scored[:3]) and scored[3]["ensemble_score"] > 0.85
    assert scored[3]["tier"] == "ESCALATE" and not scored[3]["filter_degraded"]


def test_forest_ranks_the_outlier_first(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 2))
    x[7] = 8.0
    df = spark.createDataFrame(pd.DataFrame({"source_type": "dart", "station_id": "1", "window_no": np.arange(400), "a": x[:, 0], "b": x[:, 1]}))
    forest = D.fit_forest(df, ["a", "b"])
    assert forest.count() == 100
    scores = D.score_forest(df, forest, ["a", "b"]).orderBy(F.desc("ml_score")).toPandas()
    assert scores.iloc[0]["window_no"] == 7 and 0 <= scores["ml_score"].min() and scores["ml_score"].max() <= 1


def test_drift_follows_the_parabola_and_ignores_a_burst(spark):
    t = np.linspace(0, 30, 400)
    y = 1 + 0.02 * t + 0.001 * t * t + 0.002 * np.sin(40 * t)
    z = y.copy()
    z[180:220] += 5
    rows = [("a", int(h * 3.6e9), float(v), i + 1, 400) for i, (h, v) in enumerate(zip(t, z))]
    rows += [("b", i * 60_000_000, 2.0, i + 1, 50) for i in range(50)] + [("c", 7, 3.0, 1, 1)]
    numbered = spark.createDataFrame(rows, "k string, ts_us long, v double, rn long, n long")
    got = T.drift_baseline(numbered, ["k"], "v").orderBy("k", "ts_us").toPandas()
    a = got[got.k == "a"].baseline.to_numpy()
    assert np.max(np.abs(a - (1 + 0.02 * t + 0.001 * t * t))) < 0.05
    inner = slice(60, 180)
    clean = np.delete(np.arange(400), np.arange(180, 220))
    fit = np.polyval(np.polyfit(t[clean], z[clean], 2), t)
    assert np.allclose(a[inner], fit[inner], atol=1e-6)
    # At both ends the curve meets the median of the outermost rows.
    assert np.isclose(a[0], np.median(z[:5])) and abs(a[-1] - np.median(z[-5:])) < 1e-3
    assert np.allclose(got[got.k == "b"].baseline, 2.0) and np.allclose(got[got.k == "c"].baseline, 3.0)


def station_windows(spark, seed=21, n=200):
    """A buoy with a separate fit and a gauge without; a burst in the second half."""
    rng = np.random.default_rng(seed)
    rows = []
    for source, station in (("dart", "21401"), ("coops", "9410000")):
        t = np.cumsum(rng.choice([59, 60, 61, 120], size=n)) * 1_000_000
        y = 0.5 * np.cos(t / 3.6e9 * 0.5) + 0.003 * rng.normal(size=n) + 0.15 * np.sin(2 * np.pi * t / 1.2e9) * (np.arange(n) > n // 2)
        fit = [0.0] * 17 if source == "dart" else None
        rows.append((source, station, 0, int(t[-1]), t.tolist(), y.tolist(), fit, 0 if fit else None))
    rows.append(("dart", "short", 0, 1, [0, 60_000_000, 120_000_000], [0.1, 0.2, 0.3], None, None))
    rows.append(("dart", "one", 0, 1, [0], [0.1], None, None))
    y = [0.1] * 80 + [float("nan")] + [0.1] * 40
    rows.append(("dart", "nan", 0, 1, [i * 60_000_000 for i in range(121)], y, None, None))
    return spark.createDataFrame(
        rows, "source_type string, station_id string, window_no long, window_end_us long, times array<long>, samples array<double>, coefficients array<double>, t0_us long"
    )


def test_prefixes_equal_windows_scored_on_their_own(spark):
    """Each prefix, cut out and scored as a window with the record's sampling step, gives the same features."""
    windows = station_windows(spark)
    got = D.prefix_features(windows).toPandas()
    assert set(got[got.station_id == "nan"].status) == {"SCORING_SUCCEEDED", "SCORING_FAILED", "INSUFFICIENT_DATA"}
    assert not len(got[got.station_id == "one"])
    for row in windows.collect():
        own = got[(got.station_id == row.station_id) & (got.status == "SCORING_SUCCEEDED")]
        step = np.median(np.diff(row.times)) / 1e6 if len(row.times) > 1 else None
        for p in own.itertuples():
            t, y = np.array(row.times[: p.n_samples], float), np.array(row.samples[: p.n_samples])
            assert p.n_samples == p.prefix * int(300 / step) and p.window_end_us == t[-1]
            hours = (t - (row.t0_us if row.coefficients else t[0])) / 3.6e9
            fit = np.array(row.coefficients) if row.coefficients else fit_robust(hours, y)
            left = (y - basis_matrix(hours) @ fit)[None, :]
            n = np.array([len(y)])
            flat = signals.bandpass(left.copy(), np.array([1 / step]), n)[0]
            change = signals.change_score(signals.change_surprise(left, n)[0])
            want = (np.max(np.abs(flat)), signals.wavelet_energy(flat, step), change)
            assert np.allclose((p.peak_m, p.wavelet_energy, p.bocpd_score), want, rtol=1e-6, atol=1e-9)


def test_first_crossing_of_growing_scores(spark):
    found = D.prefix_features(station_windows(spark))
    base = spark.createDataFrame([("dart", "21401", 1e-6)], "source_type string, station_id string, quiet_energy double")
    scored = D.with_first_crossings(D.score_features(found, base, F.lit(False))).where("station_id = '21401'").orderBy("prefix").toPandas()
    hits = {i: scored[scored.ensemble_score >= t].minutes for i, t in ((1, 0.35), (2, 0.60), (3, 0.85))}
    assert len(hits[1])
    for i, minutes in hits.items():
        first = minutes.min() if len(minutes) else None
        assert (scored[f"t{i}_min"].isna().all() if first is None else np.allclose(scored[f"t{i}_min"], first))


def test_baseline_of_a_buoy_without_a_quiet_window_is_its_first_half_hour(spark):
    found = D.window_features(station_windows(spark).where("station_id = '21401'"))
    row = found.first()
    assert D.early_samples(200, 60.0) == 30 and D.early_samples(200, 900.0) == 10 and D.early_samples(12, 60.0) == 6
    base = D.calibrate_baseline(found, 0).first()["quiet_energy"]
    assert base == row["early_energy"] and base < row["wavelet_energy"] / row["n_samples"]


def test_medians_of_long_series_are_found_by_rank(spark, monkeypatch):
    rng = np.random.default_rng(12)
    values = {
        0: rng.normal(size=30_001), 1: np.r_[rng.normal(size=20_000), 1e6 + rng.normal(size=20_000)],
        2: np.r_[np.zeros(25_000), rng.normal(size=9_000)], 3: np.full(20_000, 2.5), 4: np.array([1.0, 4.0]),
    }
    rows = pd.DataFrame([(k, 0.0, float(v)) for k, vs in values.items() for v in vs], columns=["_k", "hours", "_y"])
    df = spark.createDataFrame(rows.sample(frac=1, random_state=1)).repartition(3)
    series = {k: T._Series(len(v), ()) for k, v in values.items()}
    monkeypatch.setattr(T, "VALUES_PER_TASK", 500)
    for guess in ((-np.inf, np.inf), (0.0, 0.1), (50.0, 51.0)):
        got = T._medians(df, series, lambda left, one: left, {k: guess for k in values})
        assert got == {k: float(np.median(v)) for k, v in values.items()}


def test_a_round_of_a_long_series_is_a_few_jobs(spark):
    """Rounds were a dozen jobs each, two of them exact percentiles; now a pass is one job."""
    rng = np.random.default_rng(13)
    hours = np.sort(rng.uniform(0, 240, 6_000))
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "hours": hours, "v": rng.normal(size=len(hours)) + 0.3 * np.cos(hours / 2)}))

    def jobs(rounds):
        spark.sparkContext.setJobGroup(f"rounds{rounds}", "")
        T.fit_tide_rounds(df, ["k"], "v", rounds=rounds)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds{rounds}"))

    try:
        assert (jobs(6) - jobs(2)) / 4 <= 8
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_costly_stage_is_computed_once(spark, tmp_path):
    from tidelattice.session import cut_lineage

    def noted(batches):
        for batch in batches:
            for i in batch["id"]:
                (tmp_path / f"{i}-{time.time_ns()}").touch()
            yield batch

    rows = spark.range(0, 3, 1, 1).mapInPandas(noted, "id long")
    assert sorted(r["id"] for r in cut_lineage(rows, once=True).collect()) == [0, 1, 2]
    assert len(list(tmp_path.iterdir())) == 3
