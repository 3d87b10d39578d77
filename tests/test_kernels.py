"""Detector kernels against closed forms."""

import numpy as np
import pytest

from tidelattice.functions import signals as S
from tidelattice.functions.tides import SPEEDS, basis_matrix, fit_robust, fit_robust_on, middle
from tidelattice.operators.inversion import nonnegative_weights


@pytest.mark.parametrize("step", [15.0, 60.0])
def test_bandpass_response(step):
    poles, gain = S.bandpass_sections(1 / step)

    def response(f):
        z = np.exp(-2j * np.pi * f * step)
        return abs(gain * np.prod([(1 - z * z) / (1 + a * z + b * z * z) for a, b in poles]))

    assert response(0.0) == 0
    assert response(1 / 7200) == pytest.approx(2**-0.5, rel=1e-6)
    assert response(1 / 300) == pytest.approx(2**-0.5, rel=1e-6)
    assert response(1 / 1500) == pytest.approx(1.0, rel=1e-6)


def test_bandpass_is_causal_and_blind_to_level():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2, 300))
    y = S.bandpass(np.vstack([x, x[:1] + 5.0, np.full((1, 300), 7.0)]), np.full(4, 1 / 60), np.full(4, 300))
    assert np.allclose(y[0], y[2]) and np.allclose(y[3], 0)
    cut = x.copy()
    cut[:, 200:] = 0
    assert np.allclose(S.bandpass(cut, np.full(2, 1 / 60), np.full(2, 300))[:, :200], y[:2, :200])
    assert not S.bandpass(x[:, :9], np.full(2, 1 / 60), np.full(2, 9)).any()


def test_wavelet_energy():
    low, high = S.DB4_LOW, S.DB4_HIGH
    assert low.sum() == pytest.approx(2**0.5) and abs(high.sum()) < 1e-10
    assert low @ low == pytest.approx(1) and high @ high == pytest.approx(1) and abs(low @ high) < 1e-10
    rng = np.random.default_rng(1)
    x = np.zeros(512)
    x[200:300] = rng.normal(size=100)
    # A signal away from the ends keeps its energy over all levels; at 150 s every detail level up to 5 counts.
    ext = np.pad(x, 7, mode="symmetric")
    parts = [np.convolve(ext, f, mode="valid")[1::2] for f in (low, high)]
    assert sum(p @ p for p in parts) == pytest.approx(x @ x)
    t = np.arange(720) * 60.0
    assert S.wavelet_energy(np.sin(2 * np.pi * t / 1200), 60.0) > 100 * S.wavelet_energy(np.sin(2 * np.pi * t / 120.5), 60.0)
    assert S.wavelet_energy(x[:7], 60.0) == 0.0


def test_change_point():
    rng = np.random.default_rng(2)
    quiet = rng.normal(scale=0.01, size=(1, 400))
    step = quiet.copy()
    step[:, 250:] += 0.5
    low = S.change_score(S.change_surprise(quiet, np.array([400]))[0])
    high = S.change_score(S.change_surprise(step, np.array([400]))[0])
    assert low < 0.3 < high
    assert S.change_score(np.zeros(14)) == 0.0


def test_change_surprise_equals_the_direct_recursion():
    """Against the run-length recursion written out one run at a time."""
    import math

    x = np.random.default_rng(5).normal(size=40)
    log_p, stats, want = [0.0], [(0.0, 1.0, 1.0, 1.0)], []
    for v in x:
        fits = []
        for m, k, a, b in stats:
            var, dof = b * (k + 1) / (a * k), 2 * a
            fits.append(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi * var)
                        - (dof + 1) / 2 * math.log1p((v - m) ** 2 / var / dof))
        joint = [p + f for p, f in zip(log_p, fits)]
        evidence = math.log(sum(math.exp(j) for j in joint))
        want.append(-evidence)
        log_p = [math.log(S.HAZARD)] + [j - evidence + math.log(1 - S.HAZARD) for j in joint]
        stats = [(0.0, 1.0, 1.0, 1.0)] + [((k * m + v) / (k + 1), k + 1, a + 0.5, b + 0.5 * k * (v - m) ** 2 / (k + 1)) for m, k, a, b in stats]
    assert np.allclose(S.change_surprise(x[None, :], np.array([40]))[0], want)


def test_long_windows_keep_the_fresh_run():
    x = np.random.default_rng(6).normal(size=(2, 700))
    s = S.change_surprise(x, np.array([700, 700]))
    few = S.change_surprise(x, np.array([700, 700]), max_runs=600)
    assert np.isfinite(s).all() and np.allclose(s[:, :600], few[:, :600]) and np.allclose(s, few, atol=1e-2)


def test_pure_tide_vanishes():
    hours = np.arange(0, 30 * 24, 0.25)
    tide = 2.0 + sum(0.1 * (i + 1) * np.cos(w * hours + i) for i, w in enumerate(SPEEDS))
    tide[100] += 50
    fit = fit_robust(hours, tide)
    left = tide - basis_matrix(hours) @ fit
    assert np.max(np.abs(np.delete(left, 100))) < 1e-3


def test_nonnegative_weights_meet_their_conditions():
    rng = np.random.default_rng(8)
    for _ in range(50):
        h = rng.normal(size=(60, 8))
        d = h @ np.maximum(rng.normal(size=8), 0) + 0.3 * rng.normal(size=60)
        w = nonnegative_weights(h.T @ h, h.T @ d)
        pull = h.T @ d - h.T @ h @ w
        assert (w >= 0).all() and (pull < 1e-6).all() and np.allclose(pull[w > 0], 0, atol=1e-6)
    true = np.array([1.0, 0, 2.0, 0])
    h = rng.normal(size=(30, 4))
    assert np.allclose(nonnegative_weights(h.T @ h, h.T @ (h @ true)), true, atol=1e-8)


def test_change_surprise_works_on_each_row_up_to_its_length():
    """Padding once took as long as samples: 72 prefixes of a window each cost as much as the longest."""
    rng = np.random.default_rng(6)
    values, lengths = rng.normal(size=(5, 90)), np.array([30, 90, 12, 61, 90])
    got = S.change_surprise(values, lengths)
    for row, n, mine in zip(values, lengths, got):
        assert np.allclose(mine[:n], S.change_surprise(row[None, :n], np.array([n]))[0])
        assert not mine[n:].any()


def long_rows():
    rng = np.random.default_rng(11)
    n = 1_300
    quiet = 0.003 * rng.normal(size=n)
    return {
        "skewed": rng.exponential(0.5, n) - 0.5, "quiet": quiet, "step": np.where(np.arange(n) < 700, 0.0, 0.5) + quiet, "flat": np.full(n, 0.3),
        "far off": 100 + quiet, "sentinels": np.where(rng.random(n) < 0.01, 9999.0, quiet), "wild": 1e8 * rng.normal(size=n),
    }


def test_blocks_of_a_long_row_equal_the_recursion(monkeypatch):
    """Long rows once met every run length sample by sample; several tiles and a last block that is not full are tried."""
    monkeypatch.setattr(S, "RUNS_IN_TILE", 300)
    for name, x in long_rows().items():
        for n in (len(x), S.LONG_ROW + 1):
            got, want = (f(x[None, :n], np.array([n]), 1.0)[0] for f in (S.change_surprise, S._full_surprise))
            assert np.allclose(got, want, rtol=1e-10, atol=1e-8), name
            assert (want <= S.most_surprise(x[:n]) + 1e-9).all(), name
    assert {name for name, x in long_rows().items() if not S._shallow(x)} == {"sentinels", "wild"}


def test_a_score_ends_where_no_later_sample_can_surprise_more():
    """The score of a long row once took all its samples, with their square; nothing behind the peak matters."""
    rng = np.random.default_rng(12)
    x = np.clip(rng.normal(size=2_000), -2.0, 2.0)
    x[700] = 25.0
    tables = S._run_tables(2_000, 1.0)
    ended = S._long_surprise(x, tables, 1.0, to_peak=True)
    assert 700 < len(ended) < 740 and len(S._long_surprise(x, tables, 1.0)) == 2_000
    rows = {**long_rows(), "spike": x, "late spike": x[::-1], "early spike": np.r_[x[690:], x[:690]], "short": x[:40]}
    width = max(map(len, rows.values()))
    values, lengths = np.stack([np.pad(v, (0, width - len(v))) for v in rows.values()]), np.array([len(v) for v in rows.values()])
    for name, v, n, got in zip(rows, values, lengths, S.change_scores(values, lengths)):
        assert got == pytest.approx(S.change_score(S._full_surprise(v[None, :n], np.array([n]), 1.0)[0]), abs=1e-9), name


def test_robust_fit_on_a_known_basis_is_the_same_fit():
    """Medians and the basis of growing prefixes are found faster; not one bit may change."""
    rng = np.random.default_rng(13)
    hours = np.sort(rng.uniform(0, 6, 150))
    basis, values = basis_matrix(hours), rng.exponential(0.5, 150)
    for n in (10, 11, 64, 149, 150):
        assert middle(values[:n]) == np.median(values[:n])
        assert np.array_equal(fit_robust_on(basis[:n], values[:n]), fit_robust(hours[:n], values[:n]))
