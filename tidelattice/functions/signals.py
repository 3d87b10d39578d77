"""Small numpy kernels over a batch of windows: causal band-pass, wavelet energy, change-point score."""

from __future__ import annotations

import math

import numpy as np

# Detector band, filter order, wavelet and change-point settings.
BAND_LOW_HZ, BAND_HIGH_HZ = 1.0 / 7200.0, 1.0 / 300.0
FILTER_ORDER = 4
BAND_SHORT_SEC, BAND_LONG_SEC = 300.0, 7200.0
WAVELET_LEVELS, WAVELET_LEVELS_FAST, FAST_SEC = 6, 8, 15.0
HAZARD = 1.0 / 300.0
# Run lengths of a few rows that are worked on at once, so that they stay in the processor's cache.
RUNS_AT_ONCE = 16_384
# A longer row is taken alone: so many of its samples meet all older runs together, in tiles of so many runs or up to twice as many.
LONG_ROW, SAMPLES_AT_ONCE, RUNS_IN_TILE = 600, 16, 3_000
# Nothing beside one, and the exponential of less, which underflows, takes ten times as long.
LEAST_EXP = -700.0
# A block of samples less likely than this, as a logarithm, is left to the recursion over single samples.
DEEPEST = 600.0
# So is a row whose length times largest square is more: sums of it would lose digits that matter.
LARGEST = 1e8
BURN_IN = 10
# Daubechies-4 scaling filter.
DB4 = np.array(
    [
        0.23037781330885523,
        0.7148465705525415,
        0.6308807679295904,
        -0.02798376941698385,
        -0.18703481171888114,
        0.030841381835986965,
        0.032883011666982945,
        -0.010597401784997278,
    ]
)
DB4_LOW = DB4[::-1]
DB4_HIGH = DB4 * np.array([-1.0, 1.0] * 4)


def bandpass_sections(rate_hz: float) -> tuple[np.ndarray, float]:
    """Denominators (4 x 2) and gain of the Butterworth band-pass; every numerator is 1 - z^-2."""
    nyquist = rate_hz / 2
    high = min(BAND_HIGH_HZ / nyquist, 1 - 1e-10)
    low = min(max(BAND_LOW_HZ / nyquist, 1e-10), high - 1e-10)
    warped_low, warped_high = 4 * math.tan(math.pi * low / 2), 4 * math.tan(math.pi * high / 2)
    width, centre = warped_high - warped_low, math.sqrt(warped_low * warped_high)
    # Left-half-plane prototype poles with positive imaginary part; their mirrors pair up.
    angles = math.pi * (2 * np.arange(FILTER_ORDER // 2) + FILTER_ORDER + 1) / (2 * FILTER_ORDER)
    shifted = width * np.exp(1j * angles) / 2
    root = np.sqrt(shifted**2 - centre**2)
    analog = np.concatenate([shifted + root, shifted - root])
    digital = (4 + analog) / (4 - analog)
    gain = (width * 4) ** FILTER_ORDER / np.prod(np.abs(4 - analog) ** 2)
    return np.column_stack([-2 * digital.real, np.abs(digital) ** 2]), float(gain)


def bandpass(values: np.ndarray, rates_hz: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Causal band-pass of each row (rows padded to one width).

    The band-pass maps a constant to zero, so starting in the steady state of the
    first value equals filtering the departure from it from rest.
    """
    out = values - values[:, :1]
    designs = {rate: bandpass_sections(rate) for rate in np.unique(rates_hz)}
    poles = np.stack([designs[r][0] for r in rates_hz])
    gains = np.array([designs[r][1] for r in rates_hz])
    out = out * gains[:, None]
    for k in range(poles.shape[1]):
        a1, a2 = poles[:, k, 0], poles[:, k, 1]
        s1 = np.zeros(len(out))
        s2 = np.zeros(len(out))
        for t in range(out.shape[1]):
            x = out[:, t]
            y = x + s1
            s1 = s2 - a1 * y
            s2 = -x - a2 * y
            out[:, t] = y
    out[lengths <= 2 * FILTER_ORDER + 1] = 0.0
    return out


def settled(filtered: np.ndarray) -> np.ndarray:
    """A prefix of a causal filter's output; one too short for the filter counts as zero."""
    return filtered if len(filtered) > 2 * FILTER_ORDER + 1 else np.zeros(len(filtered))


def wavelet_energy(signal: np.ndarray, step_sec: float) -> float:
    """Energy of the detail levels whose period band meets 5 to 120 minutes."""
    n = len(signal)
    if n < len(DB4):
        return 0.0
    wanted = WAVELET_LEVELS_FAST if step_sec <= FAST_SEC else WAVELET_LEVELS
    levels = max(1, min(wanted, int(math.log2(n / (len(DB4) - 1)))))
    energy, smooth = 0.0, np.asarray(signal, dtype=float)
    for level in range(1, levels + 1):
        extended = np.pad(smooth, len(DB4) - 1, mode="symmetric")
        detail = np.convolve(extended, DB4_HIGH, mode="valid")[1::2]
        smooth = np.convolve(extended, DB4_LOW, mode="valid")[1::2]
        if 2**level * step_sec < BAND_LONG_SEC and 2 ** (level + 1) * step_sec > BAND_SHORT_SEC:
            energy += float(detail @ detail)
    return energy


def change_surprise(values: np.ndarray, lengths: np.ndarray, prior_precision: float = 1.0, max_runs: int | None = None) -> np.ndarray:
    """Negative log predictive density of each sample under run-length mixing, per row up to its length.

    `max_runs` bounds the run lengths kept for each sample; by default all are, which
    takes time with the square of a row's length.
    """
    if max_runs is not None:
        return _bounded_surprise(values, prior_precision, max_runs)
    out = np.zeros(values.shape)
    lengths = np.asarray(lengths)
    alone = np.array([n > LONG_ROW and _shallow(v[:n]) for v, n in zip(values, lengths)], bool)
    if alone.any():
        runs = _run_tables(int(lengths[alone].max()), prior_precision)
        for i in np.flatnonzero(alone):
            out[i, : lengths[i]] = _long_surprise(values[i, : lengths[i]], runs, prior_precision)
    rest = np.flatnonzero(~alone)
    longest_first = rest[np.argsort(-lengths[rest], kind="stable")]
    rows = max(1, RUNS_AT_ONCE // max(values.shape[1], 1))
    for start in range(0, len(rest), rows):
        at = longest_first[start : start + rows]
        out[at] = _full_surprise(values[at], lengths[at], prior_precision)
    return out


def change_scores(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """`change_score` of each row up to its length.

    A score needs nothing behind its peak, so a long row ends where no later sample can surprise
    more than an earlier one did: a run that starts afresh bounds every surprise from above.
    """
    lengths = np.asarray(lengths)
    scores = np.zeros(len(values))
    alone = np.array([n > LONG_ROW and _shallow(v[:n]) for v, n in zip(values, lengths)], bool)
    if alone.any():
        runs = _run_tables(int(lengths[alone].max()), 1.0)
        for i in np.flatnonzero(alone):
            scores[i] = change_score(_long_surprise(values[i, : lengths[i]], runs, 1.0, to_peak=True), lengths[i])
    rest = np.flatnonzero(~alone)
    if len(rest):
        surprise = change_surprise(values[rest, : lengths[rest].max()], lengths[rest])
        scores[rest] = [change_score(s[:n]) for s, n in zip(surprise, lengths[rest])]
    return scores


def most_surprise(values: np.ndarray, prior_precision: float = 1.0) -> np.ndarray:
    """What no sample's surprise exceeds: the run that starts at it has the weight of the hazard."""
    spread = 2.0 * (prior_precision + 1.0) / prior_precision
    return -math.log(HAZARD) + 0.5 * math.log(4.0 * spread) + 1.5 * np.log1p(values * values / spread)


def _shallow(values: np.ndarray) -> bool:
    """Whether a long row may be taken by blocks: its squares keep their digits in sums, and no block is too deep."""
    if len(values) * np.max(values * values, initial=0.0) > LARGEST:
        return False
    sums = np.cumsum(np.concatenate([[0.0], most_surprise(values)]))
    return bool(np.max(sums[SAMPLES_AT_ONCE:] - sums[:-SAMPLES_AT_ONCE], initial=0.0) < DEEPEST)


def _run_tables(width: int, prior_precision: float) -> tuple[np.ndarray, ...]:
    """What depends on a run's length alone, from the longest to none."""
    count = np.arange(width + SAMPLES_AT_ONCE, -1, -1)
    kappa = prior_precision + count
    # The likelihood of a whole run is exp(level) / (kappa * beta)^alpha, its chance to go on included.
    level = np.array([math.lgamma(1 + n / 2) for n in count]) - 0.5 * np.log(kappa / prior_precision) + (1 + count / 2) * np.log(kappa)
    level += count * (math.log(1 - HAZARD) - 0.5 * math.log(2 * math.pi)) - math.log(1 - HAZARD)
    # Row k holds a table as it stands k + 1 samples on: each run is longer by so many.
    later = [np.lib.stride_tricks.sliding_window_view(v, len(v) - SAMPLES_AT_ONCE + 1)[::-1] for v in (1 + count / 2, level)]
    return *later, kappa


def _long_surprise(x: np.ndarray, runs: tuple[np.ndarray, ...], prior_precision: float, to_peak: bool = False) -> np.ndarray:
    """All run lengths of one row, a block of samples at a time.

    A run's likelihood depends on its count, mean and squares only, and those of an older run
    merge with those of a block's first samples. So a block meets all older runs in a few passes;
    only the runs that start inside it are summed sample by sample. With `to_peak` the row ends
    once no later sample can exceed the largest surprise.
    """
    alpha, level, kappa = runs
    size, last, n = SAMPLES_AT_ONCE, len(kappa) - 1, len(x)
    blocks = -(-n // size)
    cells = np.zeros(blocks * size)
    cells[:n] = x
    cells = cells.reshape(blocks, size)
    # Runs from sample j of a block up to its sample k, and the block's first samples on their own.
    mean, beta, inner = np.zeros((blocks, size)), np.ones((blocks, size)), np.zeros((blocks, size, size))
    centre, squares = np.zeros((blocks, size)), np.zeros((blocks, size))
    for k in range(size):
        held = prior_precision + np.arange(k, -1, -1)
        off = cells[:, k : k + 1] - mean[:, : k + 1]
        beta[:, : k + 1] += off * off * (0.5 * held / (held + 1))
        mean[:, : k + 1] += off / (held + 1)
        at = slice(last - size - k, last - size + 1)
        inner[:, k, : k + 1] = np.exp(level[0, at] - alpha[0, at] * np.log(beta[:, : k + 1] * (held + 1))) * HAZARD
        before = centre[:, k - 1] if k else 0.0
        centre[:, k] = before + (cells[:, k] - before) / (k + 1)
        squares[:, k] = (squares[:, k - 1] if k else 0.0) + 0.5 * (cells[:, k] - before) * (cells[:, k] - centre[:, k])
    inner[0, :, 0] /= HAZARD
    bound = np.maximum.accumulate(most_surprise(x, prior_precision)[::-1])[::-1] if to_peak else None
    old_mean, old_beta, start = np.zeros(blocks * size), np.ones(blocks * size), np.zeros(blocks * size)
    tile, ones = np.empty(2 * size * RUNS_IN_TILE), np.ones(2 * RUNS_IN_TILE)
    found, total, more = np.zeros(blocks * size), 0.0, np.arange(1.0, size + 1)
    for b in range(blocks):
        t = b * size
        mass = np.zeros(size)
        # Beta times kappa of an older run after 1, 2, ... samples more is a sum of products of
        # what is known of the run and of the samples; means are taken from the block's.
        held, off = kappa[last - t : last], old_mean[:t] - centre[b, -1]
        near = centre[b] - centre[b, -1]
        sides = np.stack([held * old_beta[:t], old_beta[:t] + 0.5 * held * off * off, held, np.ones(t), held * off])
        those = np.stack([np.ones(size), more, squares[b] + 0.5 * more * near * near, more * squares[b], -more * near], axis=1)
        tiles = max(1, t // RUNS_IN_TILE) if t else 0
        for i in range(tiles):
            first, end = t * i // tiles, t * (i + 1) // tiles
            wide, at = end - first, last - t + first
            then = slice(at - size, at - size + wide)
            d = tile[: size * wide].reshape(size, wide)
            np.matmul(those, sides[:, first:end], out=d)
            np.log(d, out=d)
            d *= alpha[:, then]
            np.subtract(level[:, then], d, out=d)
            d += start[first:end] - total
            np.maximum(d, LEAST_EXP, out=d)
            np.exp(d, out=d)
            mass += d @ ones[:wide]
        # The likelihood of all samples up to each one, against that of the samples before the block.
        grown = np.ones(size + 1)
        for k in range(size):
            grown[k + 1] = mass[k] + inner[b, k, : k + 1] @ grown[: k + 1]
        logs = np.log(grown)
        found[t : t + size] = logs[:-1] - logs[1:]
        start[t : t + size] = total + logs[:-1] + math.log(HAZARD)
        if not b:
            start[0] = 0.0
        total += logs[-1]
        if to_peak and t + size < n:
            peak = BURN_IN + int(np.argmax(found[BURN_IN : t + size])) if t + size > BURN_IN else 0
            if peak >= BURN_IN + 5 and bound[t + size] < found[peak] - 1e-9:
                return found[: t + size]
        old_beta[:t] += squares[b, -1] + 0.5 * size * held / (held + size) * off * off
        old_mean[:t] -= off * (size / (held + size))
        old_mean[t : t + size], old_beta[t : t + size] = mean[b], beta[b]
    return found[:n]


def _full_surprise(values: np.ndarray, lengths: np.ndarray, prior_precision: float) -> np.ndarray:
    """All run lengths of a few rows, the longest row first; runs stand by their first sample, so none is moved.

    With scale b before a sample and b' after it, the density's log(1 + distance) is
    log b' - log b, so each run needs one logarithm and one exponential a sample.
    """
    width = int(lengths.max(initial=0))
    runs = np.arange(width, -1, -1)
    alpha, kappa = 1 + runs / 2, prior_precision + runs
    step, growth, power = 1.0 / (kappa + 1), 0.5 * kappa / (kappa + 1), alpha + 0.5
    level = np.array([math.lgamma((r + 3) / 2) - math.lgamma((r + 2) / 2) for r in range(width, -1, -1)])
    level -= 0.5 * np.log(2 * math.pi * (kappa + 1) / kappa)
    surprise = np.zeros(values.shape)
    log_p, mean, beta, log_beta = (np.zeros((len(values), width + 1)) for _ in range(4))
    beta += 1.0
    stay, reset = math.log(1 - HAZARD), math.log(HAZARD)
    for t in range(width):
        live, by = int(np.searchsorted(-lengths, -t)), slice(width - t, width + 1)
        p, m, b, before = log_p[:live, : t + 1], mean[:live, : t + 1], beta[:live, : t + 1], log_beta[:live, : t + 1]
        off = values[:live, t : t + 1] - m
        square = off * off
        square *= growth[by]
        b += square
        after = np.log(b)
        p += level[by]
        p -= 0.5 * before
        np.subtract(after, before, out=square)
        square *= power[by]
        p -= square
        before[:] = after
        top = p.max(axis=1, keepdims=True)
        np.subtract(p, top, out=square)
        np.maximum(square, LEAST_EXP, out=square)
        evidence = top + np.log(np.exp(square, out=square).sum(axis=1, keepdims=True))
        surprise[:live, t] = -evidence[:, 0]
        p -= evidence - stay
        log_p[:live, t + 1] = reset
        off *= step[by]
        m += off
    return surprise


def _bounded_surprise(values: np.ndarray, prior_precision: float, max_runs: int) -> np.ndarray:
    rows, width = values.shape
    counts = np.arange(width + 1)
    spread = np.array([math.lgamma((r + 3) / 2) - math.lgamma((r + 2) / 2) for r in counts])
    runs = np.zeros((rows, 1), dtype=np.int64)
    log_p, mean, beta = np.zeros((rows, 1)), np.zeros((rows, 1)), np.ones((rows, 1))
    surprise = np.zeros((rows, width))
    stay, reset = math.log(1 - HAZARD), math.log(HAZARD)
    for t in range(width):
        x = values[:, t : t + 1]
        alpha, kappa = 1 + runs / 2, prior_precision + runs
        variance = np.maximum(beta * (kappa + 1) / (alpha * kappa), 1e-300)
        off = x - mean
        dof = 2 * alpha
        fit = spread[runs] - 0.5 * np.log(dof * math.pi * variance) - (dof + 1) / 2 * np.log1p(off**2 / variance / dof)
        joint = log_p + fit
        top = joint.max(axis=1, keepdims=True)
        evidence = top + np.log(np.exp(joint - top).sum(axis=1, keepdims=True))
        surprise[:, t] = -evidence[:, 0]
        log_p = np.concatenate([np.full((rows, 1), reset), joint - evidence + stay], axis=1)
        mean = np.concatenate([np.zeros((rows, 1)), (kappa * mean + x) / (kappa + 1)], axis=1)
        beta = np.concatenate([np.ones((rows, 1)), beta + 0.5 * kappa * off**2 / (kappa + 1)], axis=1)
        runs = np.concatenate([np.zeros((rows, 1), dtype=np.int64), runs + 1], axis=1)
        if runs.shape[1] > max_runs:
            # The fresh run always stays; of the others the least likely one leaves.
            order = np.argsort(-log_p[:, 1:], axis=1, kind="stable")[:, : max_runs - 1] + 1
            keep = np.concatenate([np.zeros((rows, 1), dtype=np.int64), np.sort(order, axis=1)], axis=1)
            log_p, mean, beta, runs = (np.take_along_axis(a, keep, axis=1) for a in (log_p, mean, beta, runs))
            top = log_p.max(axis=1, keepdims=True)
            log_p = log_p - top - np.log(np.exp(log_p - top).sum(axis=1, keepdims=True))
    return surprise


def change_score(surprise: np.ndarray, length: int | None = None) -> float:
    """Largest standardised surprise above what noise of this length would show, mapped to [0, 1).

    `length` is the row's, where `surprise` ends behind its peak.
    """
    s = surprise[BURN_IN:]
    count = len(s) if length is None else length - BURN_IN
    if len(surprise) < BURN_IN + 5:
        return 0.0
    peak = int(np.argmax(s))
    base = s[:peak] if peak >= 5 else s
    middle = np.median(base)
    mad = np.median(np.abs(base - middle))
    if mad < 1e-12:
        mad = 0.6745 * np.std(base)
        if mad < 0.6745e-12:
            return 0.0
    excess = (s[peak] - middle) / mad - math.sqrt(2 * math.log(max(count, 2))) / 0.6745
    return excess / (excess + 5) if excess > 0 else 0.0
