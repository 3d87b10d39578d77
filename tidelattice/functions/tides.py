"""Tidal basis as Column expressions and small solves on numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Constituent speeds, degrees per hour, by name.
SPEEDS_DEG_PER_HOUR = {
    "K1": 15.041069,
    "K2": 30.082138,
    "M2": 28.984104,
    "N2": 28.439730,
    "O1": 13.943036,
    "P1": 14.958931,
    "Q1": 13.398661,
    "S2": 30.0,
}
NAMES = sorted(SPEEDS_DEG_PER_HOUR)
SPEEDS = [math.radians(SPEEDS_DEG_PER_HOUR[name]) for name in NAMES]
SIZE = 1 + 2 * len(NAMES)
# Drift columns beside the tide, and the shortest range in hours that scales them.
DRIFT, LEAST_SPAN = 2, 1e-6
IRLS_ROUNDS = 20
IRLS_TOLERANCE = 1e-6


def tide_basis(hours: Column, mean: Column | None = None, span: Column | None = None) -> list[Column]:
    """Intercept, then cosine and sine of each constituent in name order; with `mean` and `span` also the drift."""
    terms = [F.lit(1.0)]
    for speed in SPEEDS:
        terms += [F.cos(hours * speed), F.sin(hours * speed)]
    return terms if mean is None else terms + drift_basis(hours, mean, span)


def drift_basis(hours: Column, mean: Column, span: Column) -> list[Column]:
    """Linear and quadratic drift on the centred and scaled clock of the fit."""
    scaled = (hours - mean) / F.when(span < LEAST_SPAN, 1.0).otherwise(span)
    return [scaled, scaled * scaled]


def predict_tide(hours: Column, coefficients: Column, mean: Column | None = None, span: Column | None = None) -> Column:
    terms = [term * coefficients[i] for i, term in enumerate(tide_basis(hours, mean, span))]
    return sum(terms[1:], terms[0])


def amplitude(coefficients: Column, name: str) -> Column:
    at = 2 * NAMES.index(name) + 1
    return F.sqrt(coefficients[at] * coefficients[at] + coefficients[at + 1] * coefficients[at + 1])


def basis_matrix(hours: np.ndarray, mean: float | None = None, span: float | None = None) -> np.ndarray:
    phase = np.outer(hours, SPEEDS)
    out = np.ones((len(hours), SIZE if mean is None else SIZE + DRIFT))
    out[:, 1:SIZE:2] = np.cos(phase)
    out[:, 2:SIZE:2] = np.sin(phase)
    if mean is not None:
        out[:, SIZE] = (hours - mean) / (1.0 if span < LEAST_SPAN else span)
        out[:, SIZE + 1] = out[:, SIZE] ** 2
    return out


def solve_moments(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Minimum-norm solution from summed moments (upper triangle, row by row)."""
    full = np.zeros((len(rhs), len(rhs)))
    full[np.triu_indices(len(rhs))] = gram
    full = full + np.triu(full, 1).T
    return np.linalg.pinv(full, rcond=1e-13, hermitian=True) @ rhs


def fit_robust(hours: np.ndarray, values: np.ndarray, mean: float | None = None, span: float | None = None) -> np.ndarray:
    """Cauchy-weighted least squares of one bounded series, with drift where `mean` and `span` are given."""
    return fit_robust_on(basis_matrix(hours, mean, span), values)


def fit_robust_on(basis: np.ndarray, values: np.ndarray) -> np.ndarray:
    """`fit_robust` where the basis is known, as for the growing prefixes of one window."""
    coefficients = np.linalg.lstsq(basis, values, rcond=None)[0]
    weighted = np.empty_like(basis)
    for _ in range(IRLS_ROUNDS):
        left = values - basis @ coefficients
        scale = 1.4826 * middle(np.abs(left - middle(left)))
        if scale < 1e-12:
            break
        root = 1.0 / np.sqrt(1.0 + (left / scale) ** 2)
        updated = np.linalg.lstsq(np.multiply(basis, root[:, None], out=weighted), values * root, rcond=None)[0]
        moved = np.abs(updated - coefficients).max()
        coefficients = updated
        if moved < IRLS_TOLERANCE:
            break
    return coefficients


def middle(values: np.ndarray) -> float:
    """The median; numpy's own spends most of its time on checks where a series is short."""
    half = len(values) // 2
    if len(values) % 2:
        return np.partition(values, half)[half]
    both = np.partition(values, (half - 1, half))
    return (both[half - 1] + both[half]) / 2
