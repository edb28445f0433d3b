"""Confidence bounds of a count that was sampled at rate theta, of which `retained` values were kept.

The number kept is binomial. Above 120 kept, the normal approximation with continuity correction does. Below, where theta is small, the same
formula does with another number of deviations, the one that gives the exact tail as theta goes to 0; else the tail is summed.
"""

from __future__ import annotations

import functools

import numpy as np

#: The tail of a normal distribution beyond 1, 2 and 3 deviations; where each way of computing holds.
TAILS = {1: 0.1586553191586026479, 2: 0.0227502618904135701, 3: 0.0013498126861731796}
NORMAL_ABOVE = 120
SMALL_RATIO = 360.0
NEAR_ONE = 1e-5


def _normal(kept: np.ndarray, theta: np.ndarray, deviations: np.ndarray, sign: int) -> np.ndarray:
    """The root n of (n * theta - kept') ** 2 = deviations ** 2 * n * theta * (1 - theta), below or above, kept' being kept moved by a half."""
    center = (kept + sign * 0.5) / theta
    spread = deviations * np.sqrt((1.0 - theta) / theta)
    return center + 0.5 * spread * spread + sign * 0.5 * spread * np.sqrt(np.maximum(0.0, spread * spread + 4.0 * center)) + sign * 0.5


def _poisson_below(mean: np.ndarray, n: np.ndarray) -> np.ndarray:
    """P(X < n) of a Poisson variable."""
    k = np.arange(NORMAL_ABOVE + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, NORMAL_ABOVE + 1)))])
    terms = np.exp(k[None, :] * np.log(mean)[:, None] - mean[:, None] - logs[None, :])
    return np.where(k[None, :] < n[:, None], terms, 0.0).sum(1)


@functools.cache
def equivalent_deviations(deviations: int, sign: int) -> np.ndarray:
    """For 0 to 120 values kept, the number of deviations at which the normal formula gives the exact tail for theta near 0: there the number kept
    is Poisson, of a mean that is found by bisection."""
    n = np.arange(1, NORMAL_ABOVE + 1)
    tail = TAILS[deviations]
    want = 1 - tail if sign < 0 else tail
    at = n if sign < 0 else n + 1  # P(X >= n) = tail for the lower bound, P(X <= n) = tail for the upper
    low, high = np.full(len(n), 1e-9), np.full(len(n), 4.0 * NORMAL_ABOVE)
    for _ in range(200):
        mid = (low + high) / 2
        more = _poisson_below(mid, at) > want  # the probability falls as the mean grows
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    mean = (low + high) / 2
    return np.concatenate([[deviations], sign * (mean - (n + sign * 0.5)) / np.sqrt(mean)])


def _summed(kept: int, theta: float, most: float, strict: bool) -> int:
    """The count at which the probability of `kept` successes or fewer trials passes most."""
    term = total = theta**kept
    m = kept
    while total <= most if strict else total < most:
        term *= (1.0 - theta) * m / (m + 1 - kept)
        total += term
        m += 1
    return m - 1 if strict else m


def bound(retained: np.ndarray, theta: np.ndarray, deviations: int, upper: bool) -> np.ndarray:
    """The lower or upper bound of the count, for arrays of the number retained and of theta."""
    if deviations not in TAILS:
        raise ValueError("bounds are for 1, 2 or 3 standard deviations")
    kept, theta = np.asarray(retained, np.float64), np.asarray(theta, np.float64)
    if (kept < 0).any() or (theta <= 0).any() or (theta > 1).any():
        raise ValueError("retained must not be negative and theta in (0, 1]")
    sign = 1 if upper else -1
    tail = TAILS[deviations]
    few = kept <= NORMAL_ABOVE
    how_many = np.where(few, equivalent_deviations(deviations, sign)[np.minimum(kept, NORMAL_ABOVE).astype(int)], deviations)
    out = _normal(kept, theta, how_many, sign)
    middle = few & (theta >= kept / SMALL_RATIO) & (theta <= 1 - NEAR_ONE) & (kept >= (1 if upper else 2))
    for i in np.flatnonzero(middle):
        out[i] = _summed(int(kept[i]) + 1, theta[i], 1 - tail, False) if upper else _summed(int(kept[i]), theta[i], tail, True)
    out = np.where(few & (theta > 1 - NEAR_ONE), kept + upper, out)
    with np.errstate(divide="ignore", invalid="ignore"):
        unseen = np.log1p(-theta)
        if upper:
            out = np.where(kept == 0, np.ceil(np.log(tail) / unseen), out)
        else:
            out = np.where(kept == 0, 0.0, np.where(kept == 1, np.floor(np.log(1 - tail) / unseen), out))
    out = np.where(theta == 1.0, kept, out)
    estimate = kept / theta
    return np.maximum(estimate, out) if upper else np.minimum(estimate, np.maximum(kept, out))
