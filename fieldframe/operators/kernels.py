"""Series kernels in numpy: one series in, one row of statistics out.

They work on arrays that Spark has gathered by key and travel in Arrow
batches. Signs of pairs are counted by sorting, in n log n steps. The pair
slopes of a short series are all formed; of a long one the median is found by
bisection over counts of smaller slopes, so memory is that of the series.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

Z975 = 1.959963984540054  # the normal's 0.975 quantile
TREND_FIELDS = ("slope", "p_value", "trend", "mean_val", "std_val", "tau", "z_score")
#: Longest series whose n(n-1)/2 pair slopes are formed (eight bytes each), and whose lags are summed one by one.
DIRECT = 3_000


def inversions(x: np.ndarray) -> int:
    """Pairs i < j with x[i] > x[j], counted while blocks that double in size are sorted."""
    n = len(x)
    if n < 2:
        return 0
    _, ranks = np.unique(x, return_inverse=True)
    size = 1 << (n - 1).bit_length()
    now = np.full(size, n, np.int64)  # what is added at the end is larger than all: no inversions
    now[:n] = ranks
    total, width = 0, 1
    while width < size:
        pairs = now.reshape(-1, 2 * width)
        shift = np.arange(len(pairs), dtype=np.int64)[:, None] * (n + 1)
        left, right = (pairs[:, :width] + shift).ravel(), (pairs[:, width:] + shift).ravel()
        below = np.searchsorted(left, right, side="right") - np.repeat(np.arange(len(pairs)) * width, width)
        total += int((width - below).sum())
        now = np.sort(pairs, axis=1).ravel()
        width *= 2
    return total


def _tied(counts: np.ndarray) -> int:
    return int((counts.astype(object) * (counts.astype(object) - 1) // 2).sum()) if len(counts) else 0


def sign_sum(x: np.ndarray) -> int:
    """Sum of the signs of x[j] - x[i] over all pairs i < j."""
    n = len(x)
    return n * (n - 1) // 2 - _tied(np.unique(x, return_counts=True)[1]) - 2 * inversions(x)


def pair_slopes(x: np.ndarray, block: int = 512) -> np.ndarray:
    """The slopes of all pairs i < j."""
    n, parts = len(x), []
    for first in range(0, n - 1, block):
        rows = np.arange(first, min(first + block, n - 1))
        cols = np.arange(first + 1, n)
        gap = cols[None, :] - rows[:, None]
        ahead = gap > 0
        parts.append((x[None, first + 1 :] - x[rows, None])[ahead] / gap[ahead])
    return np.concatenate(parts)


def _ordered(f: float) -> int:
    """Integers in the order of floats."""
    i = int(np.float64(f).view(np.int64))
    return i if i >= 0 else -(i & 0x7FFFFFFFFFFFFFFF)


def _float(i: int) -> float:
    return float(np.int64(i).view(np.float64)) if i >= 0 else -float(np.int64(-i).view(np.float64))


def median_slope(x: np.ndarray, direct: int = DIRECT) -> float:
    """Median of the slopes of all pairs.

    A slope of i and j is below t where x - t * index falls from i to j. For
    long series the middle slopes are the floats at which that count passes
    the middle, exact up to the rounding of x - t * index.
    """
    n = len(x)
    if n <= direct:
        return float(np.median(pair_slopes(x)))
    steps, pairs = np.arange(n, dtype=float), n * (n - 1) // 2
    change = np.diff(x)
    found = []
    for k in {(pairs - 1) // 2, pairs // 2}:
        low, high = _ordered(float(change.min())), _ordered(float(change.max()))  # no slope is steeper than all steps
        while low < high:  # the largest t with at most k slopes below
            middle = (low + high + 1) // 2
            if inversions(x - _float(middle) * steps) <= k:
                low = middle
            else:
                high = middle - 1
        found.append(_float(low))
    return sum(found) / len(found)


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, place, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2.0)[place]


def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    """Autocorrelation for lags 1 to `lags`; zeros if the series is constant."""
    d = x - x.mean()
    total = float(d @ d)
    if total == 0:
        return np.zeros(lags)
    n = len(x)
    if n > DIRECT:
        size = 1 << (2 * n - 1).bit_length()
        sums = np.fft.irfft(np.abs(np.fft.rfft(d, size)) ** 2, size)[1 : min(lags, n - 1) + 1]
        return np.concatenate((sums / total, np.zeros(max(0, lags - n + 1))))
    return np.array([float(d[: n - k] @ d[k:]) / total if k < n else 0.0 for k in range(1, lags + 1)])


def _normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _z(s: float, variance: float) -> float | None:
    if s == 0:
        return 0.0
    if not variance > 0:
        return None
    return (s - math.copysign(1, s)) / math.sqrt(variance)


def quantile(alpha: float) -> float:
    """The normal's two-sided quantile."""
    return Z975 if alpha == 0.05 else NormalDist().inv_cdf(1 - alpha / 2)


def hamed_rao(x: np.ndarray, scale: float = 1.0, alpha: float = 0.05, lag: int | None = None) -> tuple:
    """Mann-Kendall with the variance corrected for autocorrelated ranks (Hamed and Rao 1998).

    alpha is the level of the trend and of the autocorrelations that count;
    lag the last of them (all, if not given).
    """
    n = len(x)
    if n < 2:
        return (None,) * 7
    s, slope = float(sign_sum(x)), median_slope(x)
    tau, mean, std = s / (n * (n - 1) / 2), float(x.mean()), float(x.std(ddof=1))
    if n == 2:
        return slope * scale, None, None, mean, std, tau, None
    _, ties = np.unique(x, return_counts=True)
    ties = ties.astype(float)
    plain = (n * (n - 1) * (2 * n + 5) - float((ties * (ties - 1) * (2 * ties + 5)).sum())) / 18
    ranks = average_ranks(x - slope * np.arange(1, n + 1))
    lags = n - 1 if lag is None else max(0, min(lag, n - 1))
    rho, k, edge = autocorrelation(ranks, lags), np.arange(1, lags + 1, dtype=float), quantile(alpha)
    kept = np.abs(rho) > edge / math.sqrt(n)
    extra = float(((n - k) * (n - k - 1) * (n - k - 2) * rho)[kept].sum())
    z = _z(s, plain * (1 + 2 / (n * (n - 1) * (n - 2)) * extra))
    if z is None:
        return slope * scale, None, 0, mean, std, tau, None
    return slope * scale, _normal_p(z), int(math.copysign(1, z)) if abs(z) > edge else 0, mean, std, tau, z


def native_mk(x: np.ndarray, scale: float = 1.0, alpha: float = 0.05, lag: int | None = None) -> tuple:
    """Mann-Kendall with an effective sample size from the raw series' autocorrelation; no tie correction."""
    n = len(x)
    if n < 2:
        return (None,) * 7
    s = float(sign_sum(x))
    lags = n if lag is None else lag + 1
    rho = autocorrelation(x, min(lags, n))
    sizes = 1 - np.arange(1, len(rho) + 1) / n
    spread = 1 + 2 * float((sizes * rho).sum())
    effective = max(1.0, n / spread) if spread != 0 else 1.0
    full = n * (n - 1) * (2 * n + 5)
    below = effective * (effective - 1) * (2 * effective + 5)
    z = 0.0 if below == 0 else _z(s, full / 18 * full / below)
    mean, std, slope, tau = float(x.mean()), float(x.std(ddof=1)), median_slope(x) * scale, s / (n * (n - 1) / 2)
    if z is None:
        return slope, None, 0, mean, std, tau, None
    p = _normal_p(z)
    return slope, p, (int(math.copysign(1, z)) if p < alpha and z else 0), mean, std, tau, z


def _exact_kendall(n: int, swaps: int) -> float:
    """Share of the n! orders with at most `swaps` inversions."""
    ways = np.zeros(swaps + 1)
    ways[0] = 1.0
    for m in range(2, n + 1):
        total = np.cumsum(ways)
        shifted = np.zeros_like(total)
        shifted[m:] = total[:-m] if len(total) > m else 0
        ways = (total - shifted) / m
    return float(min(1.0, ways.sum()))


def kendall(x: np.ndarray, y: np.ndarray, alternative: str = "two-sided") -> tuple[float | None, float | None]:
    """tau-b and its p-value: exact without ties in short series, else normal."""
    n = len(x)
    if n < 2:
        return None, None
    pairs = n * (n - 1) // 2
    order = np.lexsort((y, x))  # pairs that are tied in x do not fall in y
    both = np.unique(np.stack((x, y)), axis=1, return_counts=True)[1]
    ties = _tied(np.unique(x, return_counts=True)[1]) + _tied(np.unique(y, return_counts=True)[1]) - _tied(both)
    s = float(pairs - ties - 2 * inversions(y[order]))
    t, u = (np.unique(v, return_counts=True)[1].astype(float) for v in (x, y))
    n1, n2 = float((t * (t - 1) / 2).sum()), float((u * (u - 1) / 2).sum())
    if (pairs - n1) * (pairs - n2) <= 0:
        return None, None
    tau = s / math.sqrt((pairs - n1) * (pairs - n2))
    down = round((pairs - s) / 2)
    if not n1 and not n2 and (n <= 33 or min(down, pairs - down) <= 1):
        less, more = 1 - _exact_kendall(n, down - 1) if down else 1.0, _exact_kendall(n, down)
        both = min(1.0, 2 * min(less, more))
        return tau, {"two-sided": both, "greater": more, "less": less}[alternative]
    m = n * (n - 1.0)
    v = (m * (2 * n + 5) - float((t * (t - 1) * (2 * t + 5)).sum()) - float((u * (u - 1) * (2 * u + 5)).sum())) / 18 + 2 * n1 * n2 / m
    if n > 2:
        v += float((t * (t - 1) * (t - 2)).sum()) * float((u * (u - 1) * (u - 2)).sum()) / (9 * m * (n - 2))
    if v <= 0:
        return tau, None
    z = s / math.sqrt(v)
    upper = 0.5 * math.erfc(z / math.sqrt(2))
    return tau, {"two-sided": _normal_p(z), "greater": upper, "less": 1 - upper}[alternative]
