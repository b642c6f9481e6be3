"""p-values of the two-sample Kolmogorov-Smirnov test (V7): exact, and for large samples.

The statistic comes from a distributed pass; a p-value needs three numbers,
so these functions run once for each column of a report.
"""

from __future__ import annotations

import math

import numpy as np

#: Samples up to this size get the exact distribution.
EXACT_ROWS = 10_000
#: Effective sizes up to this one get the exact one-sample distribution, larger ones its expansion.
_MATRIX_ROWS = 150


def exact_p(d: float, n1: int, n2: int) -> float:
    """P(D >= d) under equality, for samples without ties: lattice paths that touch the boundary.

    u(i, j) is the share of the paths to (i, j) that stay inside; it is the mean of
    its two predecessors weighted by i and j, so shares never leave [0, 1].  One step for each
    anti-diagonal, a vector along it.
    """
    lcm = math.lcm(n1, n2)
    a, b, h = lcm // n1, lcm // n2, round(d * lcm)
    if h <= 0:
        return 1.0
    i = np.arange(n1 + 1, dtype=np.int64)
    u = np.zeros(n1 + 1)
    u[0] = 1.0
    for s in range(1, n1 + n2 + 1):
        before = np.concatenate(([0.0], u[:-1]))
        j = s - i
        inside = (j >= 0) & (j <= n2) & (np.abs(i * a - j * b) < h)
        u = np.where(inside, (before * i + u * np.maximum(j, 0)) / s, 0.0)
    return float(min(1.0, max(0.0, 1.0 - u[n1])))


def _matrix_cdf(d: float, n: int) -> float:
    """P(D_n < d) of one sample by the n-th power of a banded matrix (Durbin; Marsaglia, Tsang and Wang)."""
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    inverse = np.array([1.0 / math.factorial(i) if i < 150 else 0.0 for i in range(m + 2)])
    at = np.arange(m)
    gap = at[:, None] - at[None, :] + 1
    mat = np.where(gap >= 0, inverse[np.maximum(gap, 0)], 0.0)
    corner = h ** (at + 1)
    mat[:, 0] -= corner * inverse[at + 1]
    mat[m - 1, :] -= corner[::-1] * inverse[(at + 1)[::-1]]
    mat[m - 1, 0] += max(0.0, 2 * h - 1) ** m * inverse[m]
    out, power, exponent, out_e, power_e = np.eye(m), mat, n, 0, 0
    while exponent:
        if exponent & 1:
            out, out_e = out @ power, out_e + power_e
        power, power_e = power @ power, 2 * power_e
        for name, x in (("out", out), ("power", power)):
            top = np.abs(x).max()
            if top > 1e100:
                if name == "out":
                    out, out_e = x * 1e-100, out_e + 100
                else:
                    power, power_e = x * 1e-100, power_e + 100
        exponent >>= 1
    log = math.lgamma(n + 1) - n * math.log(n) + out_e * math.log(10)
    return float(min(1.0, out[k - 1, k - 1] * math.exp(log))) if out[k - 1, k - 1] > 0 else 0.0


def _expanded_cdf(z: float, n: float) -> float:
    """P(sqrt(n) D_n <= z) by four terms of the expansion of Pelz and Good (1976)."""
    pi2, k = math.pi ** 2, np.arange(-40, 41)
    half = (k + 0.5) ** 2
    e_half, e_whole, whole = np.exp(-pi2 * half / (2 * z * z)), np.exp(-pi2 * k * k / (2 * z * z)), k.astype(float) ** 2
    root = math.sqrt(math.pi / 2)
    k0 = root / z * e_half.sum()
    k1 = root / (6 * z ** 4) * ((pi2 * half - z * z) * e_half).sum()
    k2 = (root / (72 * z ** 7) * ((6 * z ** 6 + 2 * z ** 4 + pi2 * (2 * z ** 4 - 5 * z * z) * half
                                   + pi2 ** 2 * (1 - 2 * z * z) * half ** 2) * e_half).sum()
          - root / (36 * z ** 3) * (pi2 * whole * e_whole).sum())
    k3 = (root / (6480 * z ** 10) * ((pi2 ** 3 * half ** 3 * (5 - 30 * z * z) + pi2 ** 2 * half ** 2 * (-60 * z * z + 212 * z ** 4)
                                      + pi2 * half * (135 * z ** 4 - 96 * z ** 6) - 30 * z ** 6 - 90 * z ** 8) * e_half).sum()
          + root / (108 * z ** 6) * ((-pi2 ** 2 * whole ** 2 + 3 * pi2 * whole * z * z) * e_whole).sum())
    return float(k0 + k1 / math.sqrt(n) + k2 / n + k3 / n ** 1.5)


def one_sample_p(d: float, n: int) -> float:
    """P(D_n >= d) of one sample of ``n`` rows."""
    if d <= 0 or n < 1:
        return 1.0
    if d >= 1:
        return 0.0
    if n <= _MATRIX_ROWS:
        return max(0.0, 1.0 - _matrix_cdf(d, n))
    z = math.sqrt(n) * d
    if z < 0.2:
        return 1.0
    if z > 2.4:                                  # both sides at once have no chance: twice the one-sided tail
        return min(1.0, 2 * math.exp(-(6 * n * d + 1) ** 2 / (18 * n)))
    return min(1.0, max(0.0, 1.0 - _expanded_cdf(z, n)))


def p_value(d: float, n1: int, n2: int) -> float:
    """Two-sided p of two samples: exact while both have at most ``EXACT_ROWS`` rows, else by the effective size."""
    if n1 < 1 or n2 < 1:
        return 1.0
    if max(n1, n2) <= EXACT_ROWS:
        return exact_p(d, n1, n2)
    return one_sample_p(d, round(n1 * n2 / (n1 + n2)))
