"""P-values of single test statistics, computed on the driver from scalars."""

from __future__ import annotations

import math

# Coefficients of Royston (1995), algorithm AS R94, constant term first.
LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
NEXT_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_MEAN = [0.5440, -0.39978, 0.025054, -6.714e-4]
SMALL_LOG_SPREAD = [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_LOG_SPREAD = [-0.4803, -0.082676, 0.0030302]
SMALL_SHIFT = [-2.273, 0.459]


def polynomial(coefficients, x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


def shapiro_p(w: float, n: int) -> float:
    """P-value of the Shapiro-Wilk statistic by Royston's normal approximation."""
    if n == 3:
        return max(6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))), 0.0)
    if w >= 1:
        return 1.0
    y = math.log(1 - w)
    if n <= 11:
        shift = polynomial(SMALL_SHIFT, n)
        if y >= shift:
            return 0.0
        y = -math.log(shift - y)
        mean, spread = polynomial(SMALL_MEAN, n), math.exp(polynomial(SMALL_LOG_SPREAD, n))
    else:
        size = math.log(n)
        mean, spread = polynomial(LARGE_MEAN, size), math.exp(polynomial(LARGE_LOG_SPREAD, size))
    return math.erfc((y - mean) / spread / math.sqrt(2)) / 2


def kolmogorov_p(distance: float, n: int) -> float:
    """p-value of a one-sample Kolmogorov-Smirnov distance, from the limit distribution at Stephens' corrected root of n.

    The alternating series serves large arguments, its theta transform small ones; both are summed to the last digit.
    """
    root = math.sqrt(n)
    x = (root + 0.12 + 0.11 / root) * distance
    if x <= 0:
        return 1.0
    if x < 1:
        below = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 20))
        return min(1.0, max(0.0, 1 - math.sqrt(2 * math.pi) / x * below))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 20))))


def student_p(t: float, df: int) -> float:
    """Two-sided p-value of Student's t."""
    if math.isnan(t):
        return t
    return _beta_ratio(df / (df + t * t), df / 2, 0.5)


def _beta_ratio(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_ratio(1 - x, b, a)
    front = math.exp(_log_gamma_ratio(a, b) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    fraction = d
    for m in range(1, 10_000_000):  # the steps needed grow with the root of a and b
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            c, d = 1 + term / c, 1 / (1 + term * d)
            fraction *= c * d
        if abs(1 - c * d) < 1e-15:
            return front * fraction
    raise ArithmeticError(f"the incomplete beta function does not converge at {x}, {a}, {b}")


def _log_gamma_ratio(a: float, b: float) -> float:
    """Log of gamma(a + b) / gamma(a); for large ``a`` by its series, as the difference would cancel."""
    if max(a, b) < 1e5:
        return math.lgamma(a + b) - math.lgamma(a)
    if b > a:
        return math.lgamma(a + b) - math.lgamma(a) if a > 1e5 else _log_gamma_ratio(b, a) + math.lgamma(b) - math.lgamma(a)
    return b * math.log(a) + b * (b - 1) / (2 * a) - b * (b - 1) * (2 * b - 1) / (12 * a * a)
