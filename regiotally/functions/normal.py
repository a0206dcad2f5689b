"""The standard normal distribution and its inverse as JVM-side expressions.

Rational approximations of Wichura (1988), algorithm AS 241, about 16 digits.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Published coefficients, constant term first.
CENTRE_NUMERATOR = [
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
]
CENTRE_DENOMINATOR = [
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
]
TAIL_NUMERATOR = [
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
]
TAIL_DENOMINATOR = [
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
]
FAR_NUMERATOR = [
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
]
FAR_DENOMINATOR = [
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
]


def inverse_normal(probability: Column) -> Column:
    """The z with P(Z <= z) = ``probability``; null outside the open interval (0, 1)."""
    offset = probability - 0.5
    inner = F.lit(0.180625) - offset * offset
    centre = offset * _polynomial(CENTRE_NUMERATOR, inner) / _polynomial(CENTRE_DENOMINATOR, inner)
    root = F.sqrt(-F.log(F.least(probability, 1 - probability)))
    near = _polynomial(TAIL_NUMERATOR, root - 1.6) / _polynomial(TAIL_DENOMINATOR, root - 1.6)
    far = _polynomial(FAR_NUMERATOR, root - 5.0) / _polynomial(FAR_DENOMINATOR, root - 5.0)
    tail = F.signum(offset) * F.when(root <= 5.0, near).otherwise(far)
    value = F.when(F.abs(offset) <= 0.425, centre).otherwise(tail)
    return F.when((probability > 0) & (probability < 1), value)


def _polynomial(coefficients, x: Column) -> Column:
    value = F.lit(coefficients[-1])
    for coefficient in reversed(coefficients[:-1]):
        value = value * x + coefficient
    return value


# Coefficients of Hart (1968), algorithm 5666, in the form of West (2005), highest power first.
BELOW_NUMERATOR = [
    3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931,
    220.206867912376,
]
BELOW_DENOMINATOR = [
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
    793.826512519948, 440.413735824752,
]


def normal_below(x) -> Column:
    """Probability that a standard normal value is below ``x``, to about 15 digits; beyond 37 deviations 0 or 1."""
    column = (F.col(x) if isinstance(x, str) else x).cast("double")
    size = F.abs(column)

    def horner(coefficients) -> Column:
        value = F.lit(coefficients[0])
        for c in coefficients[1:]:
            value = value * size + c
        return value

    far = size + 0.65
    for k in (4, 3, 2, 1):
        far = size + k / far
    height = F.exp(size * size * -0.5)
    near = height * horner(BELOW_NUMERATOR) / horner(BELOW_DENOMINATOR)
    tail = F.when(size > 37, 0.0).when(size < 7.07106781186547, near).otherwise(height / far / 2.506628274631)
    return F.when(column > 0, 1 - tail).otherwise(tail)
