"""Special functions Spark lacks, as SQL expression texts and Columns that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wichura's algorithm AS 241 (PPND16), numerators and denominators from the highest power down.
_A = (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0)
_B = (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0)
_C = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0)
_D = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0)
_E = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0)
_F = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0)
#: Lanczos coefficients for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    text = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        text = f"({text} * {x} + CAST({c!r} AS DOUBLE))"
    return text


def ppf_text(p: str) -> str:
    """Inverse of the standard normal distribution at 0 < p < 1, as SQL text (Spark or any other engine)."""
    q = f"({p} - CAST(0.5 AS DOUBLE))"
    r = f"(CAST(0.180625 AS DOUBLE) - {q} * {q})"
    tail = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1 - {p} END))"
    near, far = f"({tail} - CAST(1.6 AS DOUBLE))", f"({tail} - CAST(5.0 AS DOUBLE))"
    return (
        f"CASE WHEN abs{q} <= 0.425 THEN {q} * {_horner(_A, r)} / {_horner(_B, r)} "
        f"ELSE (CASE WHEN {q} < 0 THEN -1.0E0 ELSE 1.0E0 END) * (CASE WHEN {tail} <= 5.0 THEN {_horner(_C, near)} / {_horner(_D, near)} ELSE {_horner(_E, far)} / {_horner(_F, far)} END) END"
    )


def normal_ppf(column: str) -> Column:
    return F.expr(ppf_text(column))


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 0.5 (Lanczos)."""
    y = x - 1.0
    s = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        s = s + F.lit(c) / (y + float(i))
    t = y + 7.5
    return F.lit(0.9189385332046727) + (y + 0.5) * F.log(t) - t + F.log(s)


def gamma_cdf(x: Column, shape: Column, scale: Column, terms: int = 600) -> Column:
    """Gamma distribution function by its power series: each term is the one before times z / (shape + n).

    The terms rise while n < z - shape and then fall off within a few square roots of
    z; as many are added as that takes, at most `terms`.
    """
    z = x / scale
    first = F.exp(-z + shape * F.log(z) - lgamma(shape + 1.0))
    state = F.struct(first.alias("term"), first.alias("total"))
    done = F.aggregate(
        F.sequence(F.lit(1), F.least(F.lit(terms), F.ceil(F.greatest(z - shape, F.lit(0.0)) + 8.0 * F.sqrt(z) + 30.0).cast("int"))),
        state,
        lambda acc, n: F.struct((acc["term"] * z / (shape + n)).alias("term"), (acc["total"] + acc["term"] * z / (shape + n)).alias("total")),
        lambda acc: F.least(acc["total"], F.lit(1.0)),
    )
    return F.when(x <= 0, F.lit(0.0)).otherwise(done)
