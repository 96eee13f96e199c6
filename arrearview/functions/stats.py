"""Statistics over grouped counts, as Spark SQL expressions.

Each builder takes SQL expressions over the grouped columns (usually column names) and returns one
struct Column, so a single grouped job yields the statistic for every segment. Text is used because
a formula then costs one parse instead of one driver round trip per operator. Denominators are
guarded with NULLIF, which keeps the expressions valid under ANSI mode for empty groups.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearview.params import Definitions


def share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def _nz(x: str) -> str:
    """Double denominator, NULL instead of zero."""
    return f"nullif(double({x}), 0D)"


def clean(x: Column, d: Definitions) -> Column:
    """Round for publication; NaN and infinities become NULL."""
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.round(x, d.digits))


def proportion(k: str, n: str, d: Definitions) -> Column:
    """Wilson interval of k out of n: struct(rate, lo, hi, enough_n)."""
    z, z2 = f"{d.z!r}D", f"{d.z * d.z!r}D"
    n = f"coalesce({n}, 0)"
    nn = _nz(n)
    p = f"(double(coalesce({k}, 0)) / {nn})"
    shrink = f"(1 + {z2} / {nn})"
    centre = f"({p} + {z2} / (2 * {nn})) / {shrink}"
    half = f"{z} * sqrt({p} * (1 - {p}) / {nn} + {z2} / (4 * {nn} * {nn})) / {shrink}"
    return F.expr(
        f"named_struct('rate', {p}, 'lo', if({n} > 0, greatest(0D, {centre} - {half}), null), "
        f"'hi', if({n} > 0, least(1D, {centre} + {half}), null), 'enough_n', {n} >= {d.min_n})")


def _log_bounds(ratio: str, se: str, z: str) -> tuple[str, str]:
    return f"({ratio}) * exp(-{z} * {se})", f"({ratio}) * exp({z} * {se})"


def _katz_se(k1: str, n1: str, k0: str, n0: str) -> str:
    return f"sqrt(1 / {_nz(k1)} - 1 / {_nz(n1)} + 1 / {_nz(k0)} - 1 / {_nz(n0)})"


def risk_ratio(k1: str, n1: str, k0: str, n0: str, d: Definitions) -> Column:
    """(k1/n1)/(k0/n0) with the log interval of Katz.

    struct(ratio, lo, hi, significant, haldane, skipped). Nothing is computed when either group is
    below the minimum sample. A zero numerator adds one half to both numerators and one to both
    denominators.
    """
    skipped = f"({n1} < {d.min_n} or {n0} < {d.min_n})"
    haldane = f"(not {skipped} and ({k1} = 0 or {k0} = 0))"
    half = f"if({haldane}, 0.5D, 0D)"
    a, b = f"({k1} + {half})", f"({k0} + {half})"
    m1, m0 = f"({n1} + 2 * {half})", f"({n0} + 2 * {half})"
    rr = f"({a} / {_nz(m1)}) / {_nz(f'{b} / {_nz(m0)}')}"
    lo, hi = _log_bounds(rr, _katz_se(a, m1, b, m0), f"{d.z!r}D")
    return F.expr(
        f"named_struct('ratio', if({skipped}, null, {rr}), 'lo', if({skipped}, null, {lo}), "
        f"'hi', if({skipped}, null, {hi}), 'significant', if({skipped}, null, {lo} > 1 or {hi} < 1), "
        f"'haldane', {haldane}, 'skipped', {skipped})")


def risk_ratio_bounds(ratio: str, k1: str, n1: str, k0: str, n0: str, z: str) -> Column:
    """struct(lo, hi) of a known ratio at another normal quantile; NULL when a count is zero."""
    lo, hi = _log_bounds(ratio, _katz_se(k1, n1, k0, n0), z)
    return F.expr(f"named_struct('lo', {lo}, 'hi', {hi})")


def _byar(observed: str, expected: str, d: Definitions) -> tuple[str, str]:
    z, e = f"{d.z!r}D", f"if({expected} > 0, double({expected}), null)"
    o, o1 = _nz(observed), f"(double({observed}) + 1)"
    lo = f"{o} * power(1 - 1 / (9 * {o}) - {z} / (3 * sqrt({o})), 3)"
    hi = f"{o1} * power(1 - 1 / (9 * {o1}) + {z} / (3 * sqrt({o1})), 3)"
    return (f"if({observed} = 0, 0D, {lo}) / {e}",
            f"if({observed} = 0, {-math.log(d.tail)!r}D, {hi}) / {e}")


def byar(observed: str, expected: str, d: Definitions) -> Column:
    """Byar's interval of observed/expected: struct(lo, hi); NULL without expectation."""
    lo, hi = _byar(observed, expected, d)
    return F.expr(f"named_struct('lo', {lo}, 'hi', {hi})")


def observed_over_expected(observed: str, expected: str, d: Definitions) -> Column:
    """struct(smr, lo, hi, significant)."""
    lo, hi = _byar(observed, expected, d)
    return F.expr(
        f"named_struct('smr', double({observed}) / {_nz(expected)}, 'lo', {lo}, 'hi', {hi}, "
        f"'significant', coalesce({lo} > 1 or {hi} < 1, false))")


def mantel_haenszel(strata: DataFrame, keys: list[str], d: Definitions) -> DataFrame:
    """Pool the strata (columns k1, n1, k0, n0) of every key: ratio, lo, hi, significant, n_strata.

    The variance of the log ratio is that of Greenland and Robins. Strata with an empty side do
    not count.
    """
    both, total = "n1 > 0 and n0 > 0", _nz("n1 + n0")

    def over(x: str) -> Column:
        return F.expr(f"coalesce(sum({x}) filter (where {both}), 0D)")

    sums = strata.groupBy(*keys).agg(
        over(f"double(k1) * n0 / {total}").alias("_num"),
        over(f"double(k0) * n1 / {total}").alias("_den"),
        over(f"(double(n1) * n0 * (k1 + k0) - double(k1) * k0 * (n1 + n0)) / ({total} * {total})").alias("_var"),
        F.expr(f"count_if({both})").alias("n_strata"),
    )
    rr = "nullif(_num, 0D) / nullif(_den, 0D)"
    lo, hi = _log_bounds(rr, "sqrt(_var / (nullif(_num, 0D) * nullif(_den, 0D)))", f"{d.z!r}D")
    return sums.selectExpr(
        *keys, f"{rr} as ratio", f"{lo} as lo", f"{hi} as hi", f"{lo} > 1 or {hi} < 1 as significant", "n_strata")


def _arm_size(p1: str, p2: str, gap: str, d: Definitions) -> str:
    """Units per arm to tell p1 from p2: two-sided test of two proportions, equal arms."""
    mid = f"(({p1} + {p2}) / 2)"
    spread = (f"({d.z!r}D * sqrt(2 * {mid} * (1 - {mid})) "
              f"+ {d.z_power!r}D * sqrt({p1} * (1 - {p1}) + {p2} * (1 - {p2})))")
    return f"ceil({spread} * {spread} / nullif({gap} * {gap}, 0D))"


def arm_size_relative(p: str, change: float, d: Definitions) -> Column:
    """For a relative change of the rate p; NULL when p is zero or unknown."""
    p1 = f"if({p} > 0, round({p}, {d.digits}), null)"
    p2 = f"({p1} * {1 + change!r}D)"
    return F.expr(_arm_size(p1, p2, f"({p1} - {p2})", d))


def arm_size_absolute(p: str, change: str, d: Definitions) -> Column:
    """For an absolute change of the rate p."""
    p1 = f"round({p}, {d.digits})"
    return F.expr(_arm_size(p1, f"({p1} + {change})", change, d))


def bonferroni_z(tests: Column, d: Definitions) -> Column:
    """Normal quantile for `tests` simultaneous two-sided intervals.

    Spark has no normal quantile; the few grouped rows that need one go through an Arrow batch.
    """
    tail = d.tail

    @F.pandas_udf("double")
    def quantile(m: pd.Series) -> pd.Series:
        dist = NormalDist()
        return m.map(lambda v: dist.inv_cdf(1 - tail / max(int(v), 1)))

    return quantile(tests.cast("long"))


def sample_flags(k: str, n: str, d: Definitions) -> Column:
    """struct(small_n, few_cases, thin_cases): what must not be read as a result."""
    return F.expr(f"named_struct('small_n', {n} < {d.min_n}, 'few_cases', {k} < {d.few_cases}, "
                  f"'thin_cases', {k} < {d.thin_cases})")
