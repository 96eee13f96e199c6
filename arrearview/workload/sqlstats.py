"""The statistics once more, as text for the DuckDB checks.

Each helper returns (select list, names of the double columns in it).
"""

from __future__ import annotations

import math
from statistics import NormalDist

Z = NormalDist().inv_cdf(0.975)
ZP = NormalDist().inv_cdf(0.80)
MIN_N = 30


def total(*columns: str) -> str:
    return ", ".join(f"cast(sum({c}) as bigint) {c}" for c in columns)


def prop(k: str, n: str, name: str) -> str:
    """Wilson bounds as the roots p of (p - k/n)^2 = z^2 p (1 - p) / n."""
    p = f"(cast(({k}) as double)/nullif(({n}), 0))"
    a, b = f"(1 + {Z**2}e0/nullif(({n}), 0))", f"(2*{p} + {Z**2}e0/nullif(({n}), 0))"
    root = f"sqrt(greatest({b}*{b} - 4*{a}*{p}*{p}, 0))"
    return (f"{p} {name}_rate, case when ({n}) > 0 then greatest(0.0e0, ({b} - {root})/(2*{a})) end {name}_lo, "
            f"case when ({n}) > 0 then least(1.0e0, ({b} + {root})/(2*{a})) end {name}_hi, ({n}) >= {MIN_N} {name}_enough_n")


def props(*names: str) -> list[str]:
    return [f"{n}_{x}" for n in names for x in ("rate", "lo", "hi")]


def rr(k1: str, n1: str, k0: str, n0: str, name: str) -> str:
    ok = f"(({n1}) >= {MIN_N} and ({n0}) >= {MIN_N})"
    zero = f"(({k1}) = 0 or ({k0}) = 0)"
    h = f"(case when {zero} then 0.5e0 else 0.0e0 end)"
    a, b, m1, m0 = f"(({k1})+{h})", f"(({k0})+{h})", f"(({n1})+2*{h})", f"(({n0})+2*{h})"
    lg = f"(ln({a}) - ln({m1}) - ln({b}) + ln({m0}))"
    se = f"sqrt(greatest(1/{a} - 1/{m1} + 1/{b} - 1/{m0}, 0))"
    lo, hi = f"exp({lg} - {Z}e0*{se})", f"exp({lg} + {Z}e0*{se})"
    return (f"case when {ok} then exp({lg}) end {name}_ratio, case when {ok} then {lo} end {name}_lo, "
            f"case when {ok} then {hi} end {name}_hi, case when {ok} then {lo} > 1 or {hi} < 1 end {name}_significant, "
            f"{ok} and {zero} {name}_haldane, not {ok} {name}_skipped")


def rrs(*names: str) -> list[str]:
    return [f"{n}_{x}" for n in names for x in ("ratio", "lo", "hi")]


def byar(o: str, e: str) -> tuple[str, str]:
    lo = (f"case when ({e}) > 0 then case when ({o}) = 0 then 0.0e0 else "
          f"({o})*power(1 - 1/(9.0e0*({o})) - {Z}e0/(3*sqrt({o})), 3)/({e}) end end")
    hi = (f"case when ({e}) > 0 then case when ({o}) = 0 then {-math.log(0.025)}e0/({e}) else "
          f"(({o})+1)*power(1 - 1/(9.0e0*(({o})+1)) + {Z}e0/(3*sqrt(({o})+1)), 3)/({e}) end end")
    return lo, hi


def oe(o: str, e: str, name: str = "oe") -> str:
    lo, hi = byar(o, e)
    return (f"case when ({e}) > 0 then ({o})/({e}) end {name}_smr, {lo} {name}_lo, {hi} {name}_hi, "
            f"ifnull({lo} > 1 or {hi} < 1, false) {name}_significant")


def oes(*names: str) -> list[str]:
    return [f"{n}_{x}" for n in names or ("oe",) for x in ("smr", "lo", "hi")]


MH_ROUND = ["ratio", "lo", "hi"]


def mh(source: str, keys: str) -> str:
    """Mantel-Haenszel over rows with k1, n1, k0, n0 of `source`, grouped by `keys`."""
    comma = f"{keys}, " if keys else ""
    group = f"group by {keys}" if keys else ""
    return f"""
select {comma}case when a * b > 0 then a / b end ratio,
  case when a * b > 0 then exp(ln(a / b) - {Z}e0 * sqrt(v / (a * b))) end lo,
  case when a * b > 0 then exp(ln(a / b) + {Z}e0 * sqrt(v / (a * b))) end hi,
  case when a * b > 0 then abs(ln(a / b)) > {Z}e0 * sqrt(v / (a * b)) end significant, n_strata
from (select {comma}
    ifnull(sum(case when n1 > 0 and n0 > 0 then k1 * n0 / cast(n1 + n0 as double) end), 0) a,
    ifnull(sum(case when n1 > 0 and n0 > 0 then k0 * n1 / cast(n1 + n0 as double) end), 0) b,
    ifnull(sum(case when n1 > 0 and n0 > 0 then
      (cast(n1 as double) * n0 * (k1 + k0) - cast(k1 as double) * k0 * (n1 + n0)) / power(n1 + n0, 2) end), 0) v,
    count(case when n1 > 0 and n0 > 0 then 1 end) n_strata
  from ({source}) strata {group}) pooled_sums"""


def arm(p1: str, p2: str, gap: str | None = None) -> str:
    m = f"(({p1}) + ({p2}))/2"
    g = gap or f"(({p1}) - ({p2}))"
    return (f"cast(ceil(power({Z}e0*sqrt(2*{m}*(1-{m})) + {ZP}e0*sqrt(({p1})*(1-({p1})) + ({p2})*(1-({p2}))), 2)"
            f" / power({g}, 2)) as bigint)")


def arm_rel(k: str, n: str, change: str) -> str:
    p = f"round(({k})/cast(({n}) as double), 10)"
    return f"case when ({k}) > 0 and ({n}) > 0 then {arm(p, f'{p}*(1.0e0+({change}))')} end"
