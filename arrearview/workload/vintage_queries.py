"""Analyses of the vintage mart."""

from __future__ import annotations

from statistics import NormalDist

from arrearview.plans import vintages as v
from arrearview.workload.registry import query
from arrearview.workload.sqlstats import MH_ROUND, MIN_N, mh, oe, oes, prop, props, rr, rrs

B = "as bigint"


def sums(dims: str, where: str = "true") -> str:
    """Vintage cells by dims."""
    return (f"select {dims}, cast(sum(n_loans) {B}) n, cast(sum(n_full) {B}) n_full, cast(sum(k) {B}) k, "
            f"cast(sum(k_nt) {B}) k_nt, cast(sum(k_due) {B}) k_due from m_vin where {where} group by all")


def long(dims: str, where: str = "true") -> str:
    """The same with one row per definition."""
    cells = sums(dims, where)
    return (f"select {dims}, 'primary' definition, n, k from ({cells}) c union all "
            f"select {dims}, 'no_threshold', n, k_nt from ({cells}) c")


LABELLED = "contract_type not in ('(unknown)', 'Unknown')"
MOBS = "mob in (6, 12, 24)"
NAMED = "channel_type not in ('(unknown)', 'Unknown', 'Other')"
PRODUCTS = "contract_type in ('Cash loans', 'Consumer loans', 'Revolving loans')"

query("vintage_levels", f"""
select mob, scope, contract_type, channel_type, n, n_full, k, k_nt, {prop('k', 'n', 'primary')},
  {prop('k_nt', 'n', 'no_threshold')}
from (
  select mob, 'all' scope, null contract_type, null channel_type, n, n_full, k, k_nt
  from ({sums('mob', 'mob in (0, 6, 12, 24)')}) a
  union all select mob, 'labelled', null, null, n, n_full, k, k_nt
  from ({sums('mob', "mob in (0, 6, 12, 24) and contract_type <> '(unknown)'")}) b
  union all select mob, 'all', contract_type, null, n, n_full, k, k_nt
  from ({sums('mob, contract_type', 'mob in (0, 6, 12, 24)')}) c
  union all select mob, 'all', null, channel_type, n, n_full, k, k_nt
  from ({sums('mob, channel_type', 'mob in (0, 6, 12, 24)')}) d
  union all select mob, 'all', contract_type, channel_type, n, n_full, k, k_nt
  from ({sums('mob, contract_type, channel_type', 'mob in (0, 6, 12, 24)')}) e) u""",
      *props("primary", "no_threshold"))(lambda b: v.levels(b.vintage, b.d))

query("product_ratios", f"""
select p.mob, p.definition, p.contract_type, p.k k1, p.n n1, c.k k0, c.n n0, {rr('p.k', 'p.n', 'c.k', 'c.n', 'rr')}
from ({long('mob, contract_type', f'mob = 12 and {LABELLED}')}) p
join ({long('mob, contract_type', "mob = 12 and contract_type = 'Cash loans'")}) c using (mob, definition)
where p.contract_type <> 'Cash loans'""", *rrs("rr"))(lambda b: v.product_ratios(b.vintage, b.d))

CHANNEL = long("mob, contract_type, channel_type", f"{MOBS} and {LABELLED}")
query("channel_smr", f"""
select mob, definition, channel_type, n, observed, expected, {oe('observed', 'expected')},
  {prop('observed', 'n', 'crude')}
from (
  select c.mob, c.definition, channel_type, cast(sum(c.n) {B}) n, cast(sum(c.k) {B}) observed,
    sum(c.n * (p.k / cast(p.n as double))) expected
  from ({CHANNEL}) c join ({long('mob, contract_type', f'{MOBS} and {LABELLED}')}) p
    using (mob, definition, contract_type) group by all) s""", "expected", *oes(), *props("crude"))(
    lambda b: v.channel_smr(b.vintage, b.d))
query("channel_product_mix", f"""
select c.mob, c.channel_type, c.contract_type, c.n, c.n / cast(t.n as double) "share"
from ({sums('mob, channel_type, contract_type', f'{MOBS} and {LABELLED}')}) c
join ({sums('mob, channel_type', f'{MOBS} and {LABELLED}')}) t using (mob, channel_type)""", '"share"')(
    lambda b: v.channel_product_mix(b.vintage, b.d))
query("reference_rates", f"""
select mob, contract_type, definition, n, k, {prop('k', 'n', 'rate')}
from ({long('mob, contract_type', f'{MOBS} and {LABELLED}')}) c""", *props("rate"))(
    lambda b: v.reference_rates(b.vintage, b.d))

PAIRS = f"""
select a.mob, a.definition, a.contract_type, a.channel_type unit_a, b.channel_type unit_b,
  a.k k1, a.n n1, b.k k0, b.n n0
from ({CHANNEL}) a, ({CHANNEL}) b
where a.mob = b.mob and a.definition = b.definition and a.contract_type = b.contract_type
  and a.channel_type < b.channel_type and a.n >= {MIN_N} and b.n >= {MIN_N}
  and a.{NAMED} and b.{NAMED} and a.{PRODUCTS}"""
query("channel_pairs", f"select *, {rr('k1', 'n1', 'k0', 'n0', 'rr')} from ({PAIRS}) p", *rrs("rr"))(
    lambda b: v.channel_pairs(b.vintage, b.d))
POOLED = f"select *, n_strata = 3 in_all_products from ({mh(PAIRS, 'mob, definition, unit_a, unit_b')}) m"
query("channel_pairs_pooled", POOLED, *MH_ROUND)(lambda b: v.channel_pairs_pooled(b.vintage, b.d))
query("pairs_in_all_products", f"""
select mob, unit_a || ' / ' || unit_b pair from ({PAIRS}) p where definition = 'primary'
group by mob, unit_a, unit_b having count(*) = 3""")(
    lambda b: v.pairs_in_all_products(b.vintage, b.d))

KEY = f"""
select a.mob, a.definition, a.contract_type, a.channel_type unit_a, b.channel_type unit_b,
  a.k k1, a.n n1, b.k k0, b.n n0
from ({CHANNEL}) a join ({CHANNEL}) b using (mob, definition, contract_type)
where a.channel_type = 'Stone' and b.channel_type in ('Country-wide', 'Regional / Local', 'Credit and cash offices')
  and {PRODUCTS}"""
query("key_pairs", f"select *, {rr('k1', 'n1', 'k0', 'n0', 'rr')} from ({KEY}) p", *rrs("rr"))(
    lambda b: v.key_pairs(b.vintage, b.d))
query("key_pairs_pooled", mh(f"select * from ({KEY}) k where n1 >= {MIN_N} and n0 >= {MIN_N}",
                             "mob, definition, unit_a, unit_b"), *MH_ROUND)(
    lambda b: v.key_pairs_pooled(b.vintage, b.d))
query("crude_pair", f"""
select a.mob, a.definition, a.channel_type unit_a, b.channel_type unit_b, a.k k1, a.n n1, b.k k0, b.n n0,
  {rr('a.k', 'a.n', 'b.k', 'b.n', 'rr')}
from ({long('mob, channel_type', MOBS)}) a join ({long('mob, channel_type', MOBS)}) b using (mob, definition)
where a.channel_type = 'Stone' and b.channel_type = 'Credit and cash offices'""", *rrs("rr"))(
    lambda b: v.crude_pair(b.vintage, b.d))
query("card_pair", f"""
select *, {rr('k1', 'n1', 'k0', 'n0', 'rr')}, k1 + k0 n_cases_total from ({KEY}) p
where mob = 12 and definition = 'primary' and contract_type = 'Revolving loans'
  and unit_b = 'Credit and cash offices'""", *rrs("rr"))(lambda b: v.card_pair(b.vintage, b.d))

# ---- segment ---------------------------------------------------------------------------------

CL = "contract_type = 'Consumer loans'"


def _grid(dims: str) -> str:
    return f"""
select c.*, t.n tn, t.k tk from ({long('mob, ' + dims, f'{MOBS} and {CL}')}) c
join ({long('mob', f'{MOBS} and {CL}')}) t using (mob, definition)"""


for _name, _dims in (("segment_grid", "client_type, yield_group"), ("yield_grid", "yield_group")):
    query(_name, f"""
select mob, definition, {_dims}, n n1, k k1, tn - n n0, tk - k k0, n / cast(tn as double) share_of_loans,
  k / cast(nullif(tk, 0) as double) share_of_cases, {rr('k', 'n', 'tk - k', 'tn - n', 'rr')}, {prop('k', 'n', 'rate')}
from ({_grid(_dims)}) g""", "share_of_loans", "share_of_cases", *rrs("rr"), *props("rate"))(
        lambda b, dims=_dims: v.segment_grid(b.vintage, dims.split(", "), b.d))
query("segment_totals", f"""
select mob, definition, cast(sum(n) {B}) n, cast(sum(k) {B}) k, count(*) n_combinations,
  count(case when n >= {MIN_N} then 1 end) n_combinations_enough, {prop('sum(k)', 'sum(n)', 'total')}
from ({long('mob, client_type, yield_group', f'{MOBS} and {CL}')}) c group by mob, definition""", *props("total"))(
    lambda b: v.segment_totals(b.vintage, b.d))

_Z = ", ".join(f"({m}, {NormalDist().inv_cdf(1 - 0.025 / m)}e0)" for m in [*range(1, 41), 144])


def _corrected(rows: str) -> str:
    se = "sqrt(1e0/nullif(k, 0) - 1e0/n + 1e0/nullif(tk - k, 0) - 1e0/(tn - n))"
    return f"""
select mob, tests, rr_ratio ratio, rr_ratio * exp(-q * {se}) lo, rr_ratio * exp(q * {se}) hi
from (select *, {rr('k', 'n', 'tk - k', 'tn - n', 'rr')} from ({rows}) r
  where client_type = 'New' and yield_group = 'high') s
join (values {_Z}) z(m, q) on z.m = s.tests"""


_PRIMARY = f"select * from ({_grid('client_type, yield_group')}) g where definition = 'primary'"
query("segment_bonferroni", _corrected(f"""
select p.*, (select greatest(count(*), 1) from ({_PRIMARY}) x where x.mob = p.mob and x.n >= {MIN_N}) tests
from ({_PRIMARY}) p"""), "ratio", "lo", "hi")(lambda b: v.segment_bonferroni(b.vintage, b.d))
query("segment_bonferroni_counts", _corrected(f"""
select p.*, cast(unnest([12, 36, 144]) {B}) tests from ({_PRIMARY}) p where mob = 12"""), "ratio", "lo", "hi")(
    lambda b: v.segment_bonferroni_counts(b.vintage, b.d))


def _split(dims: str, flag: str, where: str) -> str:
    comma = f"{dims}, " if dims else ""
    cells = long("mob, tenor_group, channel_type, client_type, yield_group", f"mob = 12 and {where}")
    return f"""
select {comma}definition, k1, n1, k0, n0, {rr('k1', 'n1', 'k0', 'n0', 'rr')}, {prop('k1', 'n1', 'inside')},
  {prop('k0', 'n0', 'outside')}, n1 / cast(n1 + n0 as double) share_of_loans,
  k1 / cast(nullif(k1 + k0, 0) as double) share_of_cases
from (select {comma}definition, cast(sum(k) filter ({flag}) {B}) k1, cast(sum(n) filter ({flag}) {B}) n1,
    cast(sum(k) filter (not ({flag})) {B}) k0, cast(sum(n) filter (not ({flag})) {B}) n0
  from ({cells}) c group by {comma}definition) s
where n1 is not null and n0 is not null"""


_SPLIT_ROUND = (*rrs("rr"), *props("inside", "outside"), "share_of_loans", "share_of_cases")
_SEG = "client_type = 'New' and yield_group = 'high'"
_FORMER = "channel_type in ('Stone', 'Country-wide')"
query("segment_by_tenor", _split("tenor_group", _SEG, CL), *_SPLIT_ROUND)(lambda b: v.segment_by_tenor(b.vintage, b.d))
query("former_segment", _split("", f"{_FORMER} and {_SEG}", CL), *_SPLIT_ROUND)(
    lambda b: v.former_segment(b.vintage, b.d))
query("channel_condition", _split("", _FORMER, f"{CL} and {_SEG}"), *_SPLIT_ROUND)(
    lambda b: v.channel_condition(b.vintage, b.d))
