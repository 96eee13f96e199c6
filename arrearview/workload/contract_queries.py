"""Transitions, origination, experiments and sensitivity."""

from __future__ import annotations

from arrearview.plans import experiments as x
from arrearview.plans import origination as o
from arrearview.plans import transitions as t
from arrearview.workload.oracle_base import CTES
from arrearview.workload.registry import query
from arrearview.workload.sqlstats import MH_ROUND, arm, arm_rel, mh, prop, props, rr, rrs

B = "as bigint"
STATES = ("B0 Current", "B1 1-30", "B2 31-60", "B3 61-90", "B4 90+", "Closed", "Other", "Missing")

# ---- transitions -----------------------------------------------------------------------------

query("cure_rate", f"""
select definition, from_state, cast(sum(n_loans) {B}) n,
  cast(ifnull(sum(n_loans) filter (to_state = 'B0 Current'), 0) {B}) k,
  ifnull(sum(n_loans) filter (to_state = 'B0 Current'), 0) / cast(sum(n_loans) as double) cure_rate
from m_roll where from_state <> 'B0 Current' group by 1, 2""", "cure_rate")(lambda b: t.cure_rate(b.roll, b.d))
query("portfolio_matrix", f"""
select definition, from_state, to_state, cast(sum(n_loans) {B}) n_loans,
  sum(n_loans) / cast(max(t) as double) rate
from m_roll join (select definition, from_state, sum(n_loans) t from m_roll group by 1, 2) q
  using (definition, from_state) group by 1, 2, 3 order by 1, 2, 3""", "rate")(lambda b: t.portfolio_matrix(b.roll))

_SCOPED = ("(select *, 'all' scope from m_roll union all select *, source from m_roll)")


def _to(condition: str) -> str:
    return f"cast(ifnull(sum(n_loans) filter ({condition}), 0) {B})"


_SUMMARY = f"""
select definition, scope, from_state, from_order, cast(sum(n_loans) {B}) n_from,
  {_to("to_state = 'B0 Current'")} k_cure,
  {_to("to_state = case from_order when 0 then 'B1 1-30' when 1 then 'B2 31-60' when 2 then 'B3 61-90' else 'B4 90+' end")}
    k_forward, {_to("to_state = 'Closed'")} k_closed, {_to("to_state = 'Missing'")} k_missing
from {_SCOPED} s group by 1, 2, 3, 4"""
query("roll_cure_summary", f"""
select *, {prop('k_cure', 'n_from', 'cure')}, {prop('k_forward', 'n_from', 'forward')},
  {prop('k_closed', 'n_from', 'closed')}, {prop('k_missing', 'n_from', 'missing')} from ({_SUMMARY}) q""",
      *props("cure", "forward", "closed", "missing"))(lambda b: t.roll_cure_summary(b.roll, b.d))
query("roll_to_counts", "select definition, scope, from_state, " + ", ".join(
    f"""{_to(f"to_state = '{s}'")} "{s}" """ for s in STATES) + f" from {_SCOPED} s group by 1, 2, 3")(
    lambda b: t.to_counts(b.roll, b.d))
query("roll_totals", f"""
select *, {prop('k_late', 'n_late', 'cure')} from (
  select cast(sum(n_loans) {B}) n_from_all_states,
    cast(sum(n_loans) filter (from_order > 0) {B}) n_late,
    cast(sum(n_loans) filter (from_order > 0 and to_state = 'B0 Current') {B}) k_late
  from m_roll where definition = 'primary') q""", *props("cure"))(lambda b: t.roll_totals(b.roll, b.d))
query("collections_experiment", f"""
select n_from, k_cure, {prop('k_cure', 'n_from', 'cure')}, k_forward, {prop('k_forward', 'n_from', 'forward')},
  {arm_rel('k_cure', 'n_from', '0.2e0')} n_per_arm_cure, {arm_rel('k_forward', 'n_from', '-0.2e0')} n_per_arm_forward,
  20.0e0 * k_cure / n_from relative_change_in_points
from ({_SUMMARY}) q where definition = 'primary' and scope = 'all' and from_order = 1""",
      *props("cure", "forward"), "relative_change_in_points")(lambda b: t.collections_experiment(b.roll, b.d))

_COHORT_CURE = f"""
select cast(12 * floor(first_open_month / 12.0e0) as int) cohort_start, dpd_bucket_order bucket, count(*) n,
  count(case when nm = months_balance + 1 and n_open and nbo = 0 then 1 end) k
from c_next join c_out using (sk_id_prev)
where is_open and months_balance < -1 and dpd_bucket_order in (1, 2) group by 1, 2"""
_SIDES = f"""
select a.cohort_start, a.k k1, a.n n1, z.k k0, z.n n0
from (select * from ({_COHORT_CURE}) c where bucket = 1) a
left join (select * from ({_COHORT_CURE}) c where bucket = 2) z using (cohort_start)"""
query("cure_by_cohort", f"""
select *, cohort_start || ' to ' || (cohort_start + 11) origination_cohort, {prop('k1', 'n1', 'cure_b1')},
  {prop('k0', 'n0', 'cure_b2')} from ({_SIDES}) s""", *props("cure_b1", "cure_b2"))(
    lambda b: t.cure_by_cohort(b.transition_base, b.d))
query("cure_by_cohort_mh", mh(f"select * from ({_SIDES}) s where n0 is not null", ""), *MH_ROUND)(
    lambda b: t.cure_by_cohort_pooled(b.transition_base, b.d))

_FIRST = f"""
select count(*) n, cast(sum(case when nm = months_balance + 1 and n_open and nbo = 0 then 1 else 0 end) {B}) k
from c_next f where is_open and months_balance < -1 and dpd_bucket_order = 1 and months_balance =
  (select min(g.months_balance) from c_fct g where g.sk_id_prev = f.sk_id_prev and g.is_open
   and g.months_balance < -1 and g.dpd_bucket_order = 1)"""
query("first_b1_cure", f"select *, {prop('k', 'n', 'cure')} from ({_FIRST}) q", *props("cure"))(
    lambda b: t.first_b1_cure(b.transition_base, b.d))
_P = "round(k / cast(n as double), 10)"
query("first_b1_sample", f"""
select n, k, c * 100 points, {_P} + c target_rate, {arm(_P, f'{_P} + c', 'c')} n_per_arm
from ({_FIRST}) q, (select unnest([0.03e0, 0.05e0, 0.1e0]) c) z""", "points", "target_rate")(
    lambda b: t.first_b1_sample(b.transition_base, b.d))

_CELLS = "select from_state, to_state, sum(n_loans) n, sum(exposure_from) e from m_roll " \
         "where definition = 'primary' group by 1, 2"
_FROM = ", ".join(f"'{s}'" for s in STATES[:5])
_TO = ", ".join(f"'{s}'" for s in STATES)
query("roll_grid_dense", f"""
select from_state, to_state, cast(ifnull(n, 0) {B}) n_loans, ifnull(e, 0) exposure_from, n is not null observed,
  cast(sum(ifnull(n, 0)) over (partition by from_state) {B}) n_base,
  sum(ifnull(e, 0)) over (partition by from_state) exposure_base,
  ifnull(n, 0) / cast(sum(ifnull(n, 0)) over (partition by from_state) as double) rate
from (select unnest([{_FROM}]) from_state) f cross join (select unnest([{_TO}]) to_state) g
left join ({_CELLS}) c using (from_state, to_state)""", "exposure_from", "exposure_base", "rate")(
    lambda b: t.roll_grid(b.roll, b.d))
query("roll_pivot", "select from_state, " + ", ".join(
    f"""sum(n) filter (to_state = '{s}') / cast(sum(n) as double) "{s}" """ for s in STATES)
    + f" from ({_CELLS}) c group by from_state", *[f'"{s}"' for s in STATES])(lambda b: t.roll_pivot(b.roll, b.d))
query("roll_column_totals", f"""
select to_state, cast(sum(n) {B}) n_loans,
  sum(n) / cast((select sum(n_loans) from m_roll where definition = 'primary') as double) "share"
from ({_CELLS}) c group by to_state""", '"share"')(lambda b: t.roll_column_totals(b.roll, b.d))
_POOL = f"""select {{}} from_state, cast(sum(n) {B}) n, {_to("to_state = 'B0 Current'").replace('n_loans', 'n')} k,
  sum(e) exposure from ({_CELLS}) c where from_state <> 'B0 Current' {{}}"""
query("roll_pooled_cure", f"""
select *, k / cast(n as double) cure from ({_POOL.format('', 'group by from_state')}
  union all {_POOL.replace('from_state, cast', 'cast').format("null from_state,", '')}) u""", "exposure", "cure")(
    lambda b: t.pooled_cure(b.roll, b.d))

# ---- origination -----------------------------------------------------------------------------

_F = ", ".join(f"cast(sum({c}) {B}) {n}" for c, n in (
    ("n_applications", "n_app"), ("n_approved + n_unused_offer + n_refused", "n_dec"),
    ("n_approved + n_unused_offer", "n_off"), ("n_approved", "n_appr"), ("n_unused_offer", "n_unused")))
query("approval_levels", f"""
select *, {prop('n_off', 'n_dec', 'approval')}, {prop('n_appr', 'n_off', 'take_up')} from (
  select contract_type, null channel_type, {_F} from m_fun group by 1
  union all select contract_type, channel_type, {_F} from m_fun group by 1, 2) u""", *props("approval", "take_up"))(
    lambda b: o.approval_levels(b.funnel_by_channel, b.d))
query("approval_standardised", f"""
select channel_type, n_decided, observed, expected, {prop('observed', 'n_decided', 'crude')},
  observed / nullif(expected, 0) standardised_ratio, expected / nullif(n_decided, 0) expected_rate
from (select c.channel_type, cast(sum(c.n_dec) {B}) n_decided, cast(sum(c.n_off) {B}) observed,
    sum(c.n_dec * (p.n_off / cast(p.n_dec as double))) expected
  from (select contract_type, channel_type, {_F} from m_fun group by 1, 2) c
  join (select contract_type, {_F} from m_fun group by 1) p using (contract_type) group by 1) s""",
      "expected", *props("crude"), "standardised_ratio", "expected_rate")(
    lambda b: o.approval_standardised(b.funnel_by_channel, b.d))
query("take_up_consumer", f"""
select channel_type, n_appr, n_off, {prop('n_appr', 'n_off', 'take_up')}
from (select channel_type, {_F} from m_fun where contract_type = 'Consumer loans' group by 1) c""", *props("take_up"))(
    lambda b: o.take_up(b.funnel_by_channel, b.d))
_D = ", ".join(f"cast(sum({c}) {B}) {n}" for c, n in (
    ("n_loans", "n"), ("n_fpd30", "k"), ("n_fpd30_late_rule", "k_late"), ("n_approved_not_activated", "n_idle"),
    ("n_approved_scheduled_no_installment", "n_scheduled")))
query("fpd_levels", f"""
select *, {prop('k', 'n', 'amount_rule')}, {prop('k_late', 'n', 'late_rule')} from (
  select null contract_type, null channel_type, {_D} from m_fpd
  union all select contract_type, null, {_D} from m_fpd group by 1
  union all select contract_type, channel_type, {_D} from m_fpd group by 1, 2 having sum(n_loans) > 0) u""",
      *props("amount_rule", "late_rule"))(lambda b: o.fpd_levels(b.fpd_by_segment, b.d))

# ---- experiments -----------------------------------------------------------------------------

_SEG = """case when not has_application then false when product <> 'Consumer loans' then
  case when product = 'Unknown' then case when client not in ('New', 'Unknown') or yield not in ('high', 'Unknown')
    then false end else false end
  when client not in ('New', 'Unknown') or yield not in ('high', 'Unknown') then false
  when client = 'Unknown' or yield = 'Unknown' then null else true end"""
# One row per product, segment, last age at which the outcome is known, and first ages of delay.
CTES["c_early"] = f"""
select product, {_SEG} is_seg, case when ended then 99 else max_mob end known_to, m1, m30, count(*) w
from c_out where in_base group by all"""
_EARLY = " union all ".join(f"""
select cast({age} as int) mob, product contract_type, is_seg, cast(sum(w) {B}) n,
  cast(ifnull(sum(w) filter (m1 <= {age}), 0) {B}) k_1_plus, cast(ifnull(sum(w) filter (m30 <= {age}), 0) {B}) k_30_plus
from c_early where known_to >= {age} group by product, is_seg""" for age in (3, 6, 12))
query("early_cells", _EARLY)(lambda b: x.early_cells(b.loan_outcome, b.d))
_POP = "select 'consumer_loans_all' population, * from ({0}) e where contract_type = 'Consumer loans' " \
       "union all select 'segment_consumer_new_high', * from ({0}) e where is_seg"
_POP_SUM = f"select population, mob, cast(sum(n) {B}) n, cast(sum(k_1_plus) {B}) k1, cast(sum(k_30_plus) {B}) k30 " \
           f"from ({_POP.format(_EARLY)}) p group by 1, 2"
query("approval_experiment", f"""
select population, mob, n, metric, k, population_size, {prop('k', 'n', 'baseline')},
  {arm_rel('k', 'n', '-0.2e0')} n_per_arm, 2 * {arm_rel('k', 'n', '-0.2e0')} total_both_arms,
  2 * {arm_rel('k', 'n', '-0.2e0')} / cast(population_size as double) multiple_of_population
from (select population, mob, n, 'ever_30_plus' metric, k30 k from ({_POP_SUM}) a
      union all select population, mob, n, 'ever_1_plus', k1 from ({_POP_SUM}) b) c
join (select 'consumer_loans_all' population, count(*) population_size from c_out
      where in_base and product = 'Consumer loans'
      union all select 'segment_consumer_new_high', count(*) from c_out
      where in_base and product = 'Consumer loans' and client = 'New' and yield = 'high') s using (population)""",
      *props("baseline"), "multiple_of_population")(lambda b: x.approval_experiment(b.loan_outcome, b.vintage, b.d))
_CONSUMER12 = "in_base and product = 'Consumer loans' and (max_mob >= 12 or ended)"
query("early_validation", f"""
select *, {prop('k1', 'n1', 'if_early')}, {prop('k0', 'n0', 'if_not')}, {rr('k1', 'n1', 'k0', 'n0', 'rr')},
  k1 / cast(nullif(k1 + k0, 0) as double) share_preceded
from (select count(case when m1 <= 6 and m30 <= 12 then 1 end) k1, count(case when m1 <= 6 then 1 end) n1,
    count(case when m30 <= 12 then 1 end) - count(case when m1 <= 6 and m30 <= 12 then 1 end) k0,
    count(*) - count(case when m1 <= 6 then 1 end) n0 from c_out where {_CONSUMER12}) q""",
      *props("if_early", "if_not"), *rrs("rr"), "share_preceded")(lambda b: x.early_validation(b.loan_outcome, b.d))
CTES["c_cross"] = f"""
select case when m1 <= 6 then 'early' else 'calm' end || case when m30 <= 6 then '_by_6' when m30 <= 12 then '_by_12'
  else '_never' end cell, count(*) w from c_out where {_CONSUMER12} group by 1"""
query("early_split", f"""
select *, {prop('early_by_12', 'turned_late', 'preceded')}, {prop('early_by_12', 'at_risk_early', 'if_early')},
  {prop('calm_by_12', 'at_risk_calm', 'if_not')},
  {rr('early_by_12', 'at_risk_early', 'calm_by_12', 'at_risk_calm', 'rr')}
from (select *, early_by_12 + calm_by_12 turned_late, early_by_12 + early_never at_risk_early,
        calm_by_12 + calm_never at_risk_calm
      from (select {", ".join(f"cast(ifnull(sum(w) filter (cell = '{c}'), 0) {B}) {c}" for c in x.CROSSED)}
            from c_cross) p) q""", *props("preceded", "if_early", "if_not"), *rrs("rr"))(
    lambda b: x.early_split(b.loan_outcome, b.d))
query("card_channel_sample", f"""
select *, {prop('k6', 'n6', 'ever_1_plus')}, {prop('k12', 'n12', 'ever_30_plus')},
  {arm_rel('k6', 'n6', '-0.2e0')} n_per_arm_1_plus, {arm_rel('k12', 'n12', '-0.2e0')} n_per_arm_30_plus,
  2.0e0 * {arm_rel('k6', 'n6', '-0.2e0')} / population multiple_1_plus,
  2.0e0 * {arm_rel('k12', 'n12', '-0.2e0')} / population multiple_30_plus
from (select count(*) population, count(*) filter (ended or max_mob >= 6) n6,
    count(*) filter ((ended or max_mob >= 6) and m1 <= 6) k6, count(*) filter (ended or max_mob >= 12) n12,
    count(*) filter ((ended or max_mob >= 12) and m30 <= 12) k12
  from c_out where in_base and product = 'Revolving loans' and channel = 'Contact center') q""",
      *props("ever_1_plus", "ever_30_plus"), "multiple_1_plus", "multiple_30_plus")(
    lambda b: x.card_channel_sample(b.loan_outcome, b.d))

# ---- sensitivity -----------------------------------------------------------------------------

# Which endings each rule admits at ages that a contract did not live to see.
_ADMITS = """(values ('main', 'closed'), ('main', 'closed, paid'), ('main', 'closed_inferred'),
  ('main', 'closed_inferred, paid'), ('legacy', 'closed'), ('legacy', 'closed, paid'), ('legacy_plus_rem0', 'closed'),
  ('legacy_plus_rem0', 'closed, paid'), ('legacy_plus_rem0', 'closed_inferred, paid'),
  ('legacy_plus_rem0', 'unknown, paid')) as a(rule, ending)"""
CTES["c_endings"] = """
select product, end_state || case when installments_remaining_at_last = 0 then ', paid' else '' end ending, max_mob,
  m30, m30_nt, count(*) w
from c_out where in_base group by all"""
_AGES = "(select cast(unnest([6, 12, 24]) as int) mob) g"
query("denominator_rules", f"""
select *, {prop('k', 'n', 'primary')}, {prop('k_nt', 'n', 'no_threshold')} from (
  select rule, mob, product contract_type, cast(sum(w) {B}) n, cast(ifnull(sum(w) filter (m30 <= mob), 0) {B}) k,
    cast(ifnull(sum(w) filter (m30_nt <= mob), 0) {B}) k_nt
  from (select rule, mob, product, m30, m30_nt, w from c_endings join {_AGES} on max_mob >= mob,
          (select distinct rule from {_ADMITS}) r
        union all
        select rule, mob, product, m30, m30_nt, w from c_endings join {_ADMITS} using (ending)
          join {_AGES} on max_mob < mob) u
  group by grouping sets ((rule, mob), (rule, mob, product))) s""", *props("primary", "no_threshold"))(
    lambda b: x.denominator_rules(b.loan_outcome, b.d))
# Medians from counts: the first value that half of the rows do not exceed, and that more than half do not exceed.
CTES["c_stops"] = """
select last_observed_month >= -4 stopped_late, source, end_state, installments_remaining_at_last rem, count(*) w
from c_dim where end_state in ('closed_inferred', 'unknown') group by all"""
query("stop_profile", f"""
select stopped_late, source, end_state, cast(sum(w) {B}) n_contracts,
  cast(ifnull(sum(w) filter (rem = 0), 0) {B}) n_nothing_left,
  (min(rem) filter (2 * upto >= known) + min(rem) filter (2 * upto > known)) / 2.0e0 median_left
from (select *, case when rem is not null then sum(w) over (partition by stopped_late, source, end_state order by rem
          nulls last) end upto, sum(case when rem is not null then w end) over (partition by stopped_late, source,
          end_state) known from c_stops) c
group by 1, 2, 3""", "median_left")(lambda b: x.stop_profile(b.dim_loan))
query("stopped_between", "select count(*) n_stop_between_5_16 from c_dim where last_observed_month >= -16 and "
                         "last_observed_month <= -5 and end_state in ('closed_inferred', 'unknown')")(
    lambda b: x.stopped_between(b.dim_loan))
CTES["c_lone"] = """
select in_base, is_partial_history partial, first_open_month is null never_open, m30 <= 12 bad, case
    when max_mob >= 12 then 'seen' when ended then 'ended' when end_state = 'unknown' then 'lost' else 'open' end verdict,
  count(*) w
from c_out where not has_application group by all"""
_SETS = "(values " + ", ".join(f"('{n}', '{v}')" for n, vs in x.VERDICTS.items() for v in vs) + ") as v(name, verdict)"
query("unknown_in_vintage", f"""
select *, {prop('n_partial', 'n_contracts', 'partial')}, {prop('k_counted', 'n_counted', 'counted')},
  {prop('k_if_counted', 'n_if_counted', 'if_counted')}
from (select cast(ifnull(sum(w), 0) {B}) n_contracts, cast(ifnull(sum(w) filter (partial), 0) {B}) n_partial,
        cast(ifnull(sum(w) filter (never_open), 0) {B}) n_never_open,
        cast(ifnull(sum(w) filter (in_base), 0) {B}) n_base from c_lone) a,
     (select {", ".join(f"cast(ifnull(sum(w) filter (name = '{n}'), 0) {B}) n_{n}, "
                        f"cast(ifnull(sum(w) filter (name = '{n}' and bad), 0) {B}) k_{n}" for n in x.VERDICTS)}
      from c_lone join {_SETS} using (verdict) where in_base) s""", *props("partial", "counted", "if_counted"))(
    lambda b: x.unknown_in_vintage(b.loan_outcome, b.d))
# Cash contracts past due today: age now and age when first past due, as counts.
CTES["c_today"] = """
select l.channel = 'Credit and cash offices' at_offices, f.mob age, l.m30 first_age, l.is_partial_history partial, count(*) w
from c_fct f join c_out l using (sk_id_prev)
where f.months_balance = -1 and f.is_open and f.dpd > 30 and l.has_application and l.product = 'Cash loans' group by all"""


def _half(value: str) -> str:
    """Flag and value of the first row that half of the rows of its flag do not exceed."""
    return f"""(select at_offices, min({value}) at_half from (
      select at_offices, {value}, sum(w) over (partition by at_offices order by {value}) upto,
        sum(w) over (partition by at_offices) total
      from (select * from c_today union all select * replace (null as at_offices) from c_today) u) o
    where 2 * upto >= total group by 1)"""


query("late_timing_grouping_sets", f"""
select s.*, cast(a.at_half as int) median_age, cast(b.at_half as int) median_first_age,
  {prop('n_first_after_12', 'n_contracts', 'after_12')}
from (select at_offices, cast(sum(w) {B}) n_contracts, min(age) youngest, max(age) oldest,
        cast(ifnull(sum(w) filter (first_age > 12), 0) {B}) n_first_after_12,
        cast(ifnull(sum(w) filter (partial), 0) {B}) n_partial
      from c_today group by grouping sets ((), (at_offices))) s
join {_half('age')} a on a.at_offices is not distinct from s.at_offices
join {_half('first_age')} b on b.at_offices is not distinct from s.at_offices""", *props("after_12"))(
    lambda b: x.late_timing(b.open_months, b.d))
query("inferred_closed_cases", """
select count(*) n_cases, count(case when z.is_30_plus then 1 end) n_last_month_30_plus
from c_out l join (select sk_id_prev, is_30_plus from c_fct f where months_balance =
    (select max(g.months_balance) from c_fct g where g.sk_id_prev = f.sk_id_prev)) z using (sk_id_prev)
where l.end_state = 'closed_inferred' and not l.is_partial_history and l.product = 'Consumer loans'
  and l.m30 <= 12""")(lambda b: x.inferred_closed_cases(b.loan_outcome))
