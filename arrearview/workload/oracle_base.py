"""Shared CTEs of the DuckDB check queries.

The raw tables follow FIXTURES.md. The layers above them are counted by another route than the
Spark plans take where there is one (a count of card rows, ranked look-ups, a table of endings,
running sums of changes by age), so that a query and its check agree only if both are right.
"""

from __future__ import annotations

import re

OPEN = "('Active', 'Demand', 'Amortized debt')"

CTES: dict[str, str] = {}

# ---- raw tables ------------------------------------------------------------------------------

CTES["base"] = """
select *, least(-1, nat_end) as last_m from (
  select o_orderkey as k, o_custkey as cust, cast(floor(o_totalprice) as bigint) as amt,
    cast(-96 + (o_orderkey*37) % 94 as int) as first_m,
    cast(-96 + (o_orderkey*37) % 94 + 2 + (o_orderkey*11) % 40 as int) as nat_end,
    cast(6 + 6*(cast(floor(o_orderkey/7) as int) % 6) as int) as tenor,
    case when o_orderkey%10=8 then 'Revolving loans' when o_orderkey%10 in (6,7) then 'Cash loans'
         when o_orderkey%100=99 then 'XNA' else 'Consumer loans' end as product
  from orders) t
"""
CTES["application_train"] = """
select c_custkey as sk_id_curr, cast(case when c_custkey%12=0 then 1 else 0 end as int) as target,
  case when c_custkey%9=0 then 'Revolving loans' else 'Cash loans' end as name_contract_type,
  case c_custkey%7 when 0 then 'XNA' when 1 then 'M' when 2 then 'M' when 3 then 'M' else 'F' end as code_gender,
  c_custkey%4 as cnt_children, cast(20000 + (c_custkey*731)%180000 as double) as amt_income_total,
  cast(50000 + (c_custkey*577)%400000 as double) as amt_credit,
  cast(2000 + (c_custkey*91)%20000 as double) as amt_annuity,
  cast(45000 + (c_custkey*577)%400000 as double) as amt_goods_price, c_mktsegment as name_income_type,
  case c_custkey%3 when 0 then 'Secondary' when 1 then 'Higher' else 'Lower' end as name_education_type,
  case c_custkey%2 when 0 then 'Married' else 'Single' end as name_family_status,
  case c_custkey%5 when 0 then 'Rented' else 'House' end as name_housing_type,
  case when c_custkey%6=0 then null else 'Laborers' end as occupation_type,
  1 + c_custkey%3 as region_rating_client, -(7000 + (c_custkey*97)%18000) as days_birth,
  case when c_custkey%6=0 then 365243 else -((c_custkey*53)%9000) end as days_employed,
  case when c_custkey%3=0 then null else ((c_custkey*31)%1000)/1000.0e0 end as ext_source_1,
  ((c_custkey*17)%1000)/1000.0e0 as ext_source_2, ((c_custkey*7)%1000)/1000.0e0 as ext_source_3
from customer
"""
CTES["previous_application"] = """
select k as sk_id_prev, cust as sk_id_curr, product as name_contract_type,
  case product when 'Revolving loans' then 'Cards' when 'Cash loans' then 'Cash' when 'XNA' then 'XNA'
    else 'POS' end as name_portfolio,
  case k%3 when 0 then 'XNA' when 1 then 'x-sell' else 'walk-in' end as name_product_type,
  case cast(floor(k/10) as int)%9 when 0 then 'Country-wide' when 1 then 'Country-wide' when 2 then 'Stone'
    when 3 then 'Regional / Local' when 4 then 'Credit and cash offices' when 5 then 'Contact center'
    when 6 then 'AP+ (Cash loan)' when 7 then 'Car dealer' else 'Channel of corporate sales' end as channel_type,
  case cast(floor(k/3) as int)%4 when 0 then 'New' when 1 then 'Repeater' when 2 then 'Refreshed'
    else 'XNA' end as name_client_type,
  case cast(floor(k/7) as int)%5 when 0 then 'high' when 1 then 'middle' when 2 then 'low_normal'
    when 3 then 'low_action' else 'XNA' end as name_yield_group,
  case k%4 when 0 then 'POS household' when 1 then 'Cash' when 2 then 'Card Street'
    else 'POS mobile' end as product_combination,
  case when k%5=0 then 'XNA' else 'Mobile' end as name_goods_category,
  case when k%6=0 then 'XNA' else 'Consumer electronics' end as name_seller_industry,
  case k%8 when 0 then 'XNA' when 1 then 'XAP' else 'Repairs' end as name_cash_loan_purpose,
  case when k%13<9 then 'Approved' when k%13 in (9,10) then 'Refused' when k%13=11 then 'Canceled'
    else 'Unused offer' end as name_contract_status,
  case when k%13 in (9,10) then (case k%2 when 0 then 'HC' else 'XNA' end) else 'XAP' end as code_reject_reason,
  30*first_m - 15 as days_decision, cast(amt+1000 as double) as amt_application, cast(amt as double) as amt_credit,
  cast(floor(amt/tenor) as double) as amt_annuity, cast(floor(amt/10) as double) as amt_down_payment,
  cast(amt as double) as amt_goods_price, case when k%50=1 then null else tenor end as cnt_payment,
  cast(365243 as int) as days_first_drawing,
  cast(case when k%17=3 then 365243 else 30*first_m end as int) as days_first_due,
  30*(first_m+tenor) as days_last_due_1st_version,
  cast(case when k%3=1 then 365243 else 30*last_m end as int) as days_last_due,
  cast(case when k%3=0 then 30*last_m+20 when k%3=1 then 365243 else null end as int) as days_termination,
  case when k%97=0 then 'N' else 'Y' end as flag_last_appl_per_contract,
  cast(case when k%89=0 then 0 else 1 end as int) as nflag_last_appl_in_day,
  cast(case when k%4=0 then 1 else 0 end as int) as nflag_insured_on_approval
from base where k%21<>4
"""
CTES["panel"] = """
select *, dpd_def + case when rem=0 then k%70 else 0 end as dpd_raw from (
  select k, cust, amt, product, first_m, nat_end, tenor, m, m-first_m as i,
    case when k%211=0 then 'Signed' when k%29=0 and m=first_m then 'Signed'
         when m=nat_end and k%31=0 then 'Returned to the store' when m=nat_end and k%4<>0 then 'Completed'
         when k%101=0 then 'Demand' when k%103=0 then 'Amortized debt' else 'Active' end as st,
    case when k%7 in (0,3) and m-first_m-(k*13)%20 between 0 and cast(floor(k/7) as int)%7
         then 1+k%29+30*(m-first_m-(k*13)%20) else 0 end as dpd_def,
    greatest(tenor-(m-first_m)-case when k%23=0 then 1 else 0 end,0) as rem
  from (select *, unnest(range(first_m,last_m+1)) as m from base) e
  where not (k%53=0 and m-first_m=2)) h
"""
CTES["pos_cash_balance"] = """
select k as sk_id_prev, cust as sk_id_curr, cast(m as int) as months_balance,
  cast(tenor as double) as cnt_instalment, cast(rem as double) as cnt_instalment_future,
  st as name_contract_status, dpd_raw as sk_dpd, dpd_def as sk_dpd_def
from panel where product<>'Revolving loans'
union all
select k,cust,cast(m as int),cast(tenor as double),cast(rem as double),st,dpd_raw+5,dpd_def+5 from panel
where product<>'Revolving loans' and k%61=0 and i=1
union all
select k,cust,cast(m as int),cast(tenor as double),cast(rem as double),st,0,0 from panel
where product='Revolving loans' and k%67=0
"""
CTES["credit_card_balance"] = """
select k as sk_id_prev, cust as sk_id_curr, cast(m as int) as months_balance,
  cast((amt*(i+1))%90000-500 as double) as amt_balance, cast(90000 as double) as amt_credit_limit_actual,
  cast((amt*(i+1))%90000 as double) as amt_total_receivable, cast(500 as double) as amt_inst_min_regularity,
  cast((k*(i+1))%4000 as double) as amt_payment_total_current,
  cast((k*(i+2))%6000 as double) as amt_drawings_current,
  (k+i)%5 as cnt_drawings_current, cast(i as int) as cnt_instalment_mature_cum, st as name_contract_status,
  dpd_def + case when i>20 then k%70 else 0 end as sk_dpd, dpd_def as sk_dpd_def
from panel where product='Revolving loans'
"""
CTES["installments_payments"] = """
select k as sk_id_prev, cust as sk_id_curr, cast(v as int) as num_instalment_version,
  cast(n as int) as num_instalment_number, cast(30*first_m+30*(n-1) as int) as days_instalment,
  cast(case when k%37=5 and part=2 then null
       else 30*first_m+30*(n-1) + case when k%19=2 then 35 else cast(k%12 as int)-6 end end as int)
    as days_entry_payment,
  cast(floor(amt/tenor) as double) as amt_instalment,
  case when k%37=5 and part=2 then null when k%41=7 then cast(floor(amt/tenor/4) as double)
       else cast(floor(amt/tenor/2) as double)+1 end as amt_payment
from (select *, unnest([1,2,3]) as n from base where product<>'Revolving loans' and k%17<>3) b
cross join (values (1,1),(1,2),(2,1)) z(v,part) where v=1 or k%6=0
union all
select k, cust, 0, 1, 30*first_m, 30*first_m-1, cast(500 as double), cast(500 as double) from base
where product='Revolving loans' and k%2=0 and k%17<>3
"""

# ---- staging ---------------------------------------------------------------------------------


def _void(column: str, *codes: str) -> str:
    return f"case when {column} in ({', '.join(codes)}) then null else {column} end"


CTES["s_app"] = f"""
select sk_id_curr, target, name_contract_type contract_type, {_void('code_gender', "'XNA'")} gender,
  cnt_children children_count, amt_income_total income_total, amt_credit credit_amount,
  amt_annuity annuity_amount, amt_goods_price goods_price, name_income_type income_type,
  name_education_type education_type, name_family_status family_status, name_housing_type housing_type,
  occupation_type, region_rating_client, cast(days_birth as double) / -365.25e0 age_years,
  cast({_void('days_employed', '365243')} as double) / -365.25e0 employed_years,
  ext_source_1, ext_source_2, ext_source_3
from application_train
"""
CTES["s_prev"] = f"""
select sk_id_prev, sk_id_curr, {_void('name_contract_type', "'XNA'")} contract_type,
  {_void('name_portfolio', "'XNA'")} portfolio, {_void('name_product_type', "'XNA'")} product_type, channel_type,
  {_void('name_client_type', "'XNA'")} client_type, {_void('name_yield_group', "'XNA'")} yield_group,
  product_combination, {_void('name_goods_category', "'XNA'")} goods_category,
  {_void('name_seller_industry', "'XNA'")} seller_industry,
  {_void('name_cash_loan_purpose', "'XNA'", "'XAP'")} cash_loan_purpose,
  name_contract_status application_status, {_void('code_reject_reason', "'XNA'", "'XAP'")} reject_reason,
  days_decision, amt_application application_amount, amt_credit credit_amount, amt_annuity annuity_amount,
  amt_down_payment down_payment_amount, amt_goods_price goods_price, cnt_payment tenor_months,
  {_void('days_first_drawing', '365243')} days_first_drawing, {_void('days_first_due', '365243')} days_first_due,
  {_void('days_last_due_1st_version', '365243')} days_last_due_1st_version,
  {_void('days_last_due', '365243')} days_last_due, {_void('days_termination', '365243')} days_termination,
  flag_last_appl_per_contract = 'Y' is_last_appl_per_contract, nflag_last_appl_in_day = 1 is_last_appl_in_day,
  nflag_insured_on_approval = 1 is_insured
from previous_application
"""
CTES["s_pos"] = """
select sk_id_prev, sk_id_curr, months_balance, cnt_instalment installments_total,
  cnt_instalment_future installments_remaining, name_contract_status contract_status, sk_dpd dpd_raw,
  sk_dpd_def dpd_def
from pos_cash_balance
"""
CTES["s_card"] = """
select sk_id_prev, sk_id_curr, months_balance, amt_balance balance_amount, amt_credit_limit_actual credit_limit,
  amt_total_receivable total_receivable, amt_inst_min_regularity min_installment_amount,
  amt_payment_total_current payment_amount, amt_drawings_current drawings_amount,
  cnt_drawings_current drawings_count, cnt_instalment_mature_cum installments_matured_cum,
  name_contract_status contract_status, sk_dpd dpd_raw, sk_dpd_def dpd_def
from credit_card_balance
"""
CTES["s_inst"] = """
select sk_id_prev, sk_id_curr, num_instalment_version installment_version,
  num_instalment_number installment_number, days_instalment days_due, days_entry_payment days_paid,
  amt_instalment installment_amount, amt_payment payment_amount, days_entry_payment - days_instalment days_late
from installments_payments
"""

# ---- core ------------------------------------------------------------------------------------

CTES["c_int"] = """
select sk_id_prev, sk_id_curr, source, months_balance, contract_status, dpd_raw, dpd_def, installments_total,
  installments_remaining, balance_amount, credit_limit
from (
  select *, row_number() over (partition by sk_id_prev, months_balance order by dpd_def desc nulls last,
      dpd_raw desc nulls last, contract_status desc nulls last, installments_remaining desc nulls last,
      installments_total desc nulls last, balance_amount desc nulls last, credit_limit desc nulls last,
      sk_id_curr desc nulls last) place
  from (select *, count(*) filter (source = 'credit_card') over (partition by sk_id_prev) n_card
        from (select 'pos_cash' source, * from s_pos
              union all by name select 'credit_card' source, * from s_card) u) c
  where n_card = 0 or source = 'credit_card') r
where place = 1
"""
# How a contract ended, by what is known of it; null: does not matter.
_ENDINGS = """(values ('never_open', false, null, null, null), ('closed', true, true, null, null),
  ('censored', true, false, true, null), ('closed_inferred', true, false, false, true),
  ('unknown', true, false, false, false)) as t(end_state, opened, completed, at_window_end, has_end_date)"""
CTES["c_dim"] = f"""
select e.sk_id_prev, e.sk_id_curr, e.source, a.contract_type, a.portfolio, a.product_type, a.channel_type,
  a.client_type, a.yield_group, a.product_combination, a.goods_category, a.seller_industry, a.credit_amount,
  a.annuity_amount, a.down_payment_amount, a.tenor_months, a.days_decision,
  e.first_observed_month, e.first_open_month, e.last_observed_month,
  e.last_observed_month - e.first_open_month max_mob, s.contract_status last_status,
  r.installments_remaining installments_remaining_at_last, e.n_months_observed, a.days_termination,
  t.end_state,
  e.first_observed_month = (select min(months_balance) from c_int) is_left_truncated,
  p.paid installments_paid_at_open,
  e.first_observed_month = (select min(months_balance) from c_int) or coalesce(p.paid > 0, false) is_partial_history,
  a.sk_id_prev is not null has_application
from (select sk_id_prev, min(sk_id_curr) sk_id_curr, min(source) source, min(months_balance) first_observed_month,
        min(case when contract_status in {OPEN} then months_balance end) first_open_month,
        max(months_balance) last_observed_month, count(*) n_months_observed
      from c_int group by sk_id_prev) e
left join (select *, row_number() over (partition by sk_id_prev order by months_balance desc) j from c_int
           where contract_status is not null) s on s.sk_id_prev = e.sk_id_prev and s.j = 1
left join (select *, row_number() over (partition by sk_id_prev order by months_balance desc) j from c_int
           where installments_remaining is not null) r on r.sk_id_prev = e.sk_id_prev and r.j = 1
left join (select sk_id_prev, installments_total - installments_remaining paid,
             row_number() over (partition by sk_id_prev order by months_balance) j from c_int
           where contract_status in {OPEN} and installments_total - installments_remaining is not null) p
  on p.sk_id_prev = e.sk_id_prev and p.j = 1
left join s_prev a on a.sk_id_prev = e.sk_id_prev
join {_ENDINGS} on t.opened = (e.first_open_month is not null)
  and ifnull(t.completed = ifnull(s.contract_status = 'Completed', false), true)
  and ifnull(t.at_window_end = (e.last_observed_month = -1), true)
  and ifnull(t.has_end_date = (a.days_termination is not null), true)
"""


def _bucket(days: str) -> str:
    """Bucket number by counting the edges passed."""
    return f"cast(cast({days} <> 0 as int) + cast({days} > 30 as int) + cast({days} > 60 as int) " \
           f"+ cast({days} > 90 as int) as int)"


def _bucket_name(number: str) -> str:
    return f"['B0 Current', 'B1 1-30', 'B2 31-60', 'B3 61-90', 'B4 90+'][{number} + 1]"


CTES["c_fct"] = f"""
select sk_id_prev, sk_id_curr, source, months_balance, months_balance - first_open_month mob, contract_status,
  contract_status in {OPEN} is_open, contract_status = 'Completed' is_closed,
  dpd_def dpd, b dpd_bucket_order, {_bucket_name('b')} dpd_bucket, b >= 2 is_30_plus, b = 4 is_90_plus,
  dpd_raw dpd_no_threshold, bn dpd_bucket_order_no_threshold, {_bucket_name('bn')} dpd_bucket_no_threshold,
  bn >= 2 is_30_plus_no_threshold, bn = 4 is_90_plus_no_threshold,
  cast(1 + cast(dpd_def >= 10 as int) + cast(dpd_def > 90 as int) + cast(dpd_def > 180 as int)
    + cast(dpd_def > 360 as int) as int) debt_group_vn,
  case source when 'pos_cash' then installments_remaining * annuity_amount
    else case when balance_amount is not null then greatest(balance_amount, 0) end end exposure_proxy,
  credit_limit, installments_total, installments_remaining
from (select m.*, x.first_open_month, x.annuity_amount, {_bucket('m.dpd_def')} b, {_bucket('m.dpd_raw')} bn
      from c_int m, c_dim x where x.sk_id_prev = m.sk_id_prev and m.months_balance >= x.first_open_month) q
"""


def _named(column: str, applied: str | None = "has_application") -> str:
    inner = column
    if column.split(".")[-1] == "channel_type":
        inner = f"case when {column} in ('Car dealer', 'Channel of corporate sales') then 'Other' else {column} end"
    text = f"ifnull({inner}, 'Unknown')"
    return text if applied is None else f"case when not {applied} then '(unknown)' else {text} end"


CTES["c_out"] = f"""
select x.sk_id_prev, x.source, {_named('x.contract_type', 'x.has_application')} product,
  {_named('x.channel_type', 'x.has_application')} channel, {_named('x.client_type', 'x.has_application')} client,
  {_named('x.yield_group', 'x.has_application')} yield,
  case when not x.has_application then '(unknown)' when x.source = 'credit_card' then 'Revolving'
    when x.tenor_months > 24 then '>24m' when x.tenor_months > 12 then '13-24m'
    when x.tenor_months is not null then '<=12m' else 'Unknown' end tenor,
  x.has_application, x.is_partial_history, x.end_state, x.max_mob, x.first_open_month, x.last_observed_month,
  x.installments_remaining_at_last, x.end_state in ('closed', 'closed_inferred') ended,
  x.end_state <> 'never_open' and not x.is_partial_history in_base,
  (select min(mob) from c_fct f where f.sk_id_prev = x.sk_id_prev and f.dpd > 0) m1,
  (select min(mob) from c_fct f where f.sk_id_prev = x.sk_id_prev and f.dpd > 30) m30,
  (select min(mob) from c_fct f where f.sk_id_prev = x.sk_id_prev and f.dpd_no_threshold > 30) m30_nt,
  (select min(mob) from c_fct f where f.sk_id_prev = x.sk_id_prev and case when f.source = 'credit_card'
     then f.dpd > 30 else f.dpd_no_threshold > 30 and f.installments_remaining > 0 end) m30_due,
  (select min(mob) from c_fct f where f.sk_id_prev = x.sk_id_prev and f.dpd_no_threshold > 30
     and (f.source = 'credit_card' or f.installments_remaining > 0)) m30_due_raw
from c_dim x
"""

# ---- marts -----------------------------------------------------------------------------------

# The vintage as running sums of what changes at each age: contracts enter at 0, are last seen at max_mob,
# leave the base after it unless they ended, and turn late at a first age.
_SEGMENT = "source, contract_type, channel_type, client_type, yield_group, tenor_group, origination_cohort_start"
_BASE = """(select source, product contract_type, channel channel_type, client client_type, yield yield_group,
  tenor tenor_group, cast(12 * floor(first_open_month / 12.0e0) as int) origination_cohort_start, max_mob,
  cast(not ended as int) leaves, m30, m30_nt, m30_due from c_out where in_base) b"""
CTES["c_steps"] = f"""
select {_SEGMENT}, age, sum(loan) loan, sum(seen) seen, sum(late) late, sum(late_nt) late_nt, sum(late_due) late_due
from (
  select {_SEGMENT}, 0 age, 1 loan, 1 seen, 0 late, 0 late_nt, 0 late_due from {_BASE}
  union all select {_SEGMENT}, max_mob + 1, -leaves, -1, -leaves * cast(m30 is not null as int),
    -leaves * cast(m30_nt is not null as int), -leaves * cast(m30_due is not null as int) from {_BASE}
  union all select {_SEGMENT}, m30, 0, 0, 1, 0, 0 from {_BASE} where m30 is not null
  union all select {_SEGMENT}, m30_nt, 0, 0, 0, 1, 0 from {_BASE} where m30_nt is not null
  union all select {_SEGMENT}, m30_due, 0, 0, 0, 0, 1 from {_BASE} where m30_due is not null) u
group by all
"""
CTES["m_vin"] = f"""
select * from (
  select {_SEGMENT}, cast(age as int) mob, {", ".join(
    f"cast(sum(ifnull({c}, 0)) over (partition by {_SEGMENT} order by age) as bigint) {n}" for c, n in (
        ("loan", "n_loans"), ("seen", "n_full"), ("late", "k"), ("late_nt", "k_nt"), ("late_due", "k_due")))}
  from (select {_SEGMENT}, unnest(range(37)) age from c_steps group by {_SEGMENT}) g
  left join c_steps using ({_SEGMENT}, age)) r
where n_loans > 0
"""
CTES["c_next"] = """
select f.*, n.months_balance nm, n.is_open n_open, n.is_closed n_closed, n.dpd_bucket nb, n.dpd_bucket_order nbo,
  n.dpd_bucket_no_threshold nb_nt, n.exposure_proxy ne
from (select *, row_number() over (partition by sk_id_prev order by months_balance) j from c_fct) f
left join (select *, row_number() over (partition by sk_id_prev order by months_balance) j from c_fct) n
  on n.sk_id_prev = f.sk_id_prev and n.j = f.j + 1
"""


def _cells(definition: str, sfx: str) -> str:
    return f"""
select '{definition}' definition, f.source, {_named('x.contract_type', 'x.has_application')} contract_type,
  {_named('x.channel_type', 'x.has_application')} channel_type, f.dpd_bucket{sfx} from_state,
  f.dpd_bucket_order{sfx} from_order,
  case when f.nm is distinct from f.months_balance + 1 then 'Missing'
       when f.n_open then f.nb{'_nt' if sfx else ''} when f.n_closed then 'Closed' else 'Other' end to_state,
  count(*) n_loans, count(case when f.nm > f.months_balance + 1 then 1 end) n_month_gap,
  count(*) - count(f.exposure_proxy) n_exposure_null, ifnull(sum(f.exposure_proxy), 0) exposure_from,
  ifnull(sum(case when f.nm = f.months_balance + 1 then f.ne end), 0) exposure_to
from c_next f join c_dim x on x.sk_id_prev = f.sk_id_prev
where f.is_open and f.months_balance <= -2 group by all"""


CTES["m_roll"] = _cells("primary", "") + "\nunion all" + _cells("no_threshold", "_no_threshold")
CTES["m_snap"] = f"""
select {_named('x.contract_type', 'x.has_application')} contract_type,
  {_named('x.channel_type', 'x.has_application')} channel_type, f.dpd_bucket, f.dpd_bucket_order,
  count(*) n_loans, sum(f.exposure_proxy) exposure, count(case when f.is_30_plus then 1 end) n_30_plus,
  sum(case when f.is_30_plus then f.exposure_proxy end) exposure_30_plus,
  count(f.exposure_proxy) n_loans_exposure_known,
  count(case when f.is_30_plus then f.exposure_proxy end) n_30_plus_exposure_known,
  count(case when f.is_30_plus_no_threshold then 1 end) n_30_plus_no_threshold,
  sum(case when f.is_30_plus_no_threshold then f.exposure_proxy end) exposure_30_plus_no_threshold
from c_fct f join c_dim x on x.sk_id_prev = f.sk_id_prev and x.source = f.source
where f.is_open and f.months_balance = -1 group by all
"""
CTES["m_fun"] = f"""
select {_named('channel_type', None)} channel_type, {_named('contract_type', None)} contract_type,
  {_named('client_type', None)} client_type, {_named('yield_group', None)} yield_group,
  count(*) n_applications, count(case application_status when 'Approved' then 1 end) n_approved,
  count(case application_status when 'Unused offer' then 1 end) n_unused_offer,
  count(case application_status when 'Refused' then 1 end) n_refused,
  count(case application_status when 'Canceled' then 1 end) n_canceled,
  sum(case application_status when 'Approved' then credit_amount end) credit_amount_approved_total,
  quantile_cont(case application_status when 'Approved' then credit_amount end, 0.5)
    credit_amount_approved_median
from s_prev where is_last_appl_per_contract and is_last_appl_in_day group by all
"""
CTES["fpd_first"] = """
select sk_id_prev, min(days_due) due, max(installment_amount) amount,
  ifnull(sum(case when days_late <= 30 then payment_amount end), 0) paid, max(days_late) late
from s_inst i
where installment_number = 1 and installment_version > 0 and installment_version =
  (select min(j.installment_version) from s_inst j
   where j.sk_id_prev = i.sk_id_prev and j.installment_number = 1 and j.installment_version > 0)
group by sk_id_prev
"""
CTES["m_fpd"] = f"""
select contract_type, channel_type, client_type, yield_group,
  cast(sum(loan) as bigint) n_loans, cast(sum(bad) as bigint) n_fpd30, cast(sum(late) as bigint) n_fpd30_late_rule,
  cast(sum(idle) as bigint) n_approved_not_activated, cast(sum(sched) as bigint) n_approved_scheduled_no_installment
from (
  select {_named('a.contract_type', '(a.sk_id_prev is not null)')} contract_type,
    {_named('a.channel_type', '(a.sk_id_prev is not null)')} channel_type,
    {_named('a.client_type', '(a.sk_id_prev is not null)')} client_type,
    {_named('a.yield_group', '(a.sk_id_prev is not null)')} yield_group,
    1 loan, cast(paid < amount * 0.95e0 as int) bad, cast(ifnull(late > 30, false) as int) late, 0 idle, 0 sched
  from fpd_first f left join s_prev a on a.sk_id_prev = f.sk_id_prev where f.due <= -30 and f.amount > 0
  union all
  select {_named('contract_type', None)}, {_named('channel_type', None)}, {_named('client_type', None)},
    {_named('yield_group', None)}, 0, 0, 0, cast(days_first_due is null as int), cast(days_first_due is not null as int)
  from s_prev where application_status = 'Approved' and is_last_appl_per_contract and is_last_appl_in_day
    and sk_id_prev not in (select sk_id_prev from s_inst where installment_number = 1)) u
group by all
"""

CTES["c_coh"] = """
select g.mob, product contract_type, channel channel_type, first_open_month, count(*) n,
  count(case when max_mob >= g.mob then 1 end) n_full, count(case when m30 <= g.mob then 1 end) k,
  count(case when m30_nt <= g.mob then 1 end) k_nt, count(case when m30_due <= g.mob then 1 end) k_due,
  count(case when m30_due_raw <= g.mob then 1 end) k_due_raw, count(case when m1 <= g.mob then 1 end) k1
from c_out l join (select cast(unnest([6, 12, 24]) as int) mob) g on l.ended or l.max_mob >= g.mob
where in_base group by all
"""
CTES["c_cut"] = """
select *, 'product_only' scheme, cast(-96 as int) start, 'all' label, cast(-1 as int) last from c_coh
union all select *, 'cut3', cast(case when first_open_month > -36 then -35 when first_open_month > -60 then -59
    else -96 end as int), case when first_open_month > -36 then '-35 and later' when first_open_month > -60
    then '-59 to -36' else '-60 and earlier' end,
    cast(case when first_open_month > -36 then -1 when first_open_month > -60 then -36 else -60 end as int) from c_coh
union all select * exclude (b), 'cut12', b, b || ' to ' || (b + 11), b + 11 from
  (select *, cast(12 * floor(first_open_month / 12.0e0) as int) b from c_coh) x(mob, contract_type, channel_type,
   first_open_month, n, n_full, k, k_nt, k_due, k_due_raw, k1, b)
union all select * exclude (b), 'cut24', b, b || ' to ' || (b + 23), b + 23 from
  (select *, cast(24 * floor(first_open_month / 24.0e0) as int) b from c_coh) x(mob, contract_type, channel_type,
   first_open_month, n, n_full, k, k_nt, k_due, k_due_raw, k1, b)
"""

_LIGHT = {"s_app", "s_prev", "s_pos", "s_card", "s_inst", "base"}


def with_ctes(body: str) -> str:
    """Prefix the body with the CTEs it uses, directly or through other CTEs."""
    wanted: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in wanted and re.search(rf"\b{name}\b", sql):
                wanted.add(name)
                visit(CTES[name])

    visit(body)
    parts = [
        f"{name} as {'' if name in _LIGHT else 'materialized '}({sql.strip()})"
        for name, sql in CTES.items() if name in wanted
    ]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def rounding(body: str, *columns: str) -> str:
    """The body with the named double columns rounded as the Spark side does (see registry.flat)."""
    if not columns:
        return body
    swaps = ", ".join(
        f"case when abs({c}) < 1000 then round(round({c}, 12), 6) else round({c}, 6) end as {c}" for c in columns)
    return f"select * replace ({swaps}) from ({body.strip()}) rounded_rows"
