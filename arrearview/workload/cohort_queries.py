"""Cohorts, report feeds and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrearview.plans import cohorts as c
from arrearview.plans import measures as m
from arrearview.plans import report as r
from arrearview.workload.registry import query
from arrearview.workload.sqlstats import MH_ROUND, mh, oe, oes, prop, props, rr, rrs
from arrearview.workload.vintage_queries import LABELLED, sums

B = "as bigint"
ALL = ("n", "n_full", "k", "k_nt", "k_due", "k_due_raw", "k1")
CUTS = "scheme <> 'product_only'"
AGED = f"{LABELLED} and first_open_month <= -1 - mob"


def add(*names: str) -> str:
    return ", ".join(f"cast(sum({x}) {B}) {x}" for x in names)


def cells(b):
    return b.cohort_cells


query("cohort_cells", "select mob, contract_type, channel_type, first_open_month, n, n_full, k, k_nt, k_due, "
                      "k_due_raw, k1 from c_coh")(cells)
query("cohort_cuts", f"""select scheme, start, label, last, cast(sum(n) {B}) n from c_cut where mob = 6 and {CUTS}
group by 1, 2, 3, 4""")(lambda b: c.cuts_table(cells(b), b.d))
query("cohort_reconcile", """
select (select count(*) from (select distinct mob, contract_type, channel_type, start from c_cut
    where scheme = 'cut12')) n_cells_recount,
  (select count(*) from (select distinct mob, contract_type, channel_type, origination_cohort_start from m_vin
    where mob in (6, 12, 24))) n_cells_mart,
  (select count(*) from (
    (select mob, contract_type, channel_type, start, sum(n), sum(k), sum(k_due), sum(k_nt) from c_cut
     where scheme = 'cut12' group by 1, 2, 3, 4)
    except
    (select mob, contract_type, channel_type, origination_cohort_start, sum(n_loans), sum(k), sum(k_due), sum(k_nt)
     from m_vin where mob in (6, 12, 24) group by 1, 2, 3, 4))) n_mismatch""")(
    lambda b: c.reconcile(cells(b), b.vintage, b.d))
query("cohort_sizes", f"""
select origination_cohort_start || ' to ' || (origination_cohort_start + 11) origination_cohort,
  origination_cohort_start, cast(sum(n_loans) {B}) n from m_vin where mob = 0 group by 1, 2""")(
    lambda b: c.cohort_sizes(b.vintage))
query("cohort_vintage", f"""
select *, {prop('k', 'n', 'primary')}, {prop('k_due', 'n', 'due_only')} from (
  select mob, scheme, start, label, contract_type, {add('n', 'n_full', 'k', 'k_due')} from c_cut
  where {CUTS} and {AGED} group by 1, 2, 3, 4, 5
  union all select mob, scheme, start, label, null, {add('n', 'n_full', 'k', 'k_due')} from c_cut
  where {CUTS} and {AGED} group by 1, 2, 3, 4) u""", *props("primary", "due_only"))(
    lambda b: c.cohort_vintage(cells(b), b.d))
_PER = f"""
select *, rank() over (partition by mob, scheme, contract_type order by start) up,
  rank() over (partition by mob, scheme, contract_type order by start desc) down
from (select mob, scheme, contract_type, start, label, {add('n', 'k')} from c_cut where {CUTS} and {AGED}
  and contract_type in ('Cash loans', 'Consumer loans', 'Revolving loans') group by 1, 2, 3, 4, 5) q"""
query("cohort_old_new", f"""
select mob, scheme, contract_type, o.label oldest, w.label newest, o.k k1, o.n n1, w.k k0, w.n n0,
  {rr('o.k', 'o.n', 'w.k', 'w.n', 'rr')}
from ({_PER}) o join ({_PER}) w using (mob, scheme, contract_type)
where o.up = 1 and w.down = 1 and o.start <> w.start""", *rrs("rr"))(lambda b: c.oldest_against_newest(cells(b), b.d))
query("cohort_mix", f"""
select p.*, p.n / cast(t.n as double) "share", {prop('p.k', 'p.n', 'primary')}
from (select mob, scheme, channel_type, contract_type, start, label, {add('n', 'k')} from c_cut
      where scheme in ('cut12', 'cut3') and {LABELLED} group by 1, 2, 3, 4, 5, 6) p
join (select mob, channel_type, contract_type, sum(n) n from c_coh where {LABELLED} group by 1, 2, 3) t
  using (mob, channel_type, contract_type)""", '"share"', *props("primary"))(lambda b: c.cohort_mix(cells(b), b.d))


def strata(definitions: dict[str, str], extra: str = "true") -> str:
    return " union all ".join(
        f"select mob, scheme, '{name}' definition, channel_type, contract_type, start, cast(sum(n) {B}) n, "
        f"cast(sum({k}) {B}) k from c_cut where {LABELLED} and {extra} group by 1, 2, 4, 5, 6"
        for name, k in definitions.items())


TWO = {"primary": "k", "due_only": "k_due"}
FOUR = {"primary": "k", "due_only": "k_due", "due_only_card_raw": "k_due_raw", "no_threshold": "k_nt"}
EXPECTED = f"""
select s.*, s.n * (t.k / cast(t.n as double)) e from ({strata(TWO)}) s
join (select mob, scheme, definition, contract_type, start, sum(n) n, sum(k) k from ({strata(TWO)}) s
      group by 1, 2, 3, 4, 5) t using (mob, scheme, definition, contract_type, start)"""
query("smr_schemes", f"""
select *, {oe('observed', 'expected')}, {prop('observed', 'n', 'crude')} from (
  select mob, scheme, definition, channel_type, cast(sum(n) {B}) n, cast(sum(k) {B}) observed, sum(e) expected
  from ({EXPECTED}) x group by 1, 2, 3, 4) g""", "expected", *oes(), *props("crude"))(
    lambda b: c.smr_schemes(cells(b), b.d))
query("smr_excess", f"""
select mob, scheme, definition, channel_type, contract_type, cast(sum(n) {B}) n, cast(sum(k) {B}) observed,
  sum(e) expected, sum(k) - sum(e) excess from ({EXPECTED}) x group by 1, 2, 3, 4, 5""", "expected", "excess")(
    lambda b: c.smr_excess(cells(b), b.d))
SIDES = f"""
select p.mob, p.scheme, p.definition, p.contract_type, p.start, p.k k1, p.n n1, z.k k0, z.n n0
from (select mob, scheme, definition, contract_type, start, {add('n', 'k')} from ({strata(FOUR)}) s
      where contract_type <> 'Cash loans' group by 1, 2, 3, 4, 5) p
join (select mob, scheme, definition, start, {add('n', 'k')} from ({strata(FOUR)}) s
      where contract_type = 'Cash loans' group by 1, 2, 3, 4) z using (mob, scheme, definition, start)"""
query("product_ratio_crude", f"""
select mob, definition, contract_type, k1, n1, k0, n0, {rr('k1', 'n1', 'k0', 'n0', 'rr')}
from ({SIDES}) s where scheme = 'product_only'""", *rrs("rr"))(lambda b: c.product_ratio_crude(cells(b), b.d))
_RATED = f"select *, {prop('k1', 'n1', 'group1')}, {prop('k0', 'n0', 'group0')} from ({{}}) s"
query("product_ratio_strata", _RATED.format(f"select * from ({SIDES}) s where {CUTS}"), *props("group1", "group0"))(
    lambda b: c.product_ratio_strata(cells(b), b.d))
query("product_ratio_cohort_mh", mh(f"select * from ({SIDES}) s where {CUTS}",
                                    "mob, scheme, definition, contract_type"), *MH_ROUND)(
    lambda b: c.product_ratio_pooled(cells(b), b.d))
_PAIR = f"""
select a.mob, a.scheme, a.definition, a.contract_type, a.start, a.k k1, a.n n1, z.k k0, z.n n0
from ({strata(TWO, "channel_type = 'Stone'")}) a join ({strata(TWO, "channel_type = 'Country-wide'")}) z
  using (mob, scheme, definition, contract_type, start)"""
_PAIRS = f"""
select * from ({_PAIR}) p union all select * replace ('consumer_and_card' as scheme) from ({_PAIR}) p
where scheme = 'product_only' and contract_type in ('Consumer loans', 'Revolving loans')"""
query("channel_pair_strata", _RATED.format(_PAIRS), *props("group1", "group0"))(
    lambda b: c.channel_pair_strata(cells(b), b.d))
query("channel_pair_cohort_mh", mh(_PAIRS, "mob, scheme, definition"), *MH_ROUND)(
    lambda b: c.channel_pair_pooled(cells(b), b.d))
query("cards_by_cohort", f"""
select p.*, cast(t.n {B}) n_channel, cast(t.k {B}) k_channel, {prop('p.k', 'p.n', 'primary')},
  p.k / cast(nullif(t.k, 0) as double) share_of_cases, {prop('t.k', 't.n', 'total')}
from (select mob, scheme, channel_type, start, label, {add('n', 'k')} from c_cut where scheme in ('cut12', 'cut3')
      and contract_type = 'Revolving loans'
      and channel_type in ('Contact center', 'Stone', 'Credit and cash offices', 'Country-wide') group by 1, 2, 3, 4, 5) p
join (select mob, channel_type, sum(n) n, sum(k) k from c_coh where contract_type = 'Revolving loans' group by 1, 2) t
  using (mob, channel_type)""", *props("primary", "total"), "share_of_cases")(lambda b: c.cards_by_cohort(cells(b), b.d))

_LABEL = "origination_cohort_start || ' to ' || (origination_cohort_start + 11)"
_CURVE = f"""
select {_LABEL} origination_cohort, origination_cohort_start, mob, cast(sum(n_loans) {B}) n, cast(sum(k) {B}) k,
  sum(k) / cast(sum(n_loans) as double) rate
from m_vin where {LABELLED} and origination_cohort_start + 12 + mob <= 0 group by 1, 2, 3"""
query("cohort_curve", _CURVE, "rate")(lambda b: c.cohort_curve(b.vintage, b.d))
query("cohort_curve_points", f"""
select origination_cohort, origination_cohort_start, string_agg(mob || ':' || k || '/' || n, ' ' order by mob) points
from ({_CURVE}) q group by 1, 2""")(
    lambda b: c.cohort_curve_points(b.vintage, b.d).select(
        "origination_cohort", "origination_cohort_start", F.array_join(F.transform("points", lambda p: F.concat(
            p["mob"].cast("string"), F.lit(":"), p["k"].cast("string"), F.lit("/"), p["n"].cast("string"))),
            " ").alias("points")))

# ---- report ----------------------------------------------------------------------------------

query("footer_counts", "select (select count(*) from c_dim) n_loans_total, (select count(*) from c_fct) n_loan_months")(
    lambda b: r.footer_counts(b.dim_loan, b.fct_loan_month))
query("page_totals", f"""
select cast(sum(n_loans) {B}) n_open, cast(sum(n_30_plus) {B}) n_30plus,
  cast(sum(n_loans_exposure_known) {B}) n_exp_known, cast(sum(n_30_plus_exposure_known) {B}) n_30plus_exp_known,
  sum(exposure) exposure_total, sum(exposure_30_plus) exposure_30plus,
  sum(n_30_plus_exposure_known) / cast(sum(n_loans_exposure_known) as double) rate_30plus_same_set,
  sum(exposure_30_plus) / sum(exposure) exposure_rate_30plus from m_snap""",
      "exposure_total", "exposure_30plus", "rate_30plus_same_set", "exposure_rate_30plus")(
    lambda b: r.open_totals(b.portfolio_snapshot))
_BUCKETS = f"select dpd_bucket, dpd_bucket_order, cast(sum(n_loans) {B}) n_loans, sum(exposure) exposure from m_snap"
query("page_buckets", f"{_BUCKETS} group by 1, 2 order by 2", "exposure")(
    lambda b: r.bucket_totals(b.portfolio_snapshot))
query("late_buckets", f"{_BUCKETS} where dpd_bucket_order > 0 group by 1, 2", "exposure")(
    lambda b: r.late_buckets(b.portfolio_snapshot, b.d))
for _dim, _keep in (("channel_type", "channel_type <> '(unknown)'"), ("contract_type", "true")):
    query(f"ranked_{_dim}", f"""
select {_dim}, cast(sum(n_loans) {B}) n_open, cast(sum(n_30_plus) {B}) n_30plus,
  sum(n_30_plus) / cast(sum(n_loans) as double) rate_30plus
from m_snap where {_keep} group by 1 order by 4 desc, 1""", "rate_30plus")(
        lambda b, dim=_dim: r.ranked_rates(
            r.excluding(b.portfolio_snapshot, dim, b.d.no_application) if dim == "channel_type"
            else b.portfolio_snapshot, dim))
_CP = f"""
select channel_type, contract_type, cast(sum(n_loans) {B}) n_mob12, cast(sum(k) {B}) n_ever30,
  sum(k) / cast(sum(n_loans) as double) rate
from m_vin where mob = 12 and contract_type <> '(unknown)' and channel_type <> '(unknown)' {{}} group by 1, 2"""
query("channel_product_mob12", _CP.format(""), "rate")(lambda b: r.channel_product_at(b.vintage, b.d))
query("comparable_cells_mob12", _CP.format("and channel_type <> 'Other'"), "rate")(
    lambda b: r.comparable_cells(b.vintage, b.d))
query("applications_by_channel", f"select channel_type, cast(sum(n_applications) {B}) n_applications from m_fun group by 1")(
    lambda b: r.applications_by_channel(b.funnel_by_channel, b.d))
for _dim in ("channel_type", "contract_type"):
    query(f"curve_by_{_dim}", f"""
select {_dim}, mob, cast(sum(n_loans) {B}) n_loans, cast(sum(n_full) {B}) n_observed_full, cast(sum(k) {B}) n_ever30,
  sum(k) / cast(sum(n_loans) as double) rate
from m_vin where {_dim} <> '(unknown)' group by 1, 2 order by 1, 2""", "rate")(
        lambda b, dim=_dim: r.curves(b.vintage, dim, b.d))
query("smr_ranked", f"""
select channel_type, n, observed, expected, {oe('observed', 'expected')}, n < 30 flags_small_n,
  observed < 5 flags_few_cases, observed < 10 flags_thin_cases
from (select channel_type, cast(sum(n) {B}) n, cast(sum(k) {B}) observed, sum(e) expected from ({EXPECTED}) x
  where mob = 12 and scheme = 'cut12' and definition = 'primary' and channel_type <> '(unknown)' group by 1) g""",
      "expected", *oes())(lambda b: r.ranked_smr(cells(b), b.d))
query("settled_curves", f"select * from ({_CURVE}) q where origination_cohort <> '-12 to -1'", "rate")(
    lambda b: r.settled_curves(b.vintage, b.d))
_MARTS = ("m_fun", "m_fpd", "m_vin", "m_roll", "m_snap")


def _marts(b):
    return {"funnel": b.funnel_by_channel, "fpd": b.fpd_by_segment, "vintage": b.vintage, "roll": b.roll_rate,
            "snapshot": b.portfolio_snapshot}


for _col, _name in (("channel_type", "channel"), ("contract_type", "product")):
    query(f"dim_{_name}", " union ".join(f"select {_col} {_name} from {t}" for t in _MARTS))(
        lambda b, name=_name: getattr(b, f"dim_{name}"))
_PICK = "channel_type in ('Stone', 'Contact center') and contract_type = 'Consumer loans'"
query("selection_sizes", " union all ".join(
    f"select '{label}' mart, count(*) n_rows, cast(sum({size}) {B}) n from {t} where {_PICK} {more}"
    for label, t, size, more in (
        ("funnel", "m_fun", "n_applications", ""), ("fpd", "m_fpd", "n_loans", ""), ("vintage", "m_vin", "n_loans", ""),
        ("roll", "m_roll", "n_loans", "and definition = 'primary'"), ("snapshot", "m_snap", "n_loans", ""))))(
    lambda b: r.selection_sizes(_marts(b), b.dim_channel.where(F.col("channel").isin("Stone", "Contact center")),
                                b.dim_product.where("product = 'Consumer loans'")))

# ---- measures --------------------------------------------------------------------------------


def _at12(k: str) -> str:
    return f"cast(sum(case when mob = 12 then {k} end) {B})"


query("measures_vintage", f"""
select contract_type, channel_type, cast(sum(n_loans) {B}) vintage_loans, cast(sum(k) {B}) ever_30_plus_loans,
  sum(k) / cast(sum(n_loans) as double) ever_30_plus_rate, {_at12('k')} cases_mob12, {_at12('n_loans')} loans_mob12,
  {_at12('k')} / cast({_at12('n_loans')} as double) rate_mob12,
  {_at12('k_nt')} / cast({_at12('n_loans')} as double) rate_mob12_no_threshold,
  {_at12('k_due')} / cast({_at12('n_loans')} as double) rate_mob12_due_only
from m_vin where client_type = 'New' group by 1, 2""", "ever_30_plus_rate", "rate_mob12", "rate_mob12_no_threshold",
      "rate_mob12_due_only")(
    lambda b: m.vintage_measures(b.vintage, ["contract_type", "channel_type"], F.col("client_type") == "New"))
for _by_cohort in (False, True):
    _strata = "contract_type" + (", origination_cohort_start" if _by_cohort else "")
    query("measures_smr_cohort" if _by_cohort else "measures_smr", f"""
select channel_type, observed, expected, {oe('observed', 'expected')},
  case when observed < 5 then 'too few cases' end note
from (select channel_type, cast(sum(x.k) {B}) observed, sum(x.n * (t.k / cast(t.n as double))) expected
  from ({sums('channel_type, ' + _strata, f'mob = 12 and {LABELLED}')}) x
  join ({sums(_strata, f'mob = 12 and {LABELLED}')}) t using ({_strata}) group by 1) g""", "expected", *oes())(
        lambda b, by=_by_cohort: m.smr_measures(b.vintage, b.d, by))
_P12 = sums("contract_type", f"mob = 12 and {LABELLED}")
_PC12 = sums("contract_type, origination_cohort_start", f"mob = 12 and {LABELLED}")
query("measures_ratio", f"""
select p.contract_type, (p.k / cast(p.n as double)) / nullif(z.k / cast(z.n as double), 0) crude,
  (p.k_due / cast(p.n as double)) / nullif(z.k_due / cast(z.n as double), 0) due_only,
  (p.k_nt / cast(p.n as double)) / nullif(z.k_nt / cast(z.n as double), 0) no_threshold, h.a / nullif(h.b, 0) mh_cohort
from ({_P12}) p join ({_P12}) z on z.contract_type = 'Cash loans' and p.contract_type <> 'Cash loans'
join (select p.contract_type, sum(p.k * z.n / cast(p.n + z.n as double)) a, sum(z.k * p.n / cast(p.n + z.n as double)) b
  from ({_PC12}) p join ({_PC12}) z using (origination_cohort_start)
  where z.contract_type = 'Cash loans' group by 1) h on h.contract_type = p.contract_type""",
      "crude", "due_only", "no_threshold", "mh_cohort")(lambda b: m.ratio_vs_base(b.vintage, b.d))
query("measures_cohort_rate", f"""
select {_LABEL} origination_cohort, origination_cohort_start, mob, cast(sum(n_loans) {B}) n, cast(sum(k) {B}) k,
  case when origination_cohort_start + 11 < -mob then sum(k) / cast(sum(n_loans) as double) end rate
from m_vin group by 1, 2, 3""", "rate")(lambda b: m.cohort_rate(b.vintage, b.d))
_FUN = "n_approved + n_unused_offer"
query("measures_funnel", f"""
select channel_type, applications, decided, offered, offered / cast(nullif(decided, 0) as double) approval_rate,
  e approval_expected, offered / nullif(e, 0) approval_standardised_ratio, a / cast(nullif(offered, 0) as double) take_up_rate,
  ca / cast(nullif(co, 0) as double) take_up_rate_consumer, credit_approved
from (select channel_type, cast(sum(n_applications) {B}) applications, cast(sum({_FUN} + n_refused) {B}) decided,
    cast(sum({_FUN}) {B}) offered, sum(n_approved) a, sum(n_approved) filter (contract_type = 'Consumer loans') ca,
    sum({_FUN}) filter (contract_type = 'Consumer loans') co, sum(credit_amount_approved_total) credit_approved,
    sum(({_FUN} + n_refused) * p.rate) e
  from m_fun join (select contract_type, sum({_FUN}) / cast(sum({_FUN} + n_refused) as double) rate from m_fun
    group by 1) p using (contract_type) group by 1) g""", "approval_rate", "approval_expected",
      "approval_standardised_ratio", "take_up_rate", "take_up_rate_consumer", "credit_approved")(
    lambda b: m.funnel_measures(b.funnel_by_channel, b.d))
query("measures_fpd", f"""
select contract_type, channel_type, cast(sum(n_loans) {B}) base_loans, cast(sum(n_fpd30) {B}) fpd30_loans,
  cast(sum(n_approved_not_activated) {B}) approved_not_activated,
  sum(n_fpd30) / cast(nullif(sum(n_loans), 0) as double) fpd30_rate
from m_fpd group by 1, 2""", "fpd30_rate")(lambda b: m.fpd_measures(b.fpd_by_segment, ["contract_type", "channel_type"]))
query("measures_roll", f"""
select contract_type, from_state, to_state, cast(sum(n_loans) {B}) roll_loans, cast(max(t) {B}) roll_base_loans,
  sum(n_loans) / cast(max(t) as double) roll_rate,
  case when from_state <> 'B0 Current' then ifnull(max(z), 0) / cast(max(t) as double) end cure_rate,
  sum(exposure_from) exposure_from
from m_roll join (select contract_type, from_state, sum(n_loans) t, sum(n_loans) filter (to_state = 'B0 Current') z
  from m_roll where definition = 'primary' group by 1, 2) q using (contract_type, from_state)
where definition = 'primary' group by 1, 2, 3""", "roll_rate", "cure_rate", "exposure_from")(
    lambda b: m.roll_measures(b.roll, b.d, ["contract_type"]))
query("measures_snapshot", f"""
select contract_type, cast(sum(n_loans) {B}) open_loans, cast(sum(n_30_plus) {B}) loans_30,
  cast(sum(n_loans_exposure_known) {B}) loans_exposure_known,
  cast(sum(n_30_plus_exposure_known) {B}) loans_30_exposure_known, sum(exposure) open_exposure,
  sum(exposure_30_plus) exposure_30, sum(n_30_plus) / cast(sum(n_loans) as double) rate_30,
  sum(n_30_plus_exposure_known) / cast(nullif(sum(n_loans_exposure_known), 0) as double) rate_30_exposure_known,
  sum(exposure_30_plus) / nullif(sum(exposure), 0) exposure_rate_30,
  sum(n_30_plus_no_threshold) / cast(sum(n_loans) as double) rate_30_no_threshold,
  sum(exposure_30_plus_no_threshold) / nullif(sum(exposure), 0) exposure_rate_30_no_threshold
from m_snap group by 1""", "open_exposure", "exposure_30", "rate_30", "rate_30_exposure_known", "exposure_rate_30",
      "rate_30_no_threshold", "exposure_rate_30_no_threshold")(
    lambda b: m.snapshot_measures(b.portfolio_snapshot, ["contract_type"]))
