"""Sources, staging, core, marts and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrearview.plans import portfolio, profile
from arrearview.sources import exports, raw
from arrearview.workload.oracle_base import CTES
from arrearview.workload.registry import query
from arrearview.workload.sqlstats import prop, props, total

# ---- sources and sinks -----------------------------------------------------------------------

_AUDIT = [("application_train", "sk_id_curr", 20), ("previous_application", "sk_id_prev", 29),
          ("pos_cash_balance", "sk_id_prev", 8), ("credit_card_balance", "sk_id_prev", 14),
          ("installments_payments", "sk_id_prev", 8)]


@query("load_audit", " union all ".join(
    f"select '{t}' table_name, count(*) n_rows, cast({n} as bigint) n_columns, "
    f"cast(sum({k} % 1000003) as bigint) key_checksum from {t}" for t, k, n in _AUDIT))
def load_audit(b):
    """The raw tables written as CSV with upper-case headers, read back by declared schema."""
    paths = {t: f"{b.store.folder}/raw_csv/{t}" for t in raw.RAW_TABLES}
    for t, path in paths.items():
        source = b.raw[t]
        upper = source.toDF(*[c.upper() for c in source.columns])
        upper.write.mode("overwrite").option("header", True).csv(path)
    return raw.load_audit(raw.read_csv(b.spark, paths))


_VINTAGE_COLUMNS = """
select source, contract_type, channel_type, client_type, yield_group, tenor_group,
  origination_cohort_start || ' to ' || (origination_cohort_start + 11) origination_cohort,
  origination_cohort_start, mob, n_loans, cast(n_full as bigint) n_observed_full,
  cast(n_loans - n_full as bigint) n_closed_early, cast(k as bigint) n_ever_30_plus,
  cast(k_nt as bigint) n_ever_30_plus_no_threshold, cast(k_due as bigint) n_ever_30_plus_due_only,
  k / cast(n_loans as double) ever_30_plus_rate, k_nt / cast(n_loans as double) ever_30_plus_rate_no_threshold
from m_vin"""
_VINTAGE_RATES = ("ever_30_plus_rate", "ever_30_plus_rate_no_threshold")


@query("mart_csv_roundtrip", _VINTAGE_COLUMNS, *_VINTAGE_RATES)
def mart_csv_roundtrip(b):
    """The vintage mart exported in total order and read back with explicit types."""
    path = f"{b.store.folder}/export/vintage"
    exports.write_csv(b.vintage, path)
    return exports.read_csv(b.spark, path, b.vintage.schema)


# ---- staging ---------------------------------------------------------------------------------

for _table, _cte, _rounded in (
    ("application", "s_app", ("age_years", "employed_years", "ext_source_1", "ext_source_2", "ext_source_3")),
    ("previous_application", "s_prev", ()), ("pos_cash_balance", "s_pos", ()),
    ("credit_card_balance", "s_card", ()), ("installments_payments", "s_inst", ()),
):
    query(f"stg_{_table}", f"select * from {_cte}", *_rounded)(lambda b, t=_table: b.stg(t))

# ---- core ------------------------------------------------------------------------------------

query("int_loan_month", "select * from c_int")(lambda b: b.int_loan_month)
query("dim_loan", "select * from c_dim")(lambda b: b.dim_loan)
query("fct_loan_month", "select * from c_fct")(lambda b: b.fct_loan_month)


@query("loan_outcome", "select sk_id_prev, end_state, max_mob, m1 first_1_plus_mob, m30 first_30_plus_mob, "
                       "m30_nt first_30_plus_no_threshold_mob, m30_due first_30_plus_due_only_mob, "
                       "m30_due_raw first_30_plus_due_only_card_raw_mob from c_out")
def loan_outcome(b):
    return b.loan_outcome.select(
        "sk_id_prev", "end_state", "max_mob", "first_1_plus_mob", "first_30_plus_mob",
        "first_30_plus_no_threshold_mob", "first_30_plus_due_only_mob", "first_30_plus_due_only_card_raw_mob")


# ---- marts -----------------------------------------------------------------------------------

query("vintage_mart", _VINTAGE_COLUMNS, *_VINTAGE_RATES)(lambda b: b.vintage)

query("vintage_curve", """
select mob, cast(sum(n_loans) as bigint) n, cast(sum(n_full) as bigint) n_full, cast(sum(k) as bigint) k,
  sum(k) / cast(sum(n_loans) as double) rate
from m_vin group by mob order by mob""", "rate")(
    lambda b: b.vintage.groupBy("mob").agg(
        F.sum("n_loans").alias("n"), F.sum("n_observed_full").alias("n_full"), F.sum("n_ever_30_plus").alias("k"),
        (F.sum("n_ever_30_plus").cast("double") / F.sum("n_loans")).alias("rate")).orderBy("mob"))

_ROLL = """
select source, contract_type, channel_type, from_state, from_order, to_state,
  cast(list_position(['B0 Current','B1 1-30','B2 31-60','B3 61-90','B4 90+','Closed','Other','Missing'], to_state) - 1
    as int) to_order,
  n_loans, cast(t.n as bigint) n_from, n_loans / cast(t.n as double) roll_rate, n_month_gap, n_exposure_null,
  cast(t.nulls as bigint) n_exposure_null_from, exposure_from, t.e exposure_from_total,
  case when t.e > 0 then exposure_from / t.e end exposure_roll_rate, exposure_to
from m_roll join (select definition, source, contract_type, channel_type, from_state, sum(n_loans) n,
    sum(n_exposure_null) nulls, sum(exposure_from) e from m_roll group by all) t
  using (definition, source, contract_type, channel_type, from_state)
where definition = '{}'"""
_ROLL_ROUND = ("roll_rate", "exposure_from", "exposure_from_total", "exposure_roll_rate", "exposure_to")
query("roll_matrix", _ROLL.format("primary"), *_ROLL_ROUND)(lambda b: b.roll_rate)
query("roll_matrix_no_threshold", _ROLL.format("no_threshold"), *_ROLL_ROUND)(lambda b: b.roll_rate_no_threshold)

_SNAP_MONEY = ("exposure", "exposure_30_plus", "exposure_30_plus_no_threshold")
query("portfolio_snapshot", "select * from m_snap", *_SNAP_MONEY)(lambda b: b.portfolio_snapshot)
query("funnel_by_channel", """
select *, n_approved + n_unused_offer n_offered, n_approved + n_unused_offer + n_refused n_decided,
  (n_approved + n_unused_offer) / cast(nullif(n_approved + n_unused_offer + n_refused, 0) as double) approval_rate,
  n_approved / cast(nullif(n_approved + n_unused_offer, 0) as double) take_up_rate
from m_fun""", "approval_rate", "take_up_rate", "credit_amount_approved_total", "credit_amount_approved_median")(
    lambda b: b.funnel_by_channel)
query("fpd_by_segment", """
select contract_type, channel_type, client_type, yield_group, n_loans, n_fpd30,
  n_fpd30 / cast(nullif(n_loans, 0) as double) fpd30_rate, n_fpd30_late_rule,
  n_fpd30_late_rule / cast(nullif(n_loans, 0) as double) fpd30_late_rule_rate,
  n_approved_not_activated, n_approved_scheduled_no_installment
from m_fpd""", "fpd30_rate", "fpd30_late_rule_rate")(lambda b: b.fpd_by_segment)

for _month in (-1, -25):
    query(f"snapshot_by_source_month_{-_month}", f"""
select f.source, count(*) n_open, count(case when is_30_plus then 1 end) n_30_plus,
  count(case when is_30_plus then 1 end) / cast(count(*) as double) rate, sum(exposure_proxy) exposure,
  sum(case when is_30_plus then exposure_proxy end) exposure_30_plus,
  ifnull(sum(case when is_30_plus then exposure_proxy end), 0) / nullif(sum(exposure_proxy), 0) exposure_rate
from c_fct f where is_open and months_balance = {_month} group by f.source""",
          "rate", "exposure", "exposure_30_plus", "exposure_rate")(
        lambda b, m=_month: portfolio.snapshot_by_source(b.open_months, b.d, m))

# ---- portfolio -------------------------------------------------------------------------------

query("portfolio_totals", """
select (select count(*) from c_dim) n_loans, (select count(*) from c_dim where source = 'pos_cash') n_loans_installment,
  (select count(*) from c_dim where source = 'credit_card') n_loans_card,
  (select count(*) from c_dim where not has_application) n_loans_no_application,
  (select count(*) from c_fct) n_loan_months,
  (select count(*) from s_prev where is_last_appl_per_contract and is_last_appl_in_day) n_applications_dedup,
  (select count(*) from s_prev where is_last_appl_per_contract and is_last_appl_in_day
    and application_status = 'Approved') n_approved_dedup,
  (select min(months_balance) from c_fct) first_month, (select max(months_balance) from c_fct) last_month""")(
    lambda b: portfolio.totals(b.dim_loan, b.fct_loan_month, b.stg("previous_application"), b.d))
query("end_state_mix", "select end_state, count(*) n_loans, count(case when is_partial_history then null else 1 end) "
                       "n_not_partial from c_dim group by 1")(lambda b: portfolio.end_state_mix(b.dim_loan))
query("product_mix", "select product contract_type, count(*) n_loans from c_out group by 1")(
    lambda b: portfolio.product_mix(b.dim_loan, b.d))
query("vintage_base", """
select count(*) n_eligible, (select count(*) from c_dim where is_partial_history) n_partial_history,
  (select count(*) from c_dim where first_open_month is null) n_never_open,
  (select count(*) from c_out where in_base) n_vintage_base from c_dim""")(
    lambda b: portfolio.vintage_base_counts(b.dim_loan))
query("snapshot_buckets", f"""
select definition, dpd_bucket, dpd_bucket_order, n_loans, exposure, n_open, {prop('n_loans', 'n_open', 'share')}
from (
  select 'primary' definition, dpd_bucket, dpd_bucket_order, count(*) n_loans, sum(exposure_proxy) exposure
  from c_fct where is_open and months_balance = -1 group by all
  union all
  select 'no_threshold', dpd_bucket_no_threshold, dpd_bucket_order_no_threshold, count(*), sum(exposure_proxy)
  from c_fct where is_open and months_balance = -1 group by all) u,
  (select count(*) n_open from c_fct where is_open and months_balance = -1) t""",
      "exposure", *props("share"))(
    lambda b: portfolio.snapshot_buckets(b.portfolio_snapshot, b.open_months, b.d).select(
        "definition", "dpd_bucket", "dpd_bucket_order", "n_loans", "exposure", "n_open", "share"))

_KPI = """
select '{0}' scope, {1}, sum(exposure) exposure_total, sum(exposure_30_plus) e30,
  ifnull(sum(exposure_30_plus_no_threshold), 0) e30nt
from m_snap where {2}"""
_KPI_COUNTS = total("n_loans", "n_30_plus", "n_loans_exposure_known", "n_30_plus_exposure_known",
                    "n_30_plus_no_threshold")
query("kpi_same_set", f"""
select scope, n_loans, n_30_plus, n_loans_exposure_known, n_30_plus_exposure_known, n_30_plus_no_threshold,
  {prop('n_30_plus', 'n_loans', 'all_open')},
  {prop('n_30_plus_exposure_known', 'n_loans_exposure_known', 'exposure_known')},
  ifnull(e30, 0) / nullif(exposure_total, 0) exposure_share, exposure_total, e30 exposure_30_plus,
  n_loans - n_loans_exposure_known n_loans_exposure_unknown,
  {prop('n_30_plus_no_threshold', 'n_loans', 'no_threshold')},
  e30nt / nullif(exposure_total, 0) exposure_share_no_threshold
from ({_KPI.format('exposure_known_set', _KPI_COUNTS, 'true')} union all
  {_KPI.format('excluding_unknown', _KPI_COUNTS, "channel_type <> '(unknown)'")}) u""",
      "exposure_share", "exposure_total", "exposure_30_plus", "exposure_share_no_threshold",
      *props("all_open", "exposure_known", "no_threshold"))(
    lambda b: portfolio.kpi_same_set(b.portfolio_snapshot, b.d))


def _part(column: str, name: str) -> str:
    return (f"cast(ifnull(sum(case when channel_type = '(unknown)' then {column} end), 0) as bigint) k_{name}, "
            f"cast(sum({column}) as bigint) n_{name}")


query("unknown_share", f"""
select * exclude (a_rate, a_lo, a_hi, a_enough_n, b_rate, b_lo, b_hi, b_enough_n),
  a_rate "30_plus_rate", a_lo "30_plus_lo", a_hi "30_plus_hi", a_enough_n "30_plus_enough_n",
  b_rate "30_plus_no_threshold_rate", b_lo "30_plus_no_threshold_lo", b_hi "30_plus_no_threshold_hi",
  b_enough_n "30_plus_no_threshold_enough_n"
from (select *, {prop('k_open', 'n_open', 'open')}, {prop('k_30_plus', 'n_30_plus', 'a')},
    {prop('k_30_plus_no_threshold', 'n_30_plus_no_threshold', 'b')}
  from (select {_part('n_loans', 'open')}, {_part('n_30_plus', '30_plus')},
      {_part('n_30_plus_no_threshold', '30_plus_no_threshold')},
      cast(ifnull(sum(case when channel_type = '(unknown)' then n_loans_exposure_known end), 0) as bigint)
        n_with_exposure from m_snap) s) w""",
      "open_rate", "open_lo", "open_hi", *[f'"30_plus{x}_{y}"' for x in ("", "_no_threshold") for y in ("rate", "lo", "hi")])(
    lambda b: portfolio.unknown_share(b.portfolio_snapshot, b.d))
query("snapshot_levels", f"""
select contract_type, channel_type, n, k, k_nt, {prop('k', 'n', 'primary')}, {prop('k_nt', 'n', 'no_threshold')}
from (
  select contract_type, null channel_type, cast(sum(n_loans) as bigint) n, cast(sum(n_30_plus) as bigint) k,
    cast(sum(n_30_plus_no_threshold) as bigint) k_nt from m_snap group by 1
  union all select null, channel_type, cast(sum(n_loans) as bigint), cast(sum(n_30_plus) as bigint),
    cast(sum(n_30_plus_no_threshold) as bigint) from m_snap group by 2
  union all select contract_type, channel_type, cast(sum(n_loans) as bigint), cast(sum(n_30_plus) as bigint),
    cast(sum(n_30_plus_no_threshold) as bigint) from m_snap group by 1, 2) u""", *props("primary", "no_threshold"))(
    lambda b: portfolio.snapshot_levels(b.portfolio_snapshot, b.d))
query("exposure_missing", """
select count(*) n_contracts, count(case when is_30_plus then 1 end) n_30_plus,
  count(case when not has_application then 1 end) n_contracts_unknown_group,
  count(case when is_30_plus and not has_application then 1 end) n_30_plus_unknown_group
from c_fct f join c_out x using (sk_id_prev) where is_open and months_balance = -1 and exposure_proxy is null""")(
    lambda b: portfolio.exposure_missing(b.open_months, b.d))

# ---- profiles --------------------------------------------------------------------------------

query("status_distribution", "select source, contract_status, count(*) n_rows from c_int group by all "
                             "order by source, n_rows desc")(lambda b: profile.status_distribution(b.int_loan_month))
# Contract-months by both delays, and contracts by how they ended: what the profiles are summed from.
CTES["p_delays"] = "select source src, dpd_raw plain, dpd_def tolerant, count(*) w from c_int group by all"
CTES["p_ends"] = """
select source src, end_state fate, last_observed_month stop, max_mob age, is_left_truncated cut,
  min(first_open_month) earliest, count(*) w
from c_dim group by all"""
_DELAY_MEASURES = {"n_rows": "true", "n_dpd_raw_positive": "plain > 0", "n_dpd_def_positive": "tolerant > 0",
                   "n_dpd_raw_30_plus": "plain > 30", "n_dpd_def_30_plus": "tolerant > 30",
                   "n_30_plus_only_in_raw": "plain > 30 and tolerant <= 30"}
_DELAY_TAGS = ", ".join(f"case when {rule} then '{name}' end" for name, rule in _DELAY_MEASURES.items())
query("dpd_compare", f"""
select src source, {", ".join(f"cast(ifnull({n}, 0) as bigint) {n}" for n in _DELAY_MEASURES)}
from (select src, w, unnest([{_DELAY_TAGS}]) tag from p_delays) t
pivot (sum(w) for tag in ({", ".join(f"'{n}'" for n in _DELAY_MEASURES)})) p""")(
    lambda b: profile.dpd_compare(b.int_loan_month, b.d))
query("bucket_share", """
select source, dpd_bucket, n_rows, round(100.0e0 * n_rows / t, 2) pct
from (select source, dpd_bucket, count(*) n_rows from c_fct where is_open group by all) a
join (select source, count(*) t from c_fct where is_open group by all) b using (source)
order by source, dpd_bucket""")(lambda b: profile.bucket_share(b.fct_loan_month))
# The median of weighted ages: the two middle contracts are found by running weights.
query("end_state_profile", """
select src source, fate end_state, cast(sum(w) as bigint) n_loans, cast(sum(case when cut then w else 0 end) as bigint)
    n_left_truncated, min(earliest) min_first_open_month, any_value(middle) median_max_mob
from p_ends left join (
  select src, fate, (min(case when upto > (n - 1) // 2 then age end) + min(case when upto > n // 2 then age end)) / 2e0 middle
  from (select src, fate, age, sum(w) over (partition by src, fate order by age, cut, stop rows unbounded preceding) upto,
          sum(w) over (partition by src, fate) n from p_ends where age is not null) r
  group by src, fate) m using (src, fate)
group by src, fate order by source, end_state""", "median_max_mob")(
    lambda b: profile.end_state_profile(b.dim_loan))
query("stop_month_topk", """
select stop last_observed_month, fate end_state, cast(sum(w) as bigint) n_loans
from p_ends semi join (values ('censored'), ('unknown')) as v(fate) using (fate)
group by stop, fate order by stop desc, fate limit 15""")(lambda b: profile.stop_months(b.dim_loan))
# A contract's month of age 0 is its first open one.
query("paid_at_mob0_topk", """
select paid installments_paid_at_mob0, count(*) n_loans
from (select p.installments_total - p.installments_remaining paid
      from c_dim x join c_int p on p.sk_id_prev = x.sk_id_prev and p.months_balance = x.first_open_month
      where x.source = 'pos_cash') o
group by paid order by n_loans desc, paid nulls last limit 10""")(
    lambda b: profile.paid_at_first_month(b.fct_loan_month, b.d))
query("payment_profile", """
select count(*) n_rows, count(*) - count(days_paid) n_null_days_paid, count(*) - count(payment_amount) n_null_payment,
  count(case when payment_amount = 0 then 1 end) n_zero_payment, count(distinct installment_version) n_versions
from s_inst""")(lambda b: profile.payment_profile(b.stg("installments_payments")))

# ---- the build -------------------------------------------------------------------------------

_BUILT = {("core", "int_loan_month"): "c_int", ("core", "dim_loan"): "c_dim", ("core", "fct_loan_month"): "c_fct",
          ("core", "loan_outcome"): "c_out", ("core", "open_months"): "c_fct where is_open",
          ("mart", "funnel_by_channel"): "m_fun", ("mart", "fpd_by_segment"): "m_fpd", ("mart", "vintage"): "m_vin",
          ("mart", "roll"): "m_roll", ("mart", "portfolio_snapshot"): "m_snap"}


@query("build_manifest", " union all ".join(
    f"select '{layer}' layer, '{name}' table_name, count(*) n_rows from {rows}" for (layer, name), rows in _BUILT.items()))
def build_manifest(b):
    """What a build consists of, counted from the written tables: the manifest's tables with their rows."""
    b.build()
    rows = [r for r in b.store.rows() if r[:2] in _BUILT]
    return b.spark.createDataFrame(rows, "layer string, table_name string, n_rows long")
