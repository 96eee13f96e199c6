"""The findings: every published number as one row of a tidy table.

A row is addressed by section, age, dimensions and measure. Fields of an interval or a test are
measures with a dotted name (`primary.rate`, `primary.lo`); flags are 0 or 1. The section `meta` says
by what rules the numbers were made; its measures have a value or a text.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrearview.book import LoanBook
from arrearview.functions.stats import clean
from arrearview.params import Definitions
from arrearview.plans import cohorts as c
from arrearview.plans import experiments as x
from arrearview.plans import origination as o
from arrearview.plans import portfolio as p
from arrearview.plans import transitions as t
from arrearview.plans import vintages as v

PAIR = ("definition", "unit_a", "unit_b")
SECTIONS: dict[str, tuple[Callable[[LoanBook], DataFrame], tuple[str, ...]]] = {
    "portfolio_totals": (lambda b: p.totals(b.dim_loan, b.fct_loan_month, b.stg("previous_application"), b.d), ()),
    "end_state_mix": (lambda b: p.end_state_mix(b.dim_loan), ("end_state",)),
    "product_mix": (lambda b: p.product_mix(b.dim_loan, b.d), ("contract_type",)),
    "vintage_base": (lambda b: p.vintage_base_counts(b.dim_loan), ()),
    "snapshot_buckets": (lambda b: p.snapshot_buckets(b.portfolio_snapshot, b.open_months, b.d),
                         ("definition", "dpd_bucket")),
    "kpi_same_set": (lambda b: p.kpi_same_set(b.portfolio_snapshot, b.d), ("scope",)),
    "unknown_share": (lambda b: p.unknown_share(b.portfolio_snapshot, b.d), ()),
    "snapshot_levels": (lambda b: p.snapshot_levels(b.portfolio_snapshot, b.d), ("channel_type", "contract_type")),
    "exposure_missing": (lambda b: p.exposure_missing(b.open_months, b.d), ()),
    "vintage_levels": (lambda b: v.levels(b.vintage, b.d), ("channel_type", "contract_type", "scope")),
    "product_ratios": (lambda b: v.product_ratios(b.vintage, b.d), ("contract_type", "definition")),
    "reference_rates": (lambda b: v.reference_rates(b.vintage, b.d), ("contract_type", "definition")),
    "channel_smr": (lambda b: v.channel_smr(b.vintage, b.d), ("channel_type", "definition")),
    "channel_product_mix": (lambda b: v.channel_product_mix(b.vintage, b.d), ("channel_type", "contract_type")),
    "channel_pairs": (lambda b: v.channel_pairs(b.vintage, b.d), ("contract_type", *PAIR)),
    "channel_pairs_pooled": (lambda b: v.channel_pairs_pooled(b.vintage, b.d), PAIR),
    "key_pairs": (lambda b: v.key_pairs(b.vintage, b.d), ("contract_type", *PAIR)),
    "key_pairs_pooled": (lambda b: v.key_pairs_pooled(b.vintage, b.d), PAIR),
    "crude_pair": (lambda b: v.crude_pair(b.vintage, b.d), PAIR),
    "segment_totals": (lambda b: v.segment_totals(b.vintage, b.d), ("definition",)),
    "segment_grid": (lambda b: v.segment_grid(b.vintage, ["client_type", "yield_group"], b.d),
                     ("client_type", "definition", "yield_group")),
    "segment_bonferroni": (lambda b: v.segment_bonferroni(b.vintage, b.d), ()),
    "segment_bonferroni_counts": (lambda b: v.segment_bonferroni_counts(b.vintage, b.d), ("tests",)),
    "yield_grid": (lambda b: v.segment_grid(b.vintage, ["yield_group"], b.d), ("definition", "yield_group")),
    "segment_by_tenor": (lambda b: v.segment_by_tenor(b.vintage, b.d), ("definition", "tenor_group")),
    "former_segment": (lambda b: v.former_segment(b.vintage, b.d), ("definition",)),
    "channel_condition": (lambda b: v.channel_condition(b.vintage, b.d), ("definition",)),
    "roll_cure_summary": (lambda b: t.roll_cure_summary(b.roll, b.d), ("definition", "from_state", "scope")),
    "roll_to_counts": (lambda b: t.to_counts(b.roll, b.d), ("definition", "from_state", "scope")),
    "roll_totals": (lambda b: t.roll_totals(b.roll, b.d), ()),
    "cure_by_cohort": (lambda b: t.cure_by_cohort(b.transition_base, b.d), ("origination_cohort",)),
    "cure_by_cohort_mh": (lambda b: t.cure_by_cohort_pooled(b.transition_base, b.d), ()),
    "first_b1_cure": (lambda b: t.first_b1_cure(b.transition_base, b.d), ()),
    "first_b1_sample": (lambda b: t.first_b1_sample(b.transition_base, b.d), ("points",)),
    "collections_experiment": (lambda b: t.collections_experiment(b.roll, b.d), ()),
    "approval_levels": (lambda b: o.approval_levels(b.funnel_by_channel, b.d), ("channel_type", "contract_type")),
    "approval_standardised": (lambda b: o.approval_standardised(b.funnel_by_channel, b.d), ("channel_type",)),
    "take_up_consumer": (lambda b: o.take_up(b.funnel_by_channel, b.d), ("channel_type",)),
    "fpd_levels": (lambda b: o.fpd_levels(b.fpd_by_segment, b.d), ("channel_type", "contract_type")),
    "approval_experiment": (lambda b: x.approval_experiment(b.loan_outcome, b.vintage, b.d), ("metric", "population")),
    "early_validation": (lambda b: x.early_validation(b.loan_outcome, b.d), ()),
    "early_split": (lambda b: x.early_split(b.loan_outcome, b.d), ()),
    "card_channel_sample": (lambda b: x.card_channel_sample(b.loan_outcome, b.d), ()),
    "denominator_rules": (lambda b: x.denominator_rules(b.loan_outcome, b.d), ("contract_type", "rule")),
    "stop_profile": (lambda b: x.stop_profile(b.dim_loan), ("end_state", "source", "stopped_late")),
    "stopped_between": (lambda b: x.stopped_between(b.dim_loan), ()),
    "unknown_in_vintage": (lambda b: x.unknown_in_vintage(b.loan_outcome, b.d), ()),
    "late_timing_grouping_sets": (lambda b: x.late_timing(b.open_months, b.d), ("at_offices",)),
    "inferred_closed_cases": (lambda b: x.inferred_closed_cases(b.loan_outcome), ()),
    "cohort_reconcile": (lambda b: c.reconcile(b.cohort_cells, b.vintage, b.d), ()),
    "cohort_sizes": (lambda b: c.cohort_sizes(b.vintage), ("origination_cohort",)),
    "cohort_vintage": (lambda b: c.cohort_vintage(b.cohort_cells, b.d), ("contract_type", "label", "scheme")),
    "cohort_old_new": (lambda b: c.oldest_against_newest(b.cohort_cells, b.d),
                       ("contract_type", "newest", "oldest", "scheme")),
    "cohort_mix": (lambda b: c.cohort_mix(b.cohort_cells, b.d), ("channel_type", "contract_type", "label", "scheme")),
    "smr_schemes": (lambda b: c.smr_schemes(b.cohort_cells, b.d), ("channel_type", "definition", "scheme")),
    "smr_excess": (lambda b: c.smr_excess(b.cohort_cells, b.d),
                   ("channel_type", "contract_type", "definition", "scheme")),
    "product_ratio_crude": (lambda b: c.product_ratio_crude(b.cohort_cells, b.d), ("contract_type", "definition")),
    "product_ratio_cohort_mh": (lambda b: c.product_ratio_pooled(b.cohort_cells, b.d),
                                ("contract_type", "definition", "scheme")),
    "product_ratio_strata": (lambda b: c.product_ratio_strata(b.cohort_cells, b.d),
                             ("contract_type", "definition", "scheme", "start")),
    "channel_pair_strata": (lambda b: c.channel_pair_strata(b.cohort_cells, b.d),
                            ("contract_type", "definition", "scheme", "start")),
    "channel_pair_cohort_mh": (lambda b: c.channel_pair_pooled(b.cohort_cells, b.d), ("definition", "scheme")),
    "cards_by_cohort": (lambda b: c.cards_by_cohort(b.cohort_cells, b.d), ("channel_type", "label", "scheme")),
    "cohort_curve": (lambda b: c.cohort_curve(b.vintage, b.d), ("origination_cohort",)),
}


def tidy(section: str, df: DataFrame, dims: tuple[str, ...], d: Definitions) -> DataFrame:
    """Rows (section, mob, dims, measure, value, text): one per number of the analysis, without text."""
    numbers = []
    for f in df.schema.fields:
        if f.name in dims or f.name == "mob":
            continue
        if isinstance(f.dataType, T.StructType):
            numbers += [(f"{f.name}.{g.name}", F.col(f"`{f.name}`.`{g.name}`")) for g in f.dataType.fields]
        elif not isinstance(f.dataType, T.StringType):
            numbers.append((f.name, F.col(f"`{f.name}`")))
    entry = F.map_filter(
        F.create_map(*[part for n in dims for part in (F.lit(n), F.col(n).cast("string"))]),
        lambda key, value: value.isNotNull()) if dims else F.create_map().cast("map<string,string>")
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("measure"), clean(value.cast("double"), d).alias("value"))
        for name, value in numbers]))
    mob = F.col("mob").cast("int") if "mob" in df.columns else F.lit(None).cast("int")
    return df.select(F.lit(section).alias("section"), mob.alias("mob"), entry.alias("dims"), rows.alias("r")).select(
        "section", "mob", "dims", "r.measure", "r.value", F.lit(None).cast("string").alias("text"))


def meta(spark: SparkSession, d: Definitions) -> DataFrame:
    """What a reader needs to interpret the numbers: measure, value, text."""
    level = f"{100 * d.confidence:g} %"
    buckets = "; ".join(d.bucket_labels)
    rows = [
        ("z", round(d.z, d.digits), None),
        ("z_power", round(d.z_power, d.digits), None),
        ("min_n", float(d.min_n), None),
        ("past_due_days", float(d.past_due_days), None),
        ("severe_days", float(d.severe_days), None),
        ("grace_days", float(d.grace_days), None),
        ("paid_tolerance", d.paid_tolerance, None),
        ("first_month", float(d.window_start), None),
        ("last_month", float(d.last_month), None),
        ("max_mob", float(d.max_mob), None),
        ("definition.primary", None, f"past due over {d.past_due_days} days by the delay with tolerance for small debts"),
        ("definition.no_threshold", None, f"past due over {d.past_due_days} days by the plain delay"),
        ("definition.buckets", None, buckets),
        ("interval.rate", None, f"Wilson, {level}"),
        ("interval.ratio", None, f"Katz on the log scale, {level}, one half added where a cell is empty"),
        ("interval.standardised_ratio", None, f"Byar, {level}"),
        ("interval.pooled", None, f"Mantel-Haenszel, {level}"),
        ("significant", None, f"the {level} interval of a ratio leaves out 1"),
        ("enough_n", None, f"groups of at least {d.min_n} are interpreted"),
    ]
    found = spark.createDataFrame(rows, "measure string, value double, text string")
    return found.select(F.lit("meta").alias("section"), F.lit(None).cast("int").alias("mob"),
                        F.create_map().cast("map<string,string>").alias("dims"), "measure", "value", "text")


def findings(book: LoanBook, parallel: int = 8) -> DataFrame:
    """All sections in one table.

    The sections are small and independent. Each is kept on its own, several jobs at a time, and the
    result is the union of the kept parts: one plan over all sections would be re-optimised as a
    whole after each of its many stages.
    """
    def part(item) -> DataFrame:
        name, (build, dims) = item
        return book.store.keep("mart", f"findings_{name}", tidy(name, build(book), dims, book.d))

    book.build()
    _ = book.cohort_cells
    with ThreadPoolExecutor(parallel) as pool:
        return reduce(DataFrame.unionByName, pool.map(part, SECTIONS.items()), meta(book.spark, book.d))
