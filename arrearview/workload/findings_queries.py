"""The findings document: written as JSON, read back, compared number by number."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrearview.plans.findings import SECTIONS, findings
from arrearview.sources.exports import read_findings, write_findings
from arrearview.workload.registry import BODIES, query

# Sections whose rows carry an age.
_WITH_MOB = {
    "vintage_levels", "product_ratios", "reference_rates", "channel_smr", "channel_product_mix", "channel_pairs",
    "channel_pairs_pooled", "key_pairs", "key_pairs_pooled", "crude_pair", "segment_totals", "segment_grid",
    "segment_bonferroni", "segment_bonferroni_counts", "yield_grid", "approval_experiment", "denominator_rules", "cohort_vintage",
    "cohort_old_new", "cohort_mix", "smr_schemes", "smr_excess", "product_ratio_crude", "product_ratio_cohort_mh",
    "channel_pair_cohort_mh", "cards_by_cohort", "cohort_curve", "product_ratio_strata", "channel_pair_strata"}


def _section(name: str) -> str:
    """Number columns of one check turned into rows, NULL numbers left out on both sides."""
    dims = SECTIONS[name][1]
    keys = [*dims, *(("mob",) if name in _WITH_MOB else ())]
    skip = f"* exclude ({', '.join(keys)})" if keys else "*"
    text = f"concat_ws(';', {', '.join(f'''{chr(39)}{k}={chr(39)} || {k}''' for k in sorted(dims))})" if dims else "''"
    mob = "mob" if name in _WITH_MOB else "cast(null as int)"
    kept = "".join(f"{k}, " for k in keys)
    return (f"select '{name}' section, cast({mob} as int) mob, {text} dims, measure, round(\"value\", 10) \"value\", "
            f"cast(null as varchar) text from (unpivot "
            f"(select {kept}cast(columns({skip}) as double) from ({BODIES[name]}) s) on columns({skip}) "
            f"into name measure value \"value\") u")


# The rules behind the numbers: the workload's smallest group is 30.
_META = """
select 'meta' section, cast(null as int) mob, '' dims, measure, "value", text
from (values ('z', 1.959963985e0, null), ('z_power', 0.841621234e0, null), ('min_n', 30e0, null),
  ('past_due_days', 30e0, null), ('severe_days', 90e0, null), ('grace_days', 30e0, null), ('paid_tolerance', 0.95e0, null),
  ('first_month', -96e0, null), ('last_month', -1e0, null), ('max_mob', 36e0, null),
  ('definition_primary', null, 'past due over 30 days by the delay with tolerance for small debts'),
  ('definition_no_threshold', null, 'past due over 30 days by the plain delay'),
  ('definition_buckets', null, 'B0 Current; B1 1-30; B2 31-60; B3 61-90; B4 90+'),
  ('interval_rate', null, 'Wilson, 95 %'),
  ('interval_ratio', null, 'Katz on the log scale, 95 %, one half added where a cell is empty'),
  ('interval_standardised_ratio', null, 'Byar, 95 %'), ('interval_pooled', null, 'Mantel-Haenszel, 95 %'),
  ('significant', null, 'the 95 % interval of a ratio leaves out 1'),
  ('enough_n', null, 'groups of at least 30 are interpreted')) as m(measure, "value", text)"""


@query("findings", " union all ".join([_META, *(_section(n) for n in SECTIONS)]), '"value"')
def findings_document(b):
    path = f"{b.store.folder}/export/findings"
    write_findings(findings(b), path)
    pairs = F.transform(F.array_sort(F.map_entries("dims")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return read_findings(b.spark, path).where("value is not null or text is not null").select(
        "section", "mob", F.coalesce(F.array_join(pairs, ";"), F.lit("")).alias("dims"),
        F.replace("measure", F.lit("."), F.lit("_")).alias("measure"), "value", "text")
