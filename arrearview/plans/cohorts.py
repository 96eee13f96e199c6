"""Origination cohorts: a second stratum next to the product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrearview.functions import labels
from arrearview.functions.stats import proportion, share
from arrearview.operators import pairs
from arrearview.operators.rollup import by_definition, share_within
from arrearview.operators.standardise import standardise, with_expected
from arrearview.params import Definitions
from arrearview.plans.experiments import at_ages, ever
from arrearview.plans.vintages import CARDS, CONSUMER, KEY_CHANNEL

COUNTS = ["n", "n_full", "k", "k_nt", "k_due", "k_due_raw", "k1"]
FOUR = {"primary": "k", "due_only": "k_due", "due_only_card_raw": "k_due_raw", "no_threshold": "k_nt"}
TWO = {"primary": "k", "due_only": "k_due"}
PRODUCT_ONLY = "product_only"

# The three hand-set cohorts as (last month, first month, label).
HAND_SET = ((-60, -96, "-60 and earlier"), (-36, -59, "-59 to -36"), (-1, -35, "-35 and later"))


def cohort_cells(outcome: DataFrame, d: Definitions) -> DataFrame:
    """Counts at the base grain: age × product × channel × first open month."""
    return (
        at_ages(outcome, d.report_mobs, d)
        .select("mob", *labels.segment_columns(d, F.col("has_application"), ("contract_type", "channel_type")),
                "first_open_month", "max_mob", "first_1_plus_mob", "first_30_plus_mob",
                "first_30_plus_no_threshold_mob", "first_30_plus_due_only_mob", "first_30_plus_due_only_card_raw_mob")
        .groupBy("mob", "contract_type", "channel_type", "first_open_month")
        .agg(F.count("*").alias("n"), F.count_if(F.col("max_mob") >= F.col("mob")).alias("n_full"),
             ever("first_30_plus_mob").alias("k"), ever("first_30_plus_no_threshold_mob").alias("k_nt"),
             ever("first_30_plus_due_only_mob").alias("k_due"),
             ever("first_30_plus_due_only_card_raw_mob").alias("k_due_raw"), ever("first_1_plus_mob").alias("k1")))


def cut(month: Column, name: str, d: Definitions) -> Column:
    """struct(scheme, start, label, last) of a month under one way of cutting cohorts."""
    if name == PRODUCT_ONLY:
        start, label, last = F.lit(d.window_start), F.lit("all"), F.lit(d.last_month)
    elif name == "cut3":
        def choose(i: int) -> Column:
            a, b, c = (F.lit(h[i]) for h in HAND_SET)
            return F.when(month <= HAND_SET[0][0], a).when(month <= HAND_SET[1][0], b).otherwise(c)

        start, label, last = choose(1), choose(2), choose(0)
    else:
        width = {"cut12": d.cohort_width, "cut24": 2 * d.cohort_width}[name]
        start = labels.cohort_start(month, d, width)
        label, last = labels.cohort_label(start, d, width), start + (width - 1)
    return F.struct(F.lit(name).alias("scheme"), start.alias("start"), label.alias("label"), last.alias("last"))


def with_cuts(cells: DataFrame, names: tuple[str, ...], d: Definitions) -> DataFrame:
    """Each grouped cell once per cutting scheme."""
    month = F.col("first_open_month")
    dims = [c for c in cells.columns if c not in COUNTS]
    return cells.withColumn("_c", F.explode(F.array(*[cut(month, n, d) for n in names]))).select(
        *dims, F.col("_c.scheme").alias("scheme"), F.col("_c.start").alias("start"),
        F.col("_c.label").alias("label"), F.col("_c.last").alias("last"), *COUNTS)


ALL_CUTS = ("cut12", "cut3", "cut24")


def _sum(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])


def labelled(cells: DataFrame, d: Definitions) -> DataFrame:
    return cells.where(labels.is_labelled_product(d))


def cuts_table(cells: DataFrame, d: Definitions) -> DataFrame:
    """Cohorts of every scheme with their last month and size at the first reporting age."""
    first = cells.where(F.col("mob") == d.report_mobs[0])
    return _sum(with_cuts(first, ALL_CUTS, d), ["scheme", "start", "label", "last"]).select(
        "scheme", "start", "label", "last", "n")


def reconcile(cells: DataFrame, vintage: DataFrame, d: Definitions) -> DataFrame:
    """The recount by first open month against the vintage mart, cell by cell: sizes and disagreements."""
    keys = ["mob", "contract_type", "channel_type", "start"]
    mine = _sum(with_cuts(cells, ("cut12",), d), keys).select(
        *keys, F.struct("n", "k", "k_due", "k_nt").alias("mine"))
    mart = (
        vintage.where(F.col("mob").isin(*d.report_mobs))
        .groupBy("mob", "contract_type", "channel_type", F.col("origination_cohort_start").alias("start"))
        .agg(F.struct(F.sum("n_loans").alias("n"), F.sum("n_ever_30_plus").alias("k"),
                      F.sum("n_ever_30_plus_due_only").alias("k_due"),
                      F.sum("n_ever_30_plus_no_threshold").alias("k_nt")).alias("mart")))
    return mine.join(mart, keys, "full").agg(
        F.count("mine").alias("n_cells_recount"), F.count("mart").alias("n_cells_mart"),
        F.count_if(~F.col("mine").eqNullSafe(F.col("mart"))).alias("n_mismatch"))


def cohort_sizes(vintage: DataFrame) -> DataFrame:
    return vintage.where("mob = 0").groupBy("origination_cohort", "origination_cohort_start").agg(
        F.sum("n_loans").alias("n"))


def _aged(cells: DataFrame, d: Definitions) -> DataFrame:
    """Contracts opened early enough to be seen at the age; younger ones would only show early closers."""
    return labelled(cells, d).where(F.col("first_open_month") <= d.last_month - F.col("mob"))


def cohort_vintage(cells: DataFrame, d: Definitions) -> DataFrame:
    """Vintage per cohort by product, and in total (product NULL), for three ways of cutting."""
    rows = with_cuts(_aged(cells, d), ALL_CUTS, d)
    keys = ["mob", "scheme", "start", "label"]
    both = rows.groupingSets([[F.col(c) for c in keys], [F.col(c) for c in (*keys, "contract_type")]],
                             *keys, "contract_type").agg(*[F.sum(c).alias(c) for c in COUNTS])
    n = "n"
    return both.select(*keys, "contract_type", "n", "n_full", "k", "k_due",
                       proportion("k", n, d).alias("primary"), proportion("k_due", n, d).alias("due_only"))


def oldest_against_newest(cells: DataFrame, d: Definitions) -> DataFrame:
    """Oldest cohort against the newest old enough, per product with at least two cohorts."""
    per = _sum(with_cuts(_aged(cells, d), ALL_CUTS, d), ["mob", "scheme", "contract_type", "start", "label"])
    ends = per.where(F.col("contract_type").isin(*d.products)).groupBy("mob", "scheme", "contract_type").agg(
        F.min_by(F.struct("label", "k", "n"), "start").alias("o"),
        F.max_by(F.struct("label", "k", "n"), "start").alias("w"), F.count("*").alias("n_cohorts"))
    flat = ends.where("n_cohorts >= 2").select(
        "mob", "scheme", "contract_type", F.col("o.label").alias("oldest"), F.col("w.label").alias("newest"),
        F.col("o.k").alias("k1"), F.col("o.n").alias("n1"), F.col("w.k").alias("k0"), F.col("w.n").alias("n0"))
    return pairs.with_ratio(flat, d)


def cohort_mix(cells: DataFrame, d: Definitions) -> DataFrame:
    """Cohort shares within every channel and product."""
    rows = with_cuts(labelled(cells, d), ("cut12", "cut3"), d)
    per = _sum(rows, ["mob", "scheme", "channel_type", "contract_type", "start", "label"])
    return per.select(
        "mob", "scheme", "channel_type", "contract_type", "start", "label", "n", "k",
        share_within("n", ["mob", "scheme", "channel_type", "contract_type"]).alias("share"),
        proportion("k", "n", d).alias("primary"))


def _strata(cells: DataFrame, definitions: dict[str, str], d: Definitions) -> DataFrame:
    """Channel × product × cohort under no cut and three cuts, one row per definition."""
    rows = with_cuts(labelled(cells, d), (PRODUCT_ONLY, *ALL_CUTS), d)
    return by_definition(_sum(rows, ["mob", "scheme", "channel_type", "contract_type", "start"]), definitions)


def smr_schemes(cells: DataFrame, d: Definitions) -> DataFrame:
    """Channels against product rates, and against product × cohort rates by three cuts."""
    return standardise(_strata(cells, TWO, d), ["mob", "scheme", "definition", "channel_type"],
                       ["mob", "scheme", "definition", "contract_type", "start"], d)


def smr_excess(cells: DataFrame, d: Definitions) -> DataFrame:
    """Observed less expected of every channel, split by product."""
    rows = with_expected(_strata(cells, TWO, d), ["mob", "scheme", "definition", "contract_type", "start"])
    return rows.groupBy("mob", "scheme", "definition", "channel_type", "contract_type").agg(
        F.sum("n").alias("n"), F.sum("k").alias("observed"), F.sum("expected").alias("expected"),
    ).withColumn("excess", F.col("observed") - F.col("expected"))


def _product_sides(cells: DataFrame, d: Definitions) -> DataFrame:
    per = _strata(cells, FOUR, d).groupBy("mob", "scheme", "definition", "contract_type", "start").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"))
    return pairs.against_base(per, ["mob", "scheme", "definition", "start"], "contract_type", d.base_product)


def product_ratio_crude(cells: DataFrame, d: Definitions) -> DataFrame:
    crude = _product_sides(cells, d).where(F.col("scheme") == PRODUCT_ONLY)
    return pairs.with_ratio(crude.drop("scheme", "start"), d)


def _rated(sides: DataFrame, d: Definitions) -> DataFrame:
    return sides.withColumns({"group1": proportion("k1", "n1", d), "group0": proportion("k0", "n0", d)})


def product_ratio_strata(cells: DataFrame, d: Definitions) -> DataFrame:
    """Both sides of the pooled product ratios, cohort by cohort."""
    return _rated(_product_sides(cells, d).where(F.col("scheme") != PRODUCT_ONLY), d)


def product_ratio_pooled(cells: DataFrame, d: Definitions) -> DataFrame:
    """Products against the base product, pooled over the cohorts of each cut."""
    return pairs.pooled(_product_sides(cells, d).where(F.col("scheme") != PRODUCT_ONLY),
                        ["mob", "scheme", "definition", "contract_type"], d)


def _channel_sides(cells: DataFrame, d: Definitions, other: str) -> DataFrame:
    per = _strata(cells, TWO, d)
    two = per.where((F.col("scheme") == PRODUCT_ONLY) & F.col("contract_type").isin(CONSUMER, CARDS)).withColumn(
        "scheme", F.lit("consumer_and_card"))
    keys = ["mob", "scheme", "definition", "contract_type", "start"]
    return pairs.directed_pairs(per.unionByName(two), keys, "channel_type", KEY_CHANNEL, (other,))


def channel_pair_strata(cells: DataFrame, d: Definitions, other: str = "Country-wide") -> DataFrame:
    """Both sides of the pooled channel ratio, stratum by stratum."""
    return _rated(_channel_sides(cells, d, other), d).drop("unit_a", "unit_b")


def channel_pair_pooled(cells: DataFrame, d: Definitions, other: str = "Country-wide") -> DataFrame:
    """One channel against another under five stratifications; only strata with both sides count."""
    return pairs.pooled(_channel_sides(cells, d, other), ["mob", "scheme", "definition"], d)


CARD_CHANNELS = ("Contact center", "Stone", "Credit and cash offices", "Country-wide")


def cards_by_cohort(cells: DataFrame, d: Definitions) -> DataFrame:
    """Where the card cases of four channels come from."""
    rows = cells.where((F.col("contract_type") == CARDS) & F.col("channel_type").isin(*CARD_CHANNELS))
    per = _sum(with_cuts(rows, ("cut12", "cut3"), d), ["mob", "scheme", "channel_type", "start", "label"])
    channel = Window.partitionBy("mob", "scheme", "channel_type")
    return per.select(
        "mob", "scheme", "channel_type", "start", "label", "n", "k",
        F.sum("n").over(channel).alias("n_channel"), F.sum("k").over(channel).alias("k_channel"),
        proportion("k", "n", d).alias("primary"),
        share_within("k", ["mob", "scheme", "channel_type"]).alias("share_of_cases"),
    ).withColumn("total", proportion("k_channel", "n_channel", d))


def cohort_curve(vintage: DataFrame, d: Definitions) -> DataFrame:
    """Curve of each cohort, as far as all its contracts can have come."""
    last_of_cohort = F.col("origination_cohort_start") + (d.cohort_width - 1)
    rows = vintage.where(labels.is_labelled_product(d) & (last_of_cohort <= d.last_month - F.col("mob")))
    return rows.groupBy("origination_cohort", "origination_cohort_start", "mob").agg(
        F.sum("n_loans").alias("n"), F.sum("n_ever_30_plus").alias("k"),
    ).withColumn("rate", share(F.col("k"), F.col("n")))


def cohort_curve_points(vintage: DataFrame, d: Definitions) -> DataFrame:
    """The curves with their points as one array per cohort (one point per age, 37 at most)."""
    return cohort_curve(vintage, d).groupBy("origination_cohort", "origination_cohort_start").agg(
        F.sort_array(F.collect_list(F.struct("mob", "n", "k", "rate"))).alias("points"))
