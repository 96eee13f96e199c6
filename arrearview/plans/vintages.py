"""Analyses of the vintage mart: levels, channel and product comparisons, the risk segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrearview.functions import labels
from arrearview.functions.stats import bonferroni_z, proportion, risk_ratio_bounds, share
from arrearview.operators import pairs
from arrearview.operators.rollup import VINTAGE_SUMS, by_definition, rollup_levels, share_within, vintage_cells
from arrearview.operators.standardise import standardise
from arrearview.params import Definitions

CASH, CONSUMER, CARDS = "Cash loans", "Consumer loans", "Revolving loans"
# The channel comparisons named in the reports.
KEY_CHANNEL = "Stone"
KEY_REFERENCES = ("Country-wide", "Regional / Local", "Credit and cash offices")
CASH_OFFICES = "Credit and cash offices"


def named_channels(d: Definitions) -> Column:
    return ~F.col("channel_type").isin(d.no_application, d.missing, d.small_channel_group)


def levels(vintage: DataFrame, d: Definitions) -> DataFrame:
    """Ever past due at the reporting ages: total, by product, by channel, by both; one job.

    `scope` is `labelled` for the total without contracts lacking an application.
    """
    mobs = (0, *d.report_mobs)
    known = F.col("contract_type") != d.no_application
    rows = vintage.where(F.col("mob").isin(*mobs)).withColumn(
        "scope", F.when(known, "labelled").otherwise("unlabelled"))
    sets = [["mob"], ["mob", "scope"], ["mob", "contract_type"], ["mob", "channel_type"],
            ["mob", "contract_type", "channel_type"]]
    cells = rollup_levels(rows, sets, VINTAGE_SUMS)
    n = "n"
    return (
        cells.where(F.coalesce(F.col("scope"), F.lit("all")) != "unlabelled")
        .select("mob", F.coalesce("scope", F.lit("all")).alias("scope"), "contract_type", "channel_type",
                "n", "n_full", "k", "k_nt",
                proportion("k", n, d).alias("primary"),
                proportion("k_nt", n, d).alias("no_threshold"))
    )


def product_ratios(vintage: DataFrame, d: Definitions, mob: int = 12) -> DataFrame:
    """Every product against the base product, by both definitions."""
    cells = by_definition(vintage_cells(vintage, ["contract_type"], (mob,), labels.is_labelled_product(d)))
    return pairs.with_ratio(pairs.against_base(cells, ["mob", "definition"], "contract_type", d.base_product), d)


def channel_cells(vintage: DataFrame, d: Definitions) -> DataFrame:
    """Product × channel cells of labelled products at the reporting ages, one row per definition."""
    return by_definition(vintage_cells(
        vintage, ["contract_type", "channel_type"], d.report_mobs, labels.is_labelled_product(d)))


def channel_smr(vintage: DataFrame, d: Definitions) -> DataFrame:
    """Channels against the rates of their products."""
    return standardise(channel_cells(vintage, d), ["mob", "definition", "channel_type"],
                       ["mob", "definition", "contract_type"], d)


def channel_product_mix(vintage: DataFrame, d: Definitions) -> DataFrame:
    cells = vintage_cells(vintage, ["channel_type", "contract_type"], d.report_mobs, labels.is_labelled_product(d))
    return cells.select("mob", "channel_type", "contract_type", "n",
                        share_within("n", ["mob", "channel_type"]).alias("share"))


def reference_rates(vintage: DataFrame, d: Definitions) -> DataFrame:
    cells = vintage_cells(vintage, ["contract_type"], d.report_mobs, labels.is_labelled_product(d))
    return by_definition(cells).withColumn("rate", proportion("k", "n", d)).drop("n_full")


def channel_pairs(vintage: DataFrame, d: Definitions) -> DataFrame:
    """Named channels two by two within each product; both cells must reach the minimum sample."""
    cells = channel_cells(vintage, d).where(
        named_channels(d) & F.col("contract_type").isin(*d.products) & (F.col("n") >= d.min_n))
    return pairs.with_ratio(pairs.unordered_pairs(cells, ["mob", "definition", "contract_type"], "channel_type"), d)


def channel_pairs_pooled(vintage: DataFrame, d: Definitions) -> DataFrame:
    """The pairs pooled over products; `in_all_products` marks pairs comparable everywhere."""
    out = pairs.pooled(channel_pairs(vintage, d), ["mob", "definition", "unit_a", "unit_b"], d)
    return out.withColumn("in_all_products", F.col("n_strata") == len(d.products))


def pairs_in_all_products(vintage: DataFrame, d: Definitions) -> DataFrame:
    return (
        channel_pairs_pooled(vintage, d)
        .where((F.col("definition") == "primary") & F.col("in_all_products"))
        .select("mob", F.concat_ws(" / ", "unit_a", "unit_b").alias("pair")))


def key_pairs(vintage: DataFrame, d: Definitions) -> DataFrame:
    """One channel against three others, per product."""
    cells = channel_cells(vintage, d).where(F.col("contract_type").isin(*d.products))
    return pairs.with_ratio(pairs.directed_pairs(
        cells, ["mob", "definition", "contract_type"], "channel_type", KEY_CHANNEL, KEY_REFERENCES), d)


def key_pairs_pooled(vintage: DataFrame, d: Definitions) -> DataFrame:
    return pairs.pooled(key_pairs(vintage, d), ["mob", "definition", "unit_a", "unit_b"], d, comparable_only=True)


def crude_pair(vintage: DataFrame, d: Definitions) -> DataFrame:
    cells = by_definition(vintage_cells(vintage, ["channel_type"], d.report_mobs))
    return pairs.with_ratio(pairs.directed_pairs(
        cells, ["mob", "definition"], "channel_type", KEY_CHANNEL, (CASH_OFFICES,)), d)


def card_pair(vintage: DataFrame, d: Definitions, mob: int = 12) -> DataFrame:
    """One descriptive pair: card contracts of the key channel against the cash offices."""
    return key_pairs(vintage, d).where(
        (F.col("mob") == mob) & (F.col("definition") == "primary") & (F.col("contract_type") == CARDS)
        & (F.col("unit_b") == CASH_OFFICES)
    ).withColumn("n_cases_total", F.col("k1") + F.col("k0"))


# ---- risk segment within consumer loans ------------------------------------------------------

def in_segment() -> Column:
    return (F.col("client_type") == "New") & (F.col("yield_group") == "high")


def segment_grid(vintage: DataFrame, dims: list[str], d: Definitions, product: str = CONSUMER) -> DataFrame:
    """Each cell of a grid within one product: its shares, its rate, its ratio to the rest."""
    cells = by_definition(vintage_cells(vintage, dims, d.report_mobs, F.col("contract_type") == product))
    whole = ["mob", "definition"]
    shares = cells.withColumn("share_of_loans", share_within("n", whole)).withColumn(
        "share_of_cases", share_within("k", whole))
    rated = pairs.with_ratio(pairs.against_rest(shares, whole), d)
    return rated.withColumn("rate", proportion("k1", "n1", d)).drop("n_full")


def segment_totals(vintage: DataFrame, d: Definitions, product: str = CONSUMER) -> DataFrame:
    cells = vintage_cells(vintage, ["client_type", "yield_group"], d.report_mobs, F.col("contract_type") == product)
    return by_definition(cells).groupBy("mob", "definition").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("n_combinations"),
        F.count_if(F.col("n") >= d.min_n).alias("n_combinations_enough"),
    ).withColumn("total", proportion("k", "n", d))


def _corrected(row: DataFrame, tests: Column, d: Definitions) -> DataFrame:
    """Interval of the segment ratio at the quantile for `tests` comparisons."""
    wide = row.withColumn("tests", tests).withColumn("z", bonferroni_z(F.col("tests"), d))
    bounds = risk_ratio_bounds("rr.ratio", "k1", "n1", "k0", "n0", "z")
    return wide.withColumn("ci", bounds).select(
        "mob", "tests", F.col("rr.ratio").alias("ratio"), "ci.lo", "ci.hi")


def segment_bonferroni(vintage: DataFrame, d: Definitions) -> DataFrame:
    """Segment ratio corrected for the number of cells with enough contracts."""
    grid = segment_grid(vintage, ["client_type", "yield_group"], d).where("definition = 'primary'")
    looked = F.sum((F.col("n1") >= d.min_n).cast("long")).over(Window.partitionBy("mob"))
    return _corrected(grid.withColumn("_m", F.greatest(looked, F.lit(1))).where(in_segment()), F.col("_m"), d)


def segment_bonferroni_counts(vintage: DataFrame, d: Definitions, counts=(12, 36, 144), mob: int = 12) -> DataFrame:
    """The same for fixed numbers of comparisons at one age."""
    grid = segment_grid(vintage, ["client_type", "yield_group"], d)
    row = grid.where((F.col("definition") == "primary") & (F.col("mob") == mob) & in_segment())
    spread = row.withColumn("_m", F.explode(F.array(*[F.lit(c).cast("long") for c in counts])))
    return _corrected(spread, F.col("_m"), d)


def _split(vintage: DataFrame, dims: list[str], flag: Column, d: Definitions, mob: int, where: Column) -> DataFrame:
    """Cells at one age split by a condition: both groups, their rates, their shares and their ratio."""
    cells = by_definition(
        vintage_cells(vintage, [*dims, "channel_type", "client_type", "yield_group"], (mob,), where))
    two = pairs.two_groups(cells, ["definition", *dims], flag).where(
        F.col("n1").isNotNull() & F.col("n0").isNotNull())
    k1, n1, k0, n0 = "k1", "n1", "k0", "n0"
    return pairs.with_ratio(two, d).withColumns({
        "inside": proportion(k1, n1, d), "outside": proportion(k0, n0, d),
        "share_of_loans": share(F.col("n1"), F.col("n1") + F.col("n0")),
        "share_of_cases": share(F.col("k1"), F.col("k1") + F.col("k0"))})


def segment_by_tenor(vintage: DataFrame, d: Definitions, mob: int = 12) -> DataFrame:
    return _split(vintage, ["tenor_group"], in_segment(), d, mob, F.col("contract_type") == CONSUMER)


def _former_channels() -> Column:
    return F.col("channel_type").isin("Stone", "Country-wide")


def former_segment(vintage: DataFrame, d: Definitions, mob: int = 12) -> DataFrame:
    """The former segment, which also asked for two channels, against the other consumer loans."""
    return _split(vintage, [], _former_channels() & in_segment(), d, mob, F.col("contract_type") == CONSUMER)


def channel_condition(vintage: DataFrame, d: Definitions, mob: int = 12) -> DataFrame:
    """Within the segment: do the two channels still tell anything?"""
    return _split(vintage, [], _former_channels(), d, mob, (F.col("contract_type") == CONSUMER) & in_segment())
