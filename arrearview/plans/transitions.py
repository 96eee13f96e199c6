"""Roll and cure analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearview.functions import labels
from arrearview.functions.stats import arm_size_absolute, arm_size_relative, proportion, share
from arrearview.operators import pairs
from arrearview.operators.rollup import densify
from arrearview.params import Definitions


def cure_rate(roll: DataFrame, d: Definitions) -> DataFrame:
    """Share of past-due origins that are without delay a month later, per definition."""
    current = d.bucket_labels[0]
    return (
        roll.where(F.col("from_state") != current)
        .groupBy("definition", "from_state")
        .agg(F.sum("n_loans").alias("n"),
             F.coalesce(F.sum(F.when(F.col("to_state") == current, F.col("n_loans"))), F.lit(0)).alias("k"))
        .withColumn("cure_rate", share(F.col("k"), F.col("n"))))


def portfolio_matrix(roll: DataFrame) -> DataFrame:
    """Matrix of the whole portfolio: window totals over the grouped cells."""
    return roll.sparkSession.sql("""
        SELECT definition, from_state, to_state, sum(n_loans) AS n_loans,
               sum(n_loans) / CAST(sum(sum(n_loans)) OVER (PARTITION BY definition, from_state) AS DOUBLE) AS rate
        FROM {roll}
        GROUP BY definition, from_state, to_state
        ORDER BY definition, from_state, to_state""", roll=roll)


def _scoped(roll: DataFrame) -> DataFrame:
    """Every cell counted for the whole book and for its source."""
    return roll.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("source"))))


def roll_cure_summary(roll: DataFrame, d: Definitions) -> DataFrame:
    """Cure, roll-forward, closing and missing per origin bucket, scope and definition."""
    names, closed, missing = d.bucket_labels, d.exit_states[0], d.exit_states[2]
    worse = labels.nth(F.col("from_order"), (*names[1:], names[-1]))

    def to(state: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("to_state") == state, F.col("n_loans"))), F.lit(0))

    sums = _scoped(roll).groupBy("definition", "scope", "from_state", "from_order").agg(
        F.sum("n_loans").alias("n_from"),
        to(F.lit(names[0])).alias("k_cure"), to(worse).alias("k_forward"),
        to(F.lit(closed)).alias("k_closed"), to(F.lit(missing)).alias("k_missing"))
    n = "n_from"
    return sums.select(
        "*", proportion("k_cure", n, d).alias("cure"), proportion("k_forward", n, d).alias("forward"),
        proportion("k_closed", n, d).alias("closed"), proportion("k_missing", n, d).alias("missing"))


def to_counts(roll: DataFrame, d: Definitions) -> DataFrame:
    """Counts by target state, one column per state."""
    return (
        _scoped(roll).groupBy("definition", "scope", "from_state")
        .pivot("to_state", list(d.to_states)).agg(F.sum("n_loans"))
        .na.fill(0))


def roll_totals(roll: DataFrame, d: Definitions) -> DataFrame:
    """All origins, and the pooled cure of the past-due ones."""
    current = d.bucket_labels[0]
    late = F.col("from_state") != current
    return roll.where("definition = 'primary'").agg(
        F.sum("n_loans").alias("n_from_all_states"),
        F.sum(F.when(late, F.col("n_loans"))).alias("n_late"),
        F.sum(F.when(late & (F.col("to_state") == current), F.col("n_loans"))).alias("k_late"),
    ).withColumn("cure", proportion("k_late", "n_late", d))


def collections_experiment(roll: DataFrame, d: Definitions) -> DataFrame:
    """Sample sizes for a collections trial on the first past-due bucket, 20 % relative change."""
    row = roll_cure_summary(roll, d).where(
        (F.col("definition") == "primary") & (F.col("scope") == "all") & (F.col("from_state") == d.bucket_labels[1]))
    return row.select(
        "n_from", "k_cure", "cure", "k_forward", "forward",
        arm_size_relative("cure.rate", 0.20, d).alias("n_per_arm_cure"),
        arm_size_relative("forward.rate", -0.20, d).alias("n_per_arm_forward"),
        F.round(F.col("cure.rate") * 0.20 * 100, d.digits).alias("relative_change_in_points"))


def _cohort_cure_cells(base: DataFrame) -> DataFrame:
    return (
        base.where(F.col("o").isin(1, 2)).groupBy("cohort_start", F.col("o").alias("bucket"))
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("cured"), F.col("n")).otherwise(0)).alias("k")))


def cure_by_cohort(base: DataFrame, d: Definitions) -> DataFrame:
    """Cure of the first two past-due buckets side by side per origination cohort."""
    return (
        pairs.two_groups(_cohort_cure_cells(base), ["cohort_start"], F.col("bucket") == 1)
        .where(F.col("n1").isNotNull())
        .withColumns({
            "origination_cohort": labels.cohort_label(F.col("cohort_start"), d),
            "cure_b1": proportion("k1", "n1", d),
            "cure_b2": F.when(F.col("n0").isNotNull(), proportion("k0", "n0", d))}))


def cure_by_cohort_pooled(base: DataFrame, d: Definitions) -> DataFrame:
    two = pairs.two_groups(_cohort_cure_cells(base), ["cohort_start"], F.col("bucket") == 1)
    return pairs.pooled(two.where(F.col("n1").isNotNull() & F.col("n0").isNotNull()), [], d)


def first_b1_cure(base: DataFrame, d: Definitions) -> DataFrame:
    """Contracts by their first month in the first past-due bucket, and those without delay the month after."""
    return base.where("first_b1").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.when(F.col("cured"), F.col("n")).otherwise(0)).alias("k")
    ).withColumn("cure", proportion("k", "n", d))


def first_b1_sample(base: DataFrame, d: Definitions, points=(0.03, 0.05, 0.10)) -> DataFrame:
    """Contracts per arm to see an absolute rise of the first-bucket cure."""
    rate = "cure.rate"
    return (
        first_b1_cure(base, d).withColumn("change", F.explode(F.array(*[F.lit(p) for p in points])))
        .select("n", "k", (F.col("change") * 100).alias("points"),
                (F.round(rate, d.digits) + F.col("change")).alias("target_rate"),
                arm_size_absolute(rate, "change", d).alias("n_per_arm")))


def roll_grid(roll: DataFrame, d: Definitions) -> DataFrame:
    """The complete from × to grid with row bases; unobserved cells are kept and marked."""
    cells = roll.where("definition = 'primary'").groupBy("from_state", "to_state").agg(
        F.sum("n_loans").alias("n_loans"), F.sum("exposure_from").alias("exposure_from"))
    grid = densify(cells, {"from_state": d.bucket_labels, "to_state": d.to_states}, ["n_loans", "exposure_from"])
    base = grid.groupBy("from_state").agg(
        F.sum("n_loans").alias("n_base"), F.sum("exposure_from").alias("exposure_base"))
    return grid.join(base, "from_state").withColumn(
        "rate", F.coalesce(share(F.col("n_loans"), F.col("n_base")), F.lit(0.0)))


def roll_pivot(roll: DataFrame, d: Definitions) -> DataFrame:
    """Matrix of rates, one column per target state; NULL where nothing was observed."""
    grid = roll_grid(roll, d).where("observed")
    return grid.groupBy("from_state").pivot("to_state", list(d.to_states)).agg(F.max("rate"))


def roll_column_totals(roll: DataFrame, d: Definitions) -> DataFrame:
    """Bottom line of the matrix: share of every target state, and cure per origin with its pooled row."""
    rows = roll.where("definition = 'primary'")
    total = rows.agg(F.sum("n_loans")).scalar()
    return rows.groupBy("to_state").agg(F.sum("n_loans").alias("n_loans")).withColumn(
        "share", share(F.col("n_loans"), total))


def pooled_cure(roll: DataFrame, d: Definitions) -> DataFrame:
    """Cure per past-due origin and, in the row without origin, pooled over them."""
    current = d.bucket_labels[0]
    return (
        roll.where((F.col("definition") == "primary") & (F.col("from_state") != current))
        .rollup("from_state")
        .agg(F.sum("n_loans").alias("n"),
             F.sum(F.when(F.col("to_state") == current, F.col("n_loans")).otherwise(0)).alias("k"),
             F.sum("exposure_from").alias("exposure"))
        .withColumn("cure", share(F.col("k"), F.col("n"))))
