"""Column builders for the vocabulary of the loan book: buckets, segments, cohorts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arrearview.params import Definitions


def is_open(status: Column, d: Definitions) -> Column:
    return status.isin(*d.open_statuses)


def bucket_order(dpd: Column, d: Definitions) -> Column:
    """0 for exactly no delay, then one step per edge; NULL stays NULL."""
    out = F.when(dpd.isNull(), F.lit(None).cast("int")).when(dpd == d.bucket_edges[0], 0)
    for step, edge in enumerate(d.bucket_edges[1:], start=1):
        out = out.when(dpd <= edge, step)
    return out.otherwise(len(d.bucket_edges))


def nth(order: Column, names: tuple[str, ...]) -> Column:
    """The name at a position counted from 0, NULL for NULL.

    A CASE chain, as element_at does not carry the NULL of its index under ANSI mode.
    """
    out = F.when(order == 0, names[0])
    for i, name in enumerate(names[1:], start=1):
        out = out.when(order == i, name)
    return out


def bucket_label(order: Column, d: Definitions) -> Column:
    return nth(order, d.bucket_labels)


def debt_group(dpd: Column, d: Definitions) -> Column:
    out = F.when(dpd.isNull(), F.lit(None).cast("int"))
    for group, edge in enumerate(d.debt_group_edges, start=1):
        out = out.when(dpd <= edge, group)
    return out.otherwise(len(d.debt_group_edges) + 1)


def state_order(state: Column, d: Definitions) -> Column:
    """Position of a transition state in the reporting order."""
    return F.array_position(F.array(*[F.lit(x) for x in d.to_states]), state).cast("int") - 1


def attribute_label(value: Column, d: Definitions, has_application: Column | None = None) -> Column:
    named = F.coalesce(value, F.lit(d.missing))
    if has_application is None:
        return named
    return F.when(has_application, named).otherwise(d.no_application)


def channel_label(value: Column, d: Definitions, has_application: Column | None = None) -> Column:
    grouped = F.when(value.isin(*d.small_channels), d.small_channel_group).otherwise(value)
    return attribute_label(grouped, d, has_application)


def segment_columns(d: Definitions, has_application: Column | None = None,
                    names=("contract_type", "channel_type", "client_type", "yield_group")) -> list[Column]:
    """The reported segment columns, labelled in the one way every mart shares."""
    def one(name: str) -> Column:
        build = channel_label if name == "channel_type" else attribute_label
        return build(F.col(name), d, has_application).alias(name)

    return [one(n) for n in names]


def tenor_group(d: Definitions) -> Column:
    tenor = F.col("tenor_months")
    return (
        F.when(~F.col("has_application"), d.no_application)
        .when(F.col("source") == d.card_source, "Revolving")
        .when(tenor.isNull(), d.missing)
        .when(tenor <= 12, "<=12m")
        .when(tenor <= 24, "13-24m")
        .otherwise(">24m")
    )


def cohort_start(month: Column, d: Definitions, width: int | None = None) -> Column:
    w = width or d.cohort_width
    return (F.lit(d.window_start) + w * F.floor((month - d.window_start) / w)).cast("int")


def cohort_label(start: Column, d: Definitions, width: int | None = None) -> Column:
    w = width or d.cohort_width
    return F.concat(start.cast("string"), F.lit(d.cohort_separator), (start + (w - 1)).cast("string"))


def is_labelled_product(d: Definitions) -> Column:
    return ~F.col("contract_type").isin(d.no_application, d.missing)


def outcome_known(mob: Column, d: Definitions) -> Column:
    """The outcome at age `mob` is known: seen that long, or the contract has ended."""
    return (F.col("max_mob") >= mob) | F.col("end_state").isin(*d.closed_end_states)
