"""The loan book: raw tables in, every layer out, each table built at most once."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from arrearview.params import Definitions
from arrearview.plans import cohorts, core, marts, report
from arrearview.plans.staging import STAGING
from arrearview.sources.store import LazyStore, TableStore


MARTS = ("funnel_by_channel", "fpd_by_segment", "vintage", "roll_rate", "roll_rate_no_threshold", "portfolio_snapshot")


class LoanBook:
    """Ordered build of the layers; dependencies are the attributes a table reads.

    With a TableStore each table is written when it is first needed and read back afterwards. The monthly fact and the
    outcomes are written when they are asked for themselves, as `build` does; a table on them reads what is written, or
    else their plans over the panel and the dimension. With the default LazyStore the book is one lazy plan.
    """

    def __init__(self, spark: SparkSession, raw: dict[str, DataFrame], definitions: Definitions | None = None,
                 store: LazyStore | TableStore | None = None):
        self.spark = spark
        self.raw = raw
        self.d = definitions or Definitions()
        self.store = store or LazyStore()
        self._stg: dict[str, DataFrame] = {}

    def stg(self, name: str) -> DataFrame:
        """A staging projection: narrow, so it is never written on its own."""
        if name not in self._stg:
            source, project = STAGING[name]
            self._stg[name] = project(self.raw[source], self.d)
        return self._stg[name]

    @property
    def _panels(self) -> tuple[DataFrame, DataFrame]:
        return self.stg("credit_card_balance"), self.stg("pos_cash_balance")

    @cached_property
    def _crowded(self) -> DataFrame | None:
        """Contracts whose copies shrink before they move, looked for once before the panels are written."""
        if self.store.published is not None or not self.store.buckets:
            return None
        crowded = core.crowded_contracts(*self._panels)
        return crowded.limit(0) if crowded.isEmpty() else crowded

    @cached_property
    def int_loan_month(self) -> DataFrame:
        self.store.fit(*self._panels)
        panel = core.int_loan_month(*self._panels, self.d, self.store.buckets, self._crowded)
        return self.store.keep("core", "int_loan_month", panel, by_contract=True)

    @cached_property
    def source_months(self) -> DataFrame:
        """Rows of each raw panel per contract and month, which the checks of the sources read."""
        alone = self._crowded is not None and self._crowded.isEmpty()
        months = core.source_months(*self._panels, self.store.buckets if alone else None)
        return self.store.keep("core", "source_months", months, by_contract=True)

    @cached_property
    def dim_loan(self) -> DataFrame:
        dim = core.dim_loan(self.int_loan_month, self.stg("previous_application"), self.d, self.store.buckets)
        return self.store.keep("core", "dim_loan", dim, by_contract=True)

    def _written(self, name: str) -> bool:
        return name in self.__dict__ or self.store.published is not None

    def _fact(self) -> DataFrame:
        """The monthly fact to build on. It takes no exchange over the panel and is wide, so it is planned again rather
        than written on the way."""
        if self._written("fct_loan_month"):
            return self.fct_loan_month
        return core.fct_loan_month(self.int_loan_month, self.dim_loan, self.d)

    def _outcome(self) -> DataFrame:
        """The outcomes to build on, in the same way."""
        if self._written("loan_outcome"):
            return self.loan_outcome
        return core.loan_outcome(self._fact(), self.dim_loan, self.d)

    @cached_property
    def fct_loan_month(self) -> DataFrame:
        fact = core.fct_loan_month(self.int_loan_month, self.dim_loan, self.d)
        return self.store.keep("core", "fct_loan_month", fact, by_contract=True)

    @cached_property
    def loan_outcome(self) -> DataFrame:
        outcome = core.loan_outcome(self._fact(), self.dim_loan, self.d)
        return self.store.keep("core", "loan_outcome", outcome, by_contract=True)

    @cached_property
    def open_months(self) -> DataFrame:
        """Open contract-months, in one partition per month."""
        months = core.open_months(self._fact(), self._outcome(), self.d)
        return self.store.keep("core", "open_months", months, by="months_balance")

    @cached_property
    def cohort_cells(self) -> DataFrame:
        return self.store.keep("mart", "cohort_cells", cohorts.cohort_cells(self._outcome(), self.d))

    @cached_property
    def application_amounts(self) -> DataFrame:
        """Applications by segment, status and amount: one scan of them for the whole funnel."""
        return self.store.keep("core", "application_amounts",
                               marts.application_amounts(self.stg("previous_application"), self.d))

    @cached_property
    def funnel_by_channel(self) -> DataFrame:
        funnel = marts.funnel_by_channel(self.application_amounts, self.store.step("core"))
        return self.store.keep("mart", "funnel_by_channel", funnel)

    @cached_property
    def fpd_by_segment(self) -> DataFrame:
        return self.store.keep("mart", "fpd_by_segment", marts.fpd_by_segment(
            self.stg("installments_payments"), self.stg("previous_application"), self.d))

    @cached_property
    def vintage(self) -> DataFrame:
        return self.store.keep("mart", "vintage", marts.vintage(self._outcome(), self.d))

    @cached_property
    def transition_base(self) -> DataFrame:
        """Additive cells of successive months; the matrices and cures are sums over them."""
        return self.store.keep("mart", "transition_base",
                               marts.transition_base(self._fact(), self.dim_loan, self.d))

    @cached_property
    def roll(self) -> DataFrame:
        """Transition matrix of both delay definitions."""
        return self.store.keep("mart", "roll", marts.roll_matrix(self.transition_base, self.d))

    @property
    def roll_rate(self) -> DataFrame:
        return marts.of_definition(self.roll, "primary")

    @property
    def roll_rate_no_threshold(self) -> DataFrame:
        return marts.of_definition(self.roll, "no_threshold")

    @cached_property
    def portfolio_snapshot(self) -> DataFrame:
        return self.store.keep("mart", "portfolio_snapshot",
                               marts.portfolio_snapshot(self.open_months, self.d))

    @property
    def marts(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in MARTS}

    def _dimension(self, column: str, name: str) -> DataFrame:
        keyed = [self.funnel_by_channel, self.fpd_by_segment, self.vintage, self.roll_rate, self.portfolio_snapshot]
        return self.store.keep("mart", f"dim_{name}", report.conformed_dimension(keyed, column, name))

    @cached_property
    def dim_channel(self) -> DataFrame:
        """Sales channels of all marts."""
        return self._dimension("channel_type", "channel")

    @cached_property
    def dim_product(self) -> DataFrame:
        """Products of all marts."""
        return self._dimension("contract_type", "product")

    def build(self, progress: Callable[[str], None] | None = None) -> dict[str, DataFrame]:
        """All core and mart tables in dependency order."""
        out = {}
        for name in ("int_loan_month", "dim_loan", "fct_loan_month", "loan_outcome", "open_months"):
            out[name] = getattr(self, name)
            if progress:
                progress(name)
        for name in MARTS:
            out[name] = getattr(self, name)
            if progress:
                progress(name)
        return out
