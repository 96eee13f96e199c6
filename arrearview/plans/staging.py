"""Staging: one projection per raw table, with the "no value" codes turned into NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearview.params import Definitions

DAYS_PER_YEAR = 365.25


def _text(name: str, d: Definitions) -> Column:
    return F.nullif(F.col(name), F.lit(d.empty_text))


def _text_or_na(name: str, d: Definitions) -> Column:
    c = F.col(name)
    return F.when(~c.isin(d.empty_text, d.not_applicable_text), c)


def _day(name: str, d: Definitions) -> Column:
    return F.nullif(F.col(name), F.lit(d.empty_day))


def _years(days: Column) -> Column:
    return -days.cast("double") / F.lit(DAYS_PER_YEAR)


def _renamed(df: DataFrame, names: str) -> DataFrame:
    """Projection given as `raw name` or `raw name > new name`, separated by commas."""
    pairs = [[p.strip() for p in item.split(">")] for item in names.split(",")]
    return df.select(*[F.col(p[0]).alias(p[-1]) for p in pairs])


def application(raw: DataFrame, d: Definitions) -> DataFrame:
    return raw.select(
        "sk_id_curr",
        "target",
        F.col("name_contract_type").alias("contract_type"),
        _text("code_gender", d).alias("gender"),
        F.col("cnt_children").alias("children_count"),
        F.col("amt_income_total").alias("income_total"),
        F.col("amt_credit").alias("credit_amount"),
        F.col("amt_annuity").alias("annuity_amount"),
        F.col("amt_goods_price").alias("goods_price"),
        F.col("name_income_type").alias("income_type"),
        F.col("name_education_type").alias("education_type"),
        F.col("name_family_status").alias("family_status"),
        F.col("name_housing_type").alias("housing_type"),
        "occupation_type",
        "region_rating_client",
        _years(F.col("days_birth")).alias("age_years"),
        _years(_day("days_employed", d)).alias("employed_years"),
        "ext_source_1",
        "ext_source_2",
        "ext_source_3",
    )


def previous_application(raw: DataFrame, d: Definitions) -> DataFrame:
    return raw.select(
        "sk_id_prev",
        "sk_id_curr",
        *[_text(f"name_{c}", d).alias(c) for c in ("contract_type", "portfolio", "product_type")],
        "channel_type",
        *[_text(f"name_{c}", d).alias(c) for c in ("client_type", "yield_group")],
        "product_combination",
        *[_text(f"name_{c}", d).alias(c) for c in ("goods_category", "seller_industry")],
        _text_or_na("name_cash_loan_purpose", d).alias("cash_loan_purpose"),
        F.col("name_contract_status").alias("application_status"),
        _text_or_na("code_reject_reason", d).alias("reject_reason"),
        "days_decision",
        F.col("amt_application").alias("application_amount"),
        F.col("amt_credit").alias("credit_amount"),
        F.col("amt_annuity").alias("annuity_amount"),
        F.col("amt_down_payment").alias("down_payment_amount"),
        F.col("amt_goods_price").alias("goods_price"),
        F.col("cnt_payment").alias("tenor_months"),
        *[_day(c, d).alias(c) for c in ("days_first_drawing", "days_first_due", "days_last_due_1st_version",
                                        "days_last_due", "days_termination")],
        (F.col("flag_last_appl_per_contract") == "Y").alias("is_last_appl_per_contract"),
        (F.col("nflag_last_appl_in_day") == 1).alias("is_last_appl_in_day"),
        (F.col("nflag_insured_on_approval") == 1).alias("is_insured"),
    )


def pos_cash_balance(raw: DataFrame, d: Definitions) -> DataFrame:
    return _renamed(raw, "sk_id_prev, sk_id_curr, months_balance, cnt_instalment > installments_total, "
                         "cnt_instalment_future > installments_remaining, name_contract_status > contract_status, "
                         "sk_dpd > dpd_raw, sk_dpd_def > dpd_def")


def credit_card_balance(raw: DataFrame, d: Definitions) -> DataFrame:
    return _renamed(raw, "sk_id_prev, sk_id_curr, months_balance, amt_balance > balance_amount, "
                         "amt_credit_limit_actual > credit_limit, amt_total_receivable > total_receivable, "
                         "amt_inst_min_regularity > min_installment_amount, "
                         "amt_payment_total_current > payment_amount, amt_drawings_current > drawings_amount, "
                         "cnt_drawings_current > drawings_count, "
                         "cnt_instalment_mature_cum > installments_matured_cum, "
                         "name_contract_status > contract_status, sk_dpd > dpd_raw, sk_dpd_def > dpd_def")


def installments_payments(raw: DataFrame, d: Definitions) -> DataFrame:
    return _renamed(raw, "sk_id_prev, sk_id_curr, num_instalment_version > installment_version, "
                         "num_instalment_number > installment_number, days_instalment > days_due, "
                         "days_entry_payment > days_paid, amt_instalment > installment_amount, "
                         "amt_payment > payment_amount").withColumn(
        "days_late", F.col("days_paid") - F.col("days_due"))


STAGING = {
    "application": ("application_train", application),
    "previous_application": ("previous_application", previous_application),
    "pos_cash_balance": ("pos_cash_balance", pos_cash_balance),
    "credit_card_balance": ("credit_card_balance", credit_card_balance),
    "installments_payments": ("installments_payments", installments_payments),
}
