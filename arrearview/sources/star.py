"""Lending tables derived from a star schema: one contract per order.

Integer arithmetic on `orders` and `customer` only, row by row, so the derived tables grow with
their source and need no shuffle. FIXTURES.md holds the specification.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrearview.sources.raw import schema


def _typed(df: DataFrame, table: str) -> DataFrame:
    """Columns of the declared schema, in its order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema(table)])


def _pick(number: str, *choices: str, otherwise: str) -> str:
    whens = " ".join(f"when {i} then {c}" for i, c in enumerate(choices) if c is not None)
    return f"case {number} {whens} else {otherwise} end"


def contracts(orders: DataFrame) -> DataFrame:
    k = F.col("k")
    first = (F.lit(-96) + (k * 37) % 94).cast("int")
    return (
        orders.select(
            F.col("o_orderkey").alias("k"),
            F.col("o_custkey").alias("cust"),
            F.floor("o_totalprice").cast("long").alias("amt"),
        )
        .withColumn("first_m", first)
        .withColumn("nat_end", (F.col("first_m") + 2 + (k * 11) % 40).cast("int"))
        .withColumn("last_m", F.least(F.lit(-1), F.col("nat_end")))
        .withColumn("tenor", (6 + 6 * (F.expr("k div 7") % 6)).cast("int"))
        .withColumn(
            "product",
            F.when(k % 10 == 8, "Revolving loans")
            .when((k % 10).isin(6, 7), "Cash loans")
            .when(k % 100 == 99, "XNA")
            .otherwise("Consumer loans"),
        )
    )


def application_train(customer: DataFrame) -> DataFrame:
    c = customer.select(F.col("c_custkey").alias("c"), F.col("c_mktsegment").alias("segment"))
    return _typed(c.selectExpr(
        "c as sk_id_curr",
        "if(c % 12 = 0, 1, 0) as target",
        "if(c % 9 = 0, 'Revolving loans', 'Cash loans') as name_contract_type",
        _pick("c % 7", "'XNA'", "'M'", "'M'", "'M'", otherwise="'F'") + " as code_gender",
        "c % 4 as cnt_children",
        "20000 + (c * 731) % 180000 as amt_income_total",
        "50000 + (c * 577) % 400000 as amt_credit",
        "2000 + (c * 91) % 20000 as amt_annuity",
        "45000 + (c * 577) % 400000 as amt_goods_price",
        "segment as name_income_type",
        _pick("c % 3", "'Secondary'", "'Higher'", otherwise="'Lower'") + " as name_education_type",
        "if(c % 2 = 0, 'Married', 'Single') as name_family_status",
        "if(c % 5 = 0, 'Rented', 'House') as name_housing_type",
        "if(c % 6 = 0, null, 'Laborers') as occupation_type",
        "1 + c % 3 as region_rating_client",
        "-(7000 + (c * 97) % 18000) as days_birth",
        "if(c % 6 = 0, 365243, -((c * 53) % 9000)) as days_employed",
        "if(c % 3 = 0, null, cast((c * 31) % 1000 as double) / 1000.0D) as ext_source_1",
        "cast((c * 17) % 1000 as double) / 1000.0D as ext_source_2",
        "cast((c * 7) % 1000 as double) / 1000.0D as ext_source_3",
    ), "application_train")


def previous_application(book: DataFrame) -> DataFrame:
    channels = ("'Country-wide'", "'Country-wide'", "'Stone'", "'Regional / Local'",
                "'Credit and cash offices'", "'Contact center'", "'AP+ (Cash loan)'", "'Car dealer'")
    return _typed(book.where("k % 21 <> 4").selectExpr(
        "k as sk_id_prev",
        "cust as sk_id_curr",
        "product as name_contract_type",
        "case product when 'Revolving loans' then 'Cards' when 'Cash loans' then 'Cash' "
        "when 'XNA' then 'XNA' else 'POS' end as name_portfolio",
        _pick("k % 3", "'XNA'", "'x-sell'", otherwise="'walk-in'") + " as name_product_type",
        _pick("(k div 10) % 9", *channels, otherwise="'Channel of corporate sales'") + " as channel_type",
        _pick("(k div 3) % 4", "'New'", "'Repeater'", "'Refreshed'", otherwise="'XNA'") + " as name_client_type",
        _pick("(k div 7) % 5", "'high'", "'middle'", "'low_normal'", "'low_action'", otherwise="'XNA'")
        + " as name_yield_group",
        _pick("k % 4", "'POS household'", "'Cash'", "'Card Street'", otherwise="'POS mobile'")
        + " as product_combination",
        "if(k % 5 = 0, 'XNA', 'Mobile') as name_goods_category",
        "if(k % 6 = 0, 'XNA', 'Consumer electronics') as name_seller_industry",
        _pick("k % 8", "'XNA'", "'XAP'", otherwise="'Repairs'") + " as name_cash_loan_purpose",
        "case when k % 13 < 9 then 'Approved' when k % 13 < 11 then 'Refused' "
        "when k % 13 = 11 then 'Canceled' else 'Unused offer' end as name_contract_status",
        "case when k % 13 not in (9, 10) then 'XAP' when k % 2 = 0 then 'HC' else 'XNA' end as code_reject_reason",
        "30 * first_m - 15 as days_decision",
        "amt + 1000 as amt_application",
        "amt as amt_credit",
        "floor(amt / tenor) as amt_annuity",
        "amt div 10 as amt_down_payment",
        "amt as amt_goods_price",
        "if(k % 50 = 1, null, tenor) as cnt_payment",
        "365243 as days_first_drawing",
        "if(k % 17 = 3, 365243, 30 * first_m) as days_first_due",
        "30 * (first_m + tenor) as days_last_due_1st_version",
        "if(k % 3 = 1, 365243, 30 * last_m) as days_last_due",
        _pick("k % 3", "30 * last_m + 20", "365243", otherwise="null") + " as days_termination",
        "if(k % 97 = 0, 'N', 'Y') as flag_last_appl_per_contract",
        "if(k % 89 = 0, 0, 1) as nflag_last_appl_in_day",
        "if(k % 4 = 0, 1, 0) as nflag_insured_on_approval",
    ), "previous_application")


def panel(book: DataFrame) -> DataFrame:
    """One row per contract and observed month; i counts months since the first row."""
    months = book.withColumn("m", F.explode(F.sequence("first_m", "last_m")))
    return (
        months.withColumn("i", F.expr("m - first_m"))
        .where("not (k % 53 = 0 and i = 2)")
        .withColumn("late", F.expr("i - (k * 13) % 20"))
        .withColumn("st", F.expr(
            "case when k % 211 = 0 or (k % 29 = 0 and i = 0) then 'Signed' "
            "when m = nat_end and k % 31 = 0 then 'Returned to the store' "
            "when m = nat_end and k % 4 <> 0 then 'Completed' "
            "when k % 101 = 0 then 'Demand' when k % 103 = 0 then 'Amortized debt' else 'Active' end"))
        .withColumn("dpd_def", F.expr(
            "if(k % 7 in (0, 3) and late between 0 and (k div 7) % 7, 1 + k % 29 + 30 * late, 0)"))
        .withColumn("rem", F.expr("greatest(tenor - i - if(k % 23 = 0, 1, 0), 0)"))
        .withColumn("dpd_raw", F.expr("dpd_def + if(rem = 0, k % 70, 0)"))
    )


def pos_cash_balance(rows: DataFrame) -> DataFrame:
    def shaped(df: DataFrame, raw: str, tolerant: str) -> DataFrame:
        return df.selectExpr(
            "k as sk_id_prev", "cust as sk_id_curr", "m as months_balance", "tenor as cnt_instalment",
            "rem as cnt_instalment_future", "st as name_contract_status",
            f"{raw} as sk_dpd", f"{tolerant} as sk_dpd_def")

    loans = rows.where("product <> 'Revolving loans'")
    return _typed(
        shaped(loans, "dpd_raw", "dpd_def")
        .unionByName(shaped(loans.where("k % 61 = 0 and i = 1"), "dpd_raw + 5", "dpd_def + 5"))
        .unionByName(shaped(rows.where("product = 'Revolving loans' and k % 67 = 0"),
                            "cast(0 as bigint)", "cast(0 as bigint)")),
        "pos_cash_balance")


def credit_card_balance(rows: DataFrame) -> DataFrame:
    return _typed(rows.where("product = 'Revolving loans'").selectExpr(
        "k as sk_id_prev", "cust as sk_id_curr", "m as months_balance",
        "(amt * (i + 1)) % 90000 - 500 as amt_balance",
        "90000 as amt_credit_limit_actual",
        "(amt * (i + 1)) % 90000 as amt_total_receivable",
        "500 as amt_inst_min_regularity",
        "(k * (i + 1)) % 4000 as amt_payment_total_current",
        "(k * (i + 2)) % 6000 as amt_drawings_current",
        "(k + i) % 5 as cnt_drawings_current",
        "i as cnt_instalment_mature_cum",
        "st as name_contract_status",
        "dpd_def + if(i > 20, k % 70, 0) as sk_dpd",
        "dpd_def as sk_dpd_def"), "credit_card_balance")


def installments_payments(book: DataFrame) -> DataFrame:
    scheduled = book.where("k % 17 <> 3")
    parts = (
        scheduled.where("product <> 'Revolving loans'")
        .withColumn("n", F.explode(F.expr("array(1, 2, 3)")))
        .withColumn("vp", F.explode(F.expr("array(named_struct('v', 1, 'part', 1), "
                                           "named_struct('v', 1, 'part', 2), named_struct('v', 2, 'part', 1))")))
        .selectExpr("*", "vp.v as v", "vp.part as part", "30 * first_m + 30 * (n - 1) as due")
        .where("v = 1 or k % 6 = 0")
        .withColumn("skipped", F.expr("k % 37 = 5 and part = 2"))
    )
    loans = parts.selectExpr(
        "k as sk_id_prev", "cust as sk_id_curr", "v as num_instalment_version", "n as num_instalment_number",
        "due as days_instalment",
        "if(skipped, null, due + if(k % 19 = 2, 35, k % 12 - 6)) as days_entry_payment",
        "floor(amt / tenor) as amt_instalment",
        "if(skipped, null, if(k % 41 = 7, floor(amt / tenor / 4), floor(amt / tenor / 2) + 1)) as amt_payment")
    cards = scheduled.where("product = 'Revolving loans' and k % 2 = 0").selectExpr(
        "k as sk_id_prev", "cust as sk_id_curr", "0 as num_instalment_version", "1 as num_instalment_number",
        "30 * first_m as days_instalment", "30 * first_m - 1 as days_entry_payment",
        "500 as amt_instalment", "500 as amt_payment")
    return _typed(loans, "installments_payments").unionByName(_typed(cards, "installments_payments"))


# Each order becomes some 20 months: 2 million rows for a task to expand.
ORDERS_PER_TASK = 100_000


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows about to be expanded over all partitions: they are narrow and few, their months are not."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // ORDERS_PER_TASK)))


def lending_tables(spark: SparkSession, star_dir: str) -> dict[str, DataFrame]:
    orders = spark.read.parquet(f"{star_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    book = contracts(spread(orders))
    rows = panel(book)
    return {
        "application_train": application_train(spark.read.parquet(f"{star_dir}/customer.parquet")),
        "previous_application": previous_application(book),
        "pos_cash_balance": pos_cash_balance(rows),
        "credit_card_balance": credit_card_balance(rows),
        "installments_payments": installments_payments(book),
    }
