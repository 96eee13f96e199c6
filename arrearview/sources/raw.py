"""The five raw lending tables: declared schemas, file readers, load audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"L": T.LongType(), "I": T.IntegerType(), "D": T.DoubleType(), "S": T.StringType()}

# Columns of the raw files in file order, with L bigint, I int, D double, S string.
RAW_COLUMNS = {
    "application_train": (
        "sk_id_curr L, target I, name_contract_type S, code_gender S, cnt_children L, amt_income_total D, "
        "amt_credit D, amt_annuity D, amt_goods_price D, name_income_type S, name_education_type S, "
        "name_family_status S, name_housing_type S, occupation_type S, region_rating_client L, days_birth L, "
        "days_employed L, ext_source_1 D, ext_source_2 D, ext_source_3 D"
    ),
    "previous_application": (
        "sk_id_prev L, sk_id_curr L, name_contract_type S, name_portfolio S, name_product_type S, "
        "channel_type S, name_client_type S, name_yield_group S, product_combination S, "
        "name_goods_category S, name_seller_industry S, name_cash_loan_purpose S, name_contract_status S, "
        "code_reject_reason S, days_decision I, amt_application D, amt_credit D, amt_annuity D, "
        "amt_down_payment D, amt_goods_price D, cnt_payment I, days_first_drawing I, days_first_due I, "
        "days_last_due_1st_version I, days_last_due I, days_termination I, flag_last_appl_per_contract S, "
        "nflag_last_appl_in_day I, nflag_insured_on_approval I"
    ),
    "pos_cash_balance": (
        "sk_id_prev L, sk_id_curr L, months_balance I, cnt_instalment D, cnt_instalment_future D, "
        "name_contract_status S, sk_dpd L, sk_dpd_def L"
    ),
    "credit_card_balance": (
        "sk_id_prev L, sk_id_curr L, months_balance I, amt_balance D, amt_credit_limit_actual D, "
        "amt_total_receivable D, amt_inst_min_regularity D, amt_payment_total_current D, "
        "amt_drawings_current D, cnt_drawings_current L, cnt_instalment_mature_cum I, "
        "name_contract_status S, sk_dpd L, sk_dpd_def L"
    ),
    "installments_payments": (
        "sk_id_prev L, sk_id_curr L, num_instalment_version I, num_instalment_number I, days_instalment I, "
        "days_entry_payment I, amt_instalment D, amt_payment D"
    ),
}
RAW_TABLES = tuple(RAW_COLUMNS)

# Names of the published CSV files.
CSV_FILES = {
    "application_train": "application_train.csv",
    "previous_application": "previous_application.csv",
    "pos_cash_balance": "POS_CASH_balance.csv",
    "credit_card_balance": "credit_card_balance.csv",
    "installments_payments": "installments_payments.csv",
}


class MissingInput(FileNotFoundError):
    """One or more raw inputs are absent."""


def schema(table: str) -> T.StructType:
    fields = (item.split() for item in RAW_COLUMNS[table].split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def require(spark: SparkSession, paths: dict[str, str]) -> None:
    """Stop before any job starts when an input is absent, naming every absent one."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def exists(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(conf).globStatus(p)
        return found is not None and len(found) > 0

    absent = [f"{name} ({path})" for name, path in paths.items() if not exists(path)]
    if absent:
        raise MissingInput("missing raw input: " + ", ".join(absent))


def whole(name: str, kind: T.DataType) -> Column:
    """Text of a whole number as that number; a fraction other than zeros stops the load."""
    text = F.trim(F.col(name))
    exact = text.cast("decimal(38,10)")
    fits = (exact == F.floor(exact)) & (text.cast("double") == F.floor(text.cast("double")))
    wrong = F.raise_error(F.concat(F.lit(f"{name} is not a whole number: "), F.col(name))).cast(kind)
    return F.when(fits, exact.cast("decimal(28,0)").cast(kind)).when(text.isNotNull(), wrong).alias(name)


def read_csv(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """CSV files with a header, typed by the declared schemas.

    Columns are matched to the header by name and in any case: the header line is read first, so a
    file may hold more columns than the loan book uses. Whole numbers may be written with decimals
    (`12.0`), as files exported from float columns do. Anything that does not parse, a whole number
    with a fraction included, stops the load.
    """
    require(spark, paths)
    out = {}
    for table, path in paths.items():
        declared = {f.name: f.dataType for f in schema(table)}
        header = spark.read.option("header", True).csv(path).schema.names
        as_text = {n for n, t in declared.items() if isinstance(t, T.IntegralType)}
        file_schema = T.StructType([
            T.StructField(h, T.StringType() if h.lower() in as_text else declared.get(h.lower(), T.StringType()))
            for h in header])
        lost = sorted(set(declared) - {h.lower() for h in header})
        if lost:
            raise MissingInput(f"{table}: column(s) not in the file: {', '.join(lost)}")
        df = (spark.read.schema(file_schema).option("header", True).option("encoding", "UTF-8")
              .option("mode", "FAILFAST").csv(path))
        out[table] = lower_names(df).select(*[
            whole(n, t) if n in as_text else F.col(n)
            for n, t in declared.items()])
    return out


def read_parquet(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    require(spark, paths)
    return {t: lower_names(spark.read.parquet(p)).select(*schema(t).names) for t, p in paths.items()}


def csv_folder(folder: str) -> dict[str, str]:
    return {t: f"{folder.rstrip('/')}/{name}" for t, name in CSV_FILES.items()}


def load_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and a key checksum of every loaded table."""
    def one(name: str, df: DataFrame) -> DataFrame:
        return df.agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("n_rows"),
            F.lit(len(df.columns)).cast("long").alias("n_columns"),
            F.sum(F.col(df.columns[0]) % 1000003).alias("key_checksum"),
        )

    return reduce(DataFrame.unionByName, [one(n, df) for n, df in tables.items()])
