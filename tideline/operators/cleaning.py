"""Cleaning of retail invoice lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names some exports use for the required columns.
COLUMN_ALIASES = {"Invoice": "InvoiceNo", "Price": "UnitPrice"}

# Required columns, in output order.
REQUIRED_COLUMNS = (
    "InvoiceNo",
    "StockCode",
    "Description",
    "Quantity",
    "InvoiceDate",
    "UnitPrice",
    "CustomerID",
    "Country",
)

# Names of the counters.
ROWS_IN = "filas_originales"
NO_CUSTOMER = "filas_sin_customer_id_descartadas"
CANCELLED = "filas_canceladas_descartadas"
NOT_POSITIVE = "filas_cantidad_o_precio_no_positivo_descartadas"
ROWS_OUT = "filas_finales"
ROWS_DROPPED = "total_filas_descartadas"


def normalize_retail_columns(source: DataFrame) -> DataFrame:
    """Required names from the spellings in use; other columns are kept.

    Spaces in names go, so ``Customer ID`` becomes ``CustomerID``. Raises
    ValueError naming the required columns that are missing.
    """
    squeezed = [name.replace(" ", "").strip() for name in source.columns]
    renamed = source.toDF(*[COLUMN_ALIASES.get(name, name) for name in squeezed])
    missing = [name for name in REQUIRED_COLUMNS if name not in renamed.columns]
    if missing:
        raise ValueError(f"required columns missing from the retail source: {missing}")
    return renamed


def _with_numbers(source: DataFrame) -> DataFrame:
    """Normalized lines with numeric columns, NULL (a price or quantity also NaN) where missing.

    Blank text and NaN are the marks of a missing number; other text that is no
    number raises. Columns that are numbers already stay as they are, decimals among them and NaN with
    them, so conditions on them reach the reader; text becomes a double. A customer number given as text or as a fraction becomes a whole
    number of 64 bits by way of a decimal, which keeps all its digits.
    """
    lines = normalize_retail_columns(source)
    types = dict(lines.dtypes)

    def number(name: str) -> Column:
        column = F.col(name)
        if types[name] == "string":
            column = F.nullif(F.trim(column), F.lit(""))
            column = F.when(F.lower(column) != "nan", column)
            return _whole(column.cast("decimal(38,6)")) if name == "CustomerID" else column.cast("double")
        if name == "CustomerID" and types[name] in ("float", "double"):
            return _whole(F.when(~F.isnan(column), column).cast("decimal(38,6)"))
        return column if types[name] in _FRACTIONS or types[name].startswith("decimal") else column.cast("double")

    wanted = ("Quantity", "UnitPrice", "CustomerID")
    changed = {name: number(name) for name in wanted if types[name] not in _WHOLE_TYPES}
    return lines.withColumns(changed)


_WHOLE_TYPES = ("tinyint", "smallint", "int", "bigint")
_FRACTIONS = ("float", "double")


def _not_nan(lines: DataFrame, name: str) -> Column:
    column = F.col(name)
    return F.when(~F.isnan(column), column) if dict(lines.dtypes)[name] in _FRACTIONS else column


def _whole(value: Column) -> Column:
    return value.cast("bigint")


def _not_cancelled() -> Column:
    return ~F.col("InvoiceNo").cast("string").startswith("C")


def _first_failed_rule() -> Column:
    """Name of the first rule a line breaks, NULL for a line to keep.

    A missing quantity or price breaks no rule: only values known to be zero or
    less are noise.
    """
    return (
        F.when(F.col("CustomerID").isNull(), NO_CUSTOMER)
        .when(~_not_cancelled(), CANCELLED)
        .when((F.col("Quantity") <= 0) | (F.col("UnitPrice") <= 0), NOT_POSITIVE)
    )


def _kept(lines: DataFrame) -> Column:
    """True for a line that breaks no rule, as conjuncts that a reader or a join can take one by one.

    Bounds have the column's own type, as a cast column does not reach the reader. NaN is
    larger than any number, so a NaN price or quantity stays, as a missing one does.
    """
    types = dict(lines.dtypes)

    def positive(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) > F.lit(0).cast(types[name]))

    return (
        F.col("CustomerID").isNotNull()
        & (F.col("InvoiceNo").isNull() | _not_cancelled())
        & positive("Quantity")
        & positive("UnitPrice")
    )


def clean_retail(source: DataFrame, date_format: str | None = None) -> DataFrame:
    """Lines of known customers that are neither cancelled nor non-positive.

    Adds ``TotalPrice``. Text dates are read as ISO unless ``date_format`` gives
    a pattern. Text that is no number or date raises, as does a fractional quantity,
    for which the curated table has no type. Customer numbers have 64 bits.
    """
    numbers = _with_numbers(source)
    lines = numbers.filter(_kept(numbers))
    if date_format is None:
        sold_at = F.col("InvoiceDate").cast("timestamp_ntz")
    else:
        sold_at = F.to_timestamp_ntz(F.col("InvoiceDate"), F.lit(date_format))
    quantity, price = _not_nan(lines, "Quantity"), _not_nan(lines, "UnitPrice")
    units = F.when(
        quantity != F.floor(quantity), F.raise_error(F.lit("Quantity is not a whole number"))
    ).otherwise(quantity.cast("int"))
    return lines.withColumns(
        {
            "InvoiceNo": F.col("InvoiceNo").cast("string"),
            "Quantity": units,
            "InvoiceDate": sold_at,
            "CustomerID": F.col("CustomerID").cast("bigint"),
            "UnitPrice": price.cast("double"),
            "TotalPrice": quantity.cast("double") * price.cast("double"),
        }
    )


def clean_retail_stats(source: DataFrame) -> DataFrame:
    """One row of line counts: read, dropped by each rule, kept, dropped in all.

    The rules apply in turn, so a line counts only for the first it breaks. One
    pass: each line is tagged once and the tags are counted.
    """
    tagged = _with_numbers(source).select(_first_failed_rule().alias("rule"))
    counted = tagged.agg(
        F.count("*").alias(ROWS_IN),
        *[F.count_if(F.col("rule") == rule).alias(rule) for rule in (NO_CUSTOMER, CANCELLED, NOT_POSITIVE)],
        F.count_if(F.col("rule").isNull()).alias(ROWS_OUT),
    )
    return counted.withColumn(ROWS_DROPPED, F.col(ROWS_IN) - F.col(ROWS_OUT))
