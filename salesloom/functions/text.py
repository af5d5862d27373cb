"""Presentation: ids, formatted figures, JSON rows, ISO dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identifier formats.
CUSTOMER_ID = "CUST_%06d"
PRODUCT_ID = "PROD_%06d"
ORDER_ID = "ORDER_%08d"
ITEM_ID = "ITEM_%08d"


def padded_id(fmt: str, number: Column | str) -> Column:
    return F.format_string(fmt, number)


def money_text(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


def percent_text(c: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(c, digits), F.lit("%"))


def count_text(c: Column) -> Column:
    return F.format_number(c, 0)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row in column ``json``."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def present(df: DataFrame) -> DataFrame:
    """Rows as a consumer gets them: ISO text for dates and times, doubles for decimals."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(field.name))
    return df.select(out)
