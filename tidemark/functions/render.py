"""Values as the text that goes back to the operational side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _iso_time(column: Column) -> Column:
    whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(
        F.date_format(column, "SSSSSS") == "000000", whole
    ).otherwise(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def render_row(rows: DataFrame) -> DataFrame:
    """Decimals as plain text, dates and times in ISO form, bytes as UTF-8.

    Bytes that are no UTF-8 become the replacement character. Other columns stay.
    """
    columns = []
    for field in rows.schema.fields:
        kind, column = field.dataType.typeName(), F.col(field.name)
        if kind in ("decimal", "date"):
            column = column.cast("string")
        elif kind == "timestamp_ntz":
            column = _iso_time(column)
        elif kind == "timestamp":
            utc = F.to_utc_timestamp(column, F.current_timezone())
            column = F.concat(_iso_time(utc), F.lit("+00:00"))
        elif kind == "binary":
            column = F.make_valid_utf8(column.cast("string"))
        columns.append(column.alias(field.name))
    return rows.select(*columns)
