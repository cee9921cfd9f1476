"""Calendar labels: YEAR, MONTH, DATENAME(month), 'Q' + DATENAME(quarter)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_of(d="TradeDate") -> Column:
    return F.year(d).cast("int")


def month_of(d="TradeDate") -> Column:
    return F.month(d).cast("int")


def quarter_of(d="TradeDate") -> Column:
    return F.quarter(d).cast("int")


def month_name(d="TradeDate") -> Column:
    """Full English month name, as DATENAME(month, d)."""
    return F.date_format(d, "MMMM")


def quarter_label(d="TradeDate") -> Column:
    """'Q1'..'Q4', as 'Q' + DATENAME(quarter, d)."""
    return F.concat(F.lit("Q"), F.quarter(d).cast("string"))
