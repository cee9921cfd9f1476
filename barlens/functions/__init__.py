"""Column-level helpers: the numeric contract and calendar labels."""

from barlens.functions.numeric import (exact_avg, int_avg, pct_change,
                                       safe_div, to_double)
from barlens.functions.dates import month_name, quarter_label, year_of, month_of, quarter_of

__all__ = ["exact_avg", "int_avg", "pct_change", "safe_div",
           "to_double", "month_name", "quarter_label", "year_of", "month_of", "quarter_of"]
