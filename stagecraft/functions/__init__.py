"""Scalar column functions: text, dates and reporting periods."""

from .dates import (format_date, ist_stamp, parse_dayfirst,  # noqa: F401
                    to_ist)
from .periods import (CRITERIA, period_days, period_end_col, period_label_col,  # noqa: F401
                      period_range, period_start_col)
from .text import (digits_only, is_blank, map_values, non_blank, stage_number,  # noqa: F401
                   stage_sort_number, suffix_if_in)
