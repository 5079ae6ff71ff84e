"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from custlytics.functions.dates import day, month_key, month_label, days_between  # noqa: F401
from custlytics.functions.money import cents, total_units, int_div, half_up_div, from_cents, from_micros  # noqa: F401
from custlytics.functions.binning import band, fixed_bin  # noqa: F401
