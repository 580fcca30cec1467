"""Column functions: every one takes and returns ``Column`` expressions."""

from assayframe.functions.ids import (
    camel_case,
    clean_feature_id,
    clean_sample_id,
    has_digit_and_letter,
    header_levels,
    k_from_run_dir,
    source_prefix,
    split_list,
    strip,
)
from assayframe.functions.numeric import (
    elapsed_seconds,
    f_statistic,
    null_if_nan,
    pearson,
    r_squared,
    ratio_or_zero,
    safe_divide,
)

__all__ = [
    "camel_case",
    "clean_feature_id",
    "clean_sample_id",
    "elapsed_seconds",
    "f_statistic",
    "has_digit_and_letter",
    "header_levels",
    "k_from_run_dir",
    "null_if_nan",
    "pearson",
    "r_squared",
    "ratio_or_zero",
    "safe_divide",
    "source_prefix",
    "split_list",
    "strip",
]
