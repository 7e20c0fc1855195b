from cohortlens.functions.expressions import (
    age,
    json_fields,
    json_steps,
    ks_p_value,
    literal,
    number,
    per_cohort,
    percent,
    present,
    quoted,
    standard_error,
    t_quantile,
    to_number,
    variance_explained,
    whole_number,
)

__all__ = [
    "age",
    "json_fields",
    "json_steps",
    "ks_p_value",
    "literal",
    "number",
    "per_cohort",
    "percent",
    "present",
    "quoted",
    "standard_error",
    "t_quantile",
    "to_number",
    "variance_explained",
    "whole_number",
]
