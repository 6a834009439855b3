from lamina.functions.dates import parse_date, run_timestamp, whole_years
from lamina.functions.numbers import exact_avg, salary_band
from lamina.functions.text import clean_lower, clean_upper, full_name, initcap_words

__all__ = [
    "clean_lower",
    "clean_upper",
    "exact_avg",
    "full_name",
    "initcap_words",
    "parse_date",
    "run_timestamp",
    "salary_band",
    "whole_years",
]
