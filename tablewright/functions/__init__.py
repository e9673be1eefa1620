"""Column expressions: pure functions of columns that stay inside code generation."""

from tablewright.functions.scalar import (
    divide,
    double_array,
    is_missing,
    normal_quantile,
    parse_number,
    ref,
    round_to,
    text_of,
    yeo_johnson,
)

__all__ = ["divide", "double_array", "is_missing", "normal_quantile", "parse_number", "ref", "round_to", "text_of", "yeo_johnson"]
