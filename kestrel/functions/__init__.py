"""Column expressions used by sources and operators."""

from kestrel.functions.linalg import decision, dot, huber_sign
from kestrel.functions.parse import (
    label_pm1, parse_once, parse_point_fields, parse_rating_fields, parse_ratings,
    parse_tuple_point, trim_controls, with_bias)

__all__ = [
    "decision", "dot", "huber_sign", "label_pm1", "parse_once", "parse_point_fields",
    "parse_rating_fields", "parse_ratings", "parse_tuple_point", "trim_controls", "with_bias",
]
