from tabcascade.functions.scalars import (
    binary_label,
    ceil_quotient,
    code_label,
    decode_label,
    draw_number,
    half_even,
    nan_to_null,
    order_code,
    quotient,
    seeded_code,
    shift_label,
    tokens_to_null,
)

__all__ = [
    "binary_label",
    "ceil_quotient",
    "code_label",
    "decode_label",
    "draw_number",
    "half_even",
    "nan_to_null",
    "order_code",
    "quotient",
    "seeded_code",
    "shift_label",
    "tokens_to_null",
]
