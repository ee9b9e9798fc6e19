from offerscore.functions.exprs import (  # noqa: F401
    NULL_TOKENS,
    TEXT_COLUMNS,
    flag,
    nan_to_null,
    parse_number,
    r6,
    safe_div,
)
