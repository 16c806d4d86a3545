from loadkit.functions.columns import (  # noqa: F401
    CLOSED,
    CURRENT,
    OPEN_END_DATE,
    any_changed,
    date_key,
    date_literal,
    failed_names,
    file_name,
    is_true,
    ts_literal,
)
