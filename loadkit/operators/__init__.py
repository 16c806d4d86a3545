from loadkit.operators.checks import (  # noqa: F401
    duplicate_check, null_check, ref_integrity_check, schema_check,
)
from loadkit.operators.lookups import (  # noqa: F401
    DuplicateLookupKey, assert_unique, fits_broadcast, lookup, lookup_current, lookup_labelled,
    merge_join, multi_lookup, rows_at_most,
)
from loadkit.operators.routing import (  # noqa: F401
    ErrorLimitExceeded, conditional_split, enforce_error_limit, error_limit_status,
    label_split, route_errors, tag_errors,
)
from loadkit.operators.scd import change_detection, scd1_merge, scd2_merge  # noqa: F401
from loadkit.operators.transforms import (  # noqa: F401
    add_date_key, assign_surrogate_keys, deduplicate, derived_columns, drop_raw_columns,
    lineage_columns, null_defaults, type_conversions, union_all,
)
