from loadkit.sources.readers import (  # noqa: F401
    CORRUPT, corrupt_rule, fixed_width_length_rule, incremental_extract, jdbc_options,
    read_delimited, read_fixed_width, read_jdbc, read_table, string_schema,
)
