from loadkit.sinks.tables import (  # noqa: F401
    append, publish_version, tag_error_rows, write_error_rows, write_jdbc, write_split,
)
