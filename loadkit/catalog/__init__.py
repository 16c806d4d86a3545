"""The registered queries (``QUERIES``) and their SQL oracles (``ORACLE``)."""

from loadkit.catalog import load_queries  # noqa: F401  (registers the writing queries)
from loadkit.catalog.queries import ORACLE, QUERIES  # noqa: F401
