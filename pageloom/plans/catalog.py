"""All registered queries."""

from pageloom.plans import (  # noqa: F401
    catalog_articles,
    catalog_discovery,
    catalog_enrich,
    catalog_streams,
    catalog_tables,
    catalog_urls,
)
from pageloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
