"""All registered queries: name -> (Spark query, DuckDB oracle SQL or None)."""

from __future__ import annotations

from . import (catalog_analytics, catalog_data, catalog_features, catalog_indicators,
               catalog_kernels, catalog_streaming)


def full_catalog() -> dict:
    cat = {}
    for section in (catalog_indicators, catalog_kernels, catalog_data, catalog_features,
                    catalog_analytics, catalog_streaming):
        cat.update(section.catalog())
    return cat
