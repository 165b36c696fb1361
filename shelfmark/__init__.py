"""shelfmark: search, facets, integrity and collections over a catalog of datasets, on Spark."""

from shelfmark.catalog import Catalog

__all__ = ["Catalog"]
