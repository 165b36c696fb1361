"""The catalog: a named set of lazily built DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Union

from pyspark.sql import DataFrame

Table = Union[DataFrame, Callable[[], DataFrame]]


class Catalog:
    """Tables by name, read as attributes (``catalog.dataset``).

    A table may be given as a DataFrame or as a function returning one; a
    function is called at the first use, so a query only plans what it reads.
    """

    def __init__(self, **tables: Table):
        self._tables = dict(tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def table(self, name: str) -> DataFrame:
        try:
            found = self._tables[name]
        except KeyError:
            raise AttributeError(f"the catalog has no table {name!r}") from None
        if not isinstance(found, DataFrame):
            found = self._tables[name] = found()
        return found

    def replace(self, **tables: Table) -> "Catalog":
        """A catalog in which the given tables take the place of the old ones."""
        return Catalog(**{**self._tables, **tables})
