"""The tables that queries may name."""

from __future__ import annotations

from collections.abc import Iterable

from .config import TableSpec
from .errors import NotFoundError


class TableRegistry:
    """Tables by name in any case of letters; a table that isn't declared counts as sharded by the default key."""

    def __init__(self, tables: Iterable[TableSpec] = (), default_key: str = "symbol"):
        self._tables = {t.name.lower(): t for t in tables}
        self.default_key = default_key

    def get(self, name: str) -> TableSpec | None:
        return self._tables.get(name.rpartition(".")[2].strip('"`').lower())

    def require(self, name: str) -> TableSpec:
        found = self.get(name)
        if found is None:
            raise NotFoundError(f"table not found: {name}")
        return found

    def add(self, spec: TableSpec) -> None:
        self._tables[spec.name.lower()] = spec

    def names(self) -> list[str]:
        return sorted(t.name for t in self._tables.values())

    def is_sharded(self, name: str) -> bool:
        found = self.get(name)
        return found is None or found.sharded

    def shard_key(self, name: str) -> str:
        found = self.get(name)
        return (found.shard_key if found else None) or self.default_key


def is_system(name: str) -> bool:
    """Whether a name belongs to the catalog's own relations."""
    bare = name.strip('"`').lower()
    return bare.startswith(("information_schema", "_catalog_")) or bare.rpartition(".")[2].startswith("pg_") or bare.startswith("pg_catalog")
