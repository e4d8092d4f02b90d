"""Metadata predicates of a search."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchFilter:
    """All set conditions must hold; within a list one is enough."""

    file_types: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    tags: dict[str, str] = field(default_factory=dict)
    collection: str = ""
    path_prefix: str = ""

    @property
    def is_set(self) -> bool:
        return bool(self.file_types or self.languages or self.tags or self.collection or self.path_prefix)

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.file_types:
            out &= F.col("file_type").isin(*self.file_types)
        if self.languages:
            out &= F.col("language").isin(*self.languages)
        for k, v in self.tags.items():
            out &= F.col("tags")[k] == v
        if self.collection:
            out &= F.col("collection") == self.collection
        if self.path_prefix:
            out &= F.lower("path").startswith(self.path_prefix.lower())
        return out
