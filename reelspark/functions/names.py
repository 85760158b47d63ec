"""Things that are looked up by name: measures, detectors, providers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Generic, TypeVar

T = TypeVar("T")


class Named(Mapping, Generic[T]):
    """A mapping whose names don't depend on case or outer blanks, and each of which is given once."""

    def __init__(self, kind: str, **entries: T):
        self.kind, self._entries = kind, {}
        for name, entry in entries.items():
            self.put(name, entry)

    @staticmethod
    def _folded(name: str) -> str:
        return name.strip().casefold()

    def put(self, name: str, entry: T) -> T:
        if name in self:
            raise ValueError(f"there is a {self.kind} {name!r} already")
        self._entries[self._folded(name)] = entry
        return entry

    def __contains__(self, name: object) -> bool:
        return isinstance(name, str) and self._folded(name) in self._entries

    def __getitem__(self, name: str) -> T:
        if name not in self:
            raise KeyError(f"{self.kind} {name!r} is unknown; known: {', '.join(self)}")
        return self._entries[self._folded(name)]

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._entries))

    def __len__(self) -> int:
        return len(self._entries)
