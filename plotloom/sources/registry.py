"""Names for parts that a configuration chooses."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    """Parts by kind and name. A name that is taken raises KeyError; ``get('kind.name')`` gives a default for what isn't there."""

    def __init__(self) -> None:
        self.parts: dict[str, dict[str, Any]] = {}

    def register(self, kind: str, name: str) -> Callable:
        def add(part):
            own = self.parts.setdefault(kind, {})
            if name in own:
                raise KeyError(f"{kind} {name} is registered already")
            own[name] = part
            return part

        return add

    def get(self, path: str, default: Any = None) -> Any:
        at: Any = self.parts
        for step in path.split(".", 1):
            if not isinstance(at, dict) or step not in at:
                return default
            at = at[step]
        return at

    def names(self, kind: str) -> list[str]:
        return sorted(self.parts.get(kind, {}))


REGISTRY = Registry()
