"""A bounded store of computed values for Python workers."""

from __future__ import annotations

from collections.abc import Callable


class Known(dict):
    """Values by key; one that isn't there comes from the generation before, or else from `learn`."""

    def __init__(self, learn: Callable, old: dict | None = None):
        super().__init__()
        self.learn, self.old = learn, old or {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.learn(key)
        self[key] = value
        return value

    def bounded(self, limit: int) -> Known:
        """Itself, or past `limit` keys a new generation, which leaves what was used last within reach."""
        if len(self) <= limit:
            return self
        self.old = {}
        return Known(self.learn, self)
