"""Registries: how types are read, saved, validated and related; overrides for whole applications."""

from __future__ import annotations

import importlib.metadata
import warnings
from collections.abc import Callable


class Registry:
    """type name -> function, with a policy for names already taken."""

    def __init__(self, what: str):
        self.what = what
        self._known: dict[str, Callable | str] = {}

    def register(self, name: str, function: Callable | str | None, existing: str = "old") -> None:
        """``existing``: keep the ``old`` one, take the ``new`` one or raise an ``error``; None removes.

        A string ``module:attribute`` is resolved when it is first asked for.
        """
        if function is None:
            self._known.pop(name, None)
            return
        if name in self._known:
            if existing == "error":
                raise ValueError(f"{self.what} of type '{name}' is already registered")
            if existing == "old":
                return
            if existing != "new":
                raise ValueError(f"unknown policy '{existing}'")
        self._known[name] = function

    def get(self, name: str) -> Callable:
        if name not in self._known:
            raise KeyError(f"no {self.what} for type '{name}'")
        found = self._known[name]
        if isinstance(found, str):
            module, _, attribute = found.partition(":")
            found = getattr(importlib.import_module(module), attribute)
            self._known[name] = found
        return found

    def __contains__(self, name: str) -> bool:
        return name in self._known

    def names(self) -> list[str]:
        return sorted(self._known)


class Relation:
    """name -> set of names; changes report whether they changed anything."""

    def __init__(self):
        self._sets: dict[str, set[str]] = {}

    def change(self, name: str, of: str, action: str = "add") -> bool:
        held = self._sets.setdefault(of, set())
        if action == "add":
            changed = name not in held
            held.add(name)
        elif action == "remove":
            changed = name in held
            held.discard(name)
        else:
            raise ValueError(f"unknown action '{action}'")
        return changed

    def holds(self, name: str, of: str) -> bool:
        return name in self._sets.get(of, ())


class Override:
    """A settable function; setting returns the one before."""

    def __init__(self, default: Callable):
        self._default = self._current = default

    def __call__(self, *args, **kwargs):
        return self._current(*args, **kwargs)

    def set(self, function: Callable | None) -> Callable:
        before, self._current = self._current, function or self._default
        return before


readers = Registry("reader")
savers = Registry("saver")
validators = Registry("validator")
heights = Registry("height function")
dimensions = Registry("dimensions function")
interfaces = Relation()
derived = Relation()

_searched: set[str] = set()


def search_plugins(kind: str) -> bool:
    """Loads the entry points ``cairnframe.<kind>`` once; warns of those that fail. True if any was loaded."""
    if kind in _searched:
        return False
    _searched.add(kind)
    loaded = False
    for point in importlib.metadata.entry_points(group=f"cairnframe.{kind}"):
        try:
            point.load()
            loaded = True
        except ImportError as e:
            warnings.warn(f"plugin '{point.name}' cannot be loaded: {e}", stacklevel=2)
    return loaded
