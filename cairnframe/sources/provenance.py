"""Who wrote an artifact: a record of type, version, platform and packages."""

from __future__ import annotations

import contextlib
import json
import platform
import warnings

import pyspark

FILE = "_environment.json"

_state = {"use": True, "registered": False, "loaded": []}


def use(value: bool | None = None) -> bool:
    """Whether records are written; setting returns the value before."""
    before = _state["use"]
    if value is not None:
        _state["use"] = value
    return before


def record() -> dict:
    import pyarrow

    return {
        "type": "pyspark",
        "version": pyspark.__version__,
        "platform": platform.platform(),
        "packages": {"pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__, "python": platform.python_version()},
    }


@contextlib.contextmanager
def registering():
    """Yields a writer of the record; inside another registration it writes nothing."""
    outermost = not _state["registered"]
    _state["registered"] = True
    made = record() if outermost and _state["use"] else None

    def write(files, path: str) -> None:
        if made is not None:
            files.write(f"{path}/{FILE}", json.dumps(made, indent=2))

    try:
        yield write
    finally:
        if outermost:
            _state["registered"] = False


@contextlib.contextmanager
def loading(files, path: str):
    """The record of ``path`` is the current one inside; nested loads stack, a broken record warns."""
    found = None
    if files.exists(f"{path}/{FILE}"):
        try:
            found = json.loads(files.read(f"{path}/{FILE}"))
        except Exception:  # any broken record: bad JSON, bad checksum, no permission
            warnings.warn(f"cannot read the environment of '{path}'", stacklevel=2)
    _state["loaded"].append(found)
    try:
        yield found
    finally:
        _state["loaded"].pop()


def current() -> dict | None:
    """Record of the innermost object that is being read and has one."""
    return next((r for r in reversed(_state["loaded"]) if r), None)
