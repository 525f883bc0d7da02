"""Functions for Python workers that need no copy of this package there."""

from __future__ import annotations

from collections.abc import Callable


def portable(function: Callable) -> Callable:
    """Have a module's function pickled by value, as Spark does for functions of a script.

    Whatever it calls from this package must be portable too and be imported by name.
    """
    function.__module__ = "__main__"
    return function
