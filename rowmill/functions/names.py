"""Names that a caller's columns cannot clash with."""

from __future__ import annotations

from collections.abc import Iterable


def unused(names: Iterable[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that are not among the given names, in any case."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out
