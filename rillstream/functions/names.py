"""Names of columns that are added for a while."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Each wanted name with as many underscores before it as no taken name has; case does not count."""
    have, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out
