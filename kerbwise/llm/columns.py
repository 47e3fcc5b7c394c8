"""Names for helper columns beside the columns of any table."""

from __future__ import annotations

from collections.abc import Iterable


def free(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as keep it apart from those taken (Spark ignores case)."""
    held = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        out.append(name)
        held.add(name.lower())
    return out
