"""Names for columns that an operator needs inside."""

from __future__ import annotations


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
