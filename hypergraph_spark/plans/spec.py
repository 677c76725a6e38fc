"""The column spec: `[complex::][reflexive::]name`, columns apart by one space."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Column:
    name: str
    complex: bool = False
    reflexive: bool = False
    transient: bool = False
    ignore: bool = False


def parse_spec(spec: str, legacy: bool = False) -> list[Column]:
    """Columns of a spec; modifiers are case-insensitive. legacy also knows transient and ignore."""
    known = {"complex", "reflexive"} | ({"transient", "ignore"} if legacy else set())
    out = []
    for part in spec.split(" "):
        *modifiers, name = part.split("::")
        lower = {m.lower() for m in modifiers}
        if bad := lower - known:
            raise ValueError(f"unrecognized column modifier: {sorted(bad)[0]}")
        c = Column(name, **{m: True for m in lower})
        if c.reflexive and not c.complex:
            raise ValueError(f"reflexive column must be complex: {name}")
        if c.reflexive and c.transient:
            raise ValueError(f"a column cannot be reflexive and transient: {name}")
        out.append(c)
    return out


def relations(columns: list[Column]) -> list[tuple[int, int]]:
    """Index pairs that form a relation: every two columns (not both transient), a reflexive one with itself."""
    kept = [(i, c) for i, c in enumerate(columns) if not c.ignore]
    out = [(i, j) for x, (i, a) in enumerate(kept) for j, b in kept[x + 1 :] if not (a.transient and b.transient)]
    return out + [(i, i) for i, c in kept if c.reflexive]


def single_relation(columns: list[Column]) -> tuple[int, int]:
    found = relations(columns)
    if len(found) != 1:
        raise ValueError("More than one relation!" if found else "More than one relation! (the spec has none)")
    return found[0]
