"""The lattice of column types that landings can grow through (S3)."""

from __future__ import annotations

#: Types from narrow to wide; two types meet in the first one above both.
LATTICE = {
    "boolean": ("boolean", "string"),
    "bigint": ("bigint", "double", "string"),
    "double": ("double", "string"),
    "date": ("date", "timestamp_ntz", "string"),
    "timestamp_ntz": ("timestamp_ntz", "string"),
    "string": ("string",),
}


def widest(a: str | None, b: str | None) -> str | None:
    """The least type that holds values of both; ``None`` has no values yet."""
    if a is None or b is None:
        return a or b
    return next(t for t in LATTICE[a] if t in LATTICE[b])
