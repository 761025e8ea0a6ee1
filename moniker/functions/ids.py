"""Short checksums of specifications."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base 32 without letters that look like digits or each other.
DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def short_id(text: str) -> str:
    """The upper 15 bits of a 2-byte BLAKE2b digest, as three digits."""
    bits = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=2).digest(), "big") >> 1
    return DIGITS[bits >> 10] + DIGITS[bits >> 5 & 31] + DIGITS[bits & 31]


def spec(version: str, fields: Mapping[str, object], constants: Mapping[str, object]) -> str:
    return "\n".join([version, *(f"F {k}={fields[k]}" for k in sorted(fields)), *(f"C {k}={constants[k]}" for k in sorted(constants))])


def layout(version: str, shapes: Mapping[str, Sequence[int]]) -> str:
    return "\n".join([version, *(f"S {k}={','.join(map(str, shapes[k]))}" for k in sorted(shapes))])


def config_id(wiring: str, layout_spec: str) -> str:
    return f"{short_id(wiring)}.{short_id(layout_spec)}"


def mismatch(stored: str, now: str) -> str | None:
    """What differs between two ids: wiring, layout or both; null if nothing does."""
    if stored.count(".") != 1:
        return "malformed"
    parts = [name for name, a, b in zip(("wiring", "layout"), stored.split("."), now.split("."), strict=True) if a != b]
    return " and ".join(parts) or None


def short_id_column(text: Column) -> Column:
    """``short_id`` in a table: the digest is no built-in function, so Arrow batches go to Python."""
    return F.pandas_udf(lambda s: s.map(short_id), "string")(text)


__all__ = ["config_id", "layout", "mismatch", "short_id", "short_id_column", "spec"]
