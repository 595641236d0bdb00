"""Reading identifiers that producers do not all write alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid_value(text: Column) -> Column:
    """The 128-bit value an identifier states, as 16 bytes; null where it states none.

    Case, surrounding space, hyphens, braces, parentheses and a ``urn:uuid:`` or ``0x``
    prefix do not matter. Anything without exactly 32 hexadecimal digits is missing, and so
    is a mere placeholder: one digit repeated (the nil and the all-ones identifier included).
    """
    bare = F.regexp_replace(F.lower(text), r"^[\s{(\"']*(urn:)?(uuid:|0x)?", "")
    bare = F.regexp_replace(bare, r"[^0-9a-z]", "")
    usable = bare.rlike(r"^[0-9a-f]{32}$") & ~bare.rlike(r"^(.)\1{31}$")
    return F.when(usable, F.unhex(bare))


def folded(text: Column) -> Column:
    """Trimmed and in lower case; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), F.lit(""))
