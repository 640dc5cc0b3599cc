"""The held-out split and bounded samples of labelled rows."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(ident: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is held out, so that it is never learned from."""
    return F.coalesce(F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def is_held_out(ident: int | None) -> bool:
    """The same of a Python value."""
    return ident is None or zlib.crc32(str(ident).encode()) % 4 == 2


def share(ident: Column) -> Column:
    """A number from 0 to 1 that depends on the id alone: rows below a limit are a sample."""
    return F.pmod(F.xxhash64(ident, F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
