"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.sources.scratch import shared_dir  # noqa: F401
from tessera.sources.scratch import written as table  # noqa: F401


def held_out(doc_id):
    """crc32(doc_id as text) mod 4 is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_or_empty(col):
    """A text column, null read as empty."""
    return F.coalesce(col.cast("string"), F.lit(""))
