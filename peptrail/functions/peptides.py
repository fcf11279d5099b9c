"""Normal forms of peptides and sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(peptide: Column) -> Column:
    """One trailing newline removed, in capitals."""
    return F.upper(F.regexp_replace(peptide, r"\n\z", ""))


def folded(sequence: Column) -> Column:
    """Leucine written as isoleucine."""
    return F.translate(sequence, "L", "I")
