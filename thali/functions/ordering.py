"""Sort keys with PostgreSQL's NULL placement (R9) and a stable tie-break."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pg_desc(col: Column | str) -> Column:
    """``DESC`` as PostgreSQL sorts it: NULLs first."""
    return _c(col).desc_nulls_first()


def pg_asc(col: Column | str) -> Column:
    """``ASC`` as PostgreSQL sorts it: NULLs last."""
    return _c(col).asc_nulls_last()


def order_desc(col: Column | str, *ties: Column | str) -> list[Column]:
    """Newest/largest first, then the tie-break keys ascending so results repeat."""
    return [pg_desc(col)] + [pg_asc(t) for t in ties]
