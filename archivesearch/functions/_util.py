from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """Bind ``value`` once and evaluate ``body(v)`` on it.

    Composed Column functions would otherwise copy their input expression at every
    use, which grows plans exponentially when they are nested.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
