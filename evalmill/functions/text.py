"""White space by Python's rules, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python takes for white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    """Null, empty or white space alone."""
    return F.coalesce(stripped(text), F.lit("")) == ""
