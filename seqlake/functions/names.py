"""Name sanitising on columns."""

from __future__ import annotations

import keyword

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's reserved words that are all lower case (a sanitised name is lower case).
LOWER_KEYWORDS = tuple(k for k in keyword.kwlist if k.islower())


def sanitize_name(name: Column, strict: bool = True, on_empty: str = "null") -> Column:
    """Lower case; runs of characters outside ``[0-9a-z]`` -> ``_``; trailing ``_`` removed.

    ``strict`` also makes it a valid identifier: a leading digit or a keyword gets a ``_``
    in front, and a leading ``_`` then gets an ``f`` in front. A name with no valid
    character is NULL (``on_empty='null'``) or fails the query (``on_empty='raise'``).
    """
    r = F.regexp_replace(F.regexp_replace(F.lower(name), "[^0-9a-z]+", "_"), "_+$", "")
    if strict:
        r = F.when(r.rlike("^[0-9]"), F.concat(F.lit("_"), r)).otherwise(r)
        r = F.when(r.isin(*LOWER_KEYWORDS), F.concat(F.lit("_"), r)).otherwise(r)
        r = F.when(r.startswith("_"), F.concat(F.lit("f"), r)).otherwise(r)
    empty = F.length(r) == 0
    if on_empty == "raise":
        return F.when(empty, F.raise_error(F.concat(F.lit("no valid characters in: "), name))) \
                .otherwise(r)
    return F.when(empty, F.lit(None).cast("string")).otherwise(r)
