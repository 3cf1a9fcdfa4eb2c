"""Search terms: ``hash`` or ``algo:hash``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted term shapes. The strict one knows no digit-dash
# algorithm names and no upper-case letter after F.
TERM = r"^(?:([A-Za-z0-9-]+):)?([a-fA-F0-9]{8,128})$"
TERM_STRICT = r"^(?:([a-zA-F0-9]+):)?([a-fA-F0-9]{8,128})$"


def parse_hash_term(term: Column, strict: bool = False) -> Column:
    """``struct<algo,hash>``, lower-cased; null algo without prefix, null struct if invalid."""
    pattern = TERM_STRICT if strict else TERM
    algo = F.lower(F.regexp_extract(term, pattern, 1))
    return F.when(
        term.rlike(pattern),
        F.struct(
            F.nullif(algo, F.lit("")).alias("algo"),
            F.lower(F.regexp_extract(term, pattern, 2)).alias("hash"),
        ),
    )
