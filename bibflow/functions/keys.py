"""Join keys of bounded width."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDTH = 64


def key_of(*columns: Column | str) -> Column:
    """One key for the given values, at most 65 bytes long.

    Equal values give equal keys and a null equals only a null, so a plain
    equi-join on the key is a null-safe join on the values. Short values are
    kept as they are; longer ones count by their SHA-256 digest, so long texts
    cost no more in a shuffle or a broadcast.
    """
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    if len(texts) == 1:
        value = F.coalesce(F.concat(F.lit("="), texts[0]), F.lit("-"))
    else:
        value = F.concat(*[
            F.coalesce(F.concat(F.length(t).cast("string"), F.lit("="), t), F.lit("-")) for t in texts
        ])
    return F.when(F.octet_length(value) <= _WIDTH, value).otherwise(F.concat(F.lit("#"), F.sha2(value, 256)))
