"""Attach per-key values to rows without ever gathering a key's rows in one task.

A window over the key would bring all rows of a key to one task. Here the values come from a
``groupBy`` (combined on the map side, so a hot key shrinks to one row per task before the
shuffle) and are joined back. When the aggregate is small Spark broadcasts it, by its own size
check; otherwise both sides are shuffled and adaptive execution splits a hot partition of rows.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPLIT = "_key_hash"


def attach(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of ``rows`` with one row per key; rows with a null key get nulls.

    The hash column is a second join key. Without it the aggregate would reuse the shuffle of its
    own ``groupBy``, and adaptive execution only splits a skewed join whose two inputs are both
    plain shuffles. The extra shuffle moves the narrow side only.
    """
    key_hash = F.xxhash64(*keys)
    left = rows.withColumn(_SPLIT, key_hash)
    right = per_key.withColumn(_SPLIT, key_hash)
    return left.join(right, [*keys, _SPLIT], "left").drop(_SPLIT)


def keep_matching(rows: DataFrame, key_table: DataFrame, keys: list[str]) -> DataFrame:
    """Left semi join on distinct keys, splittable in the same way as :func:`attach`."""
    key_hash = F.xxhash64(*keys)
    return (
        rows.withColumn(_SPLIT, key_hash)
        .join(key_table.select(*keys).withColumn(_SPLIT, key_hash), [*keys, _SPLIT], "left_semi")
        .drop(_SPLIT)
    )
