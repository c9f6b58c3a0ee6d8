"""A key hash that SQL engines other than Spark can reproduce."""

from pyspark.sql import Column, functions as F

HASH_RANGE = 1 << 32


def key_hash(key: str | Column, salt: str) -> Column:
    """First 32 bits of the MD5 of ``salt:key``, as a bigint in [0, 2**32).

    A null key counts as the empty text, so that every row has a hash.
    """
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
