"""Identity expressions: posting ids, deduplication keys, hash splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stellwerk.functions.text import fold

SEED = 20261004
#: 0.4 of the range of eight hexadecimal digits, as a string to compare with.
DEV_BELOW = "66666666"


def content_hash(title: Column, company: Column, location: Column, description: Column) -> Column:
    """SHA-256 of the four fields, parted by a unit separator, nulls as empty strings."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("")) for c in (title, company, location, description))), 256)


def job_id(url: Column, content: Column) -> Column:
    """24 digits of the address' hash, or of the content's where there is no address."""
    return F.substring(F.when(F.length(url) > 0, F.sha2(url, 256)).otherwise(content), 1, 24)


def dedup_key(url: Column, content: Column) -> Column:
    """The folded address, or the whole content hash."""
    return F.when(F.length(url) > 0, F.concat(F.lit("url:"), fold(url))).otherwise(F.concat(F.lit("content:"), content))


def corpus_half(key: Column) -> Column:
    """0 or 1: the parity of the first byte of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 2, 1), 16, 10).cast("int") % 2


def split(key: Column, seed: int = SEED) -> Column:
    """dev for 0.4 of the keys, test for the others."""
    return F.when(F.substring(F.sha2(F.concat(F.lit(f"{seed}:split:"), key), 256), 1, 8) < DEV_BELOW, "dev").otherwise("test")


def shuffle_key(key: Column, seed: int = SEED) -> Column:
    """A seeded order: MD5 of seed and key."""
    return F.md5(F.concat(F.lit(str(seed)), key))
