"""Deterministic uniforms from MD5: independent of partitioning and identical in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanloom import settings as S

SPAN = 1 << 32  # uniform32 lies in [0, SPAN)


def uniform32(key: Column, salt: str | Column) -> Column:
    """The first 32 bits of md5(key || salt) as a bigint."""
    salt_col = F.lit(salt) if isinstance(salt, str) else salt
    digest = F.md5(F.concat(key.cast("string"), salt_col.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(key: Column, salt: str | Column) -> Column:
    """The same number scaled to [0, 1)."""
    return uniform32(key, salt) / F.lit(float(SPAN))


def split_name(key: Column, year: Column, dev_max: int, oot_1_max: int, seed: str = S.SPLIT_SEED,
               oot_names: tuple[str, str] = ("test_oot_1", "test_oot_2")) -> Column:
    """Hash split inside the development years, fixed names for the later years."""
    bucket = uniform32(key, seed) % 100
    inside = F.lit(None).cast("string")
    for name, upper in reversed(S.SPLIT_BOUNDS):
        inside = F.when(bucket < upper, F.lit(name)).otherwise(inside)
    return (F.when(year <= dev_max, inside)
            .when(year <= oot_1_max, F.lit(oot_names[0]))
            .when(year > oot_1_max, F.lit(oot_names[1])))


def fresh_split_name(year: Column) -> Column:
    return F.concat(F.lit("fresh_"), year.cast("string"))
