"""Feature keys: portable hashes, field-tagged keys and unsigned arithmetic on 64-bit ids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed layout: the top 10 bits of a key are its field, the other 54 its hash.
FIELD_SHIFT, HASH_DROP = 54, 10


def md5_60(x: Column) -> Column:
    """A non-negative 60-bit hash of a string that other engines can compute too."""
    return F.conv(F.substring(F.md5(x.cast("string")), 1, 15), 16, 10).cast("long")


def field_key(h: Column, field: Column | int) -> Column:
    """Hash and field in one 64-bit key."""
    field = F.lit(field) if isinstance(field, int) else field
    return F.shiftrightunsigned(h, HASH_DROP).bitwiseOR(F.shiftleft(field.cast("long"), FIELD_SHIFT))


def string_key(x: Column, field: Column | int, portable: bool = False) -> Column:
    """A string's key under a field; ``portable`` takes :func:`md5_60`, else the faster 64-bit hash."""
    return field_key(md5_60(x) if portable else F.xxhash64(x), field)


def group_key(feature_id: Column, group: Column) -> Column:
    """A numeric id and its group (10 bits) in one key."""
    return F.shiftrightunsigned(feature_id, HASH_DROP).bitwiseOR(F.shiftleft(group.cast("long"), FIELD_SHIFT))


def reverse_nibbles(x: Column) -> Column:
    """The 16 hex digits of a 64-bit id in reverse order, which spreads neighbouring ids."""
    return F.conv(F.reverse(F.lpad(F.hex(x), 16, "0")), 16, -10).cast("long")


def unsigned_mod(x: Column, n: int) -> Column:
    """Remainder of a 64-bit id taken as unsigned."""
    return (F.conv(F.hex(x), 16, 10).cast("decimal(20,0)") % F.lit(n).cast("decimal(20,0)")).cast("long")


def unsigned_order(x: Column) -> Column:
    """A signed key that sorts as the id does when taken as unsigned."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def unsigned_text(x: Column) -> Column:
    """A 64-bit id taken as unsigned, in decimal digits."""
    return F.when(x >= 0, x.cast("string")).otherwise(F.conv(F.hex(x), 16, 10))


def bernoulli(key: Column, seed: int, per_thousand: int) -> Column:
    """True for about ``per_thousand`` of 1000 keys, the same ones on every run."""
    return md5_60(F.concat_ws("#", key.cast("string"), F.lit(str(seed)))) % 1000 < per_thousand


def uniform(key: Column, seed: int) -> Column:
    """A double in [0, 1) that depends on key and seed alone."""
    return (md5_60(F.concat_ws("#", key.cast("string"), F.lit(str(seed)))) % 1000003) / F.lit(1000003.0)


def seeded_normal(key: Column, k: int, seed: int, scale: float) -> Column:
    """The k-th normal number of a key, with mean 0 and deviation ``scale``; it depends on key, k and seed alone."""
    draw = lambda part: uniform(F.concat_ws(":", key.cast("string"), F.lit(f"{k}{part}")), seed)
    return F.sqrt(-2 * F.log(1 - draw("a"))) * F.cos(2 * math.pi * draw("b")) * scale
