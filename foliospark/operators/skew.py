"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import bounded_broadcast

#: Rows of one key on the large side from which the key is hot.
HOT_ROWS = 20_000
#: Parts into which a hot key is split where hot keys are too many to be broadcast.
PARTS = 64


def join_by_size(left: DataFrame, keys: DataFrame, on: list[str], rows: str = "n", how: str = "inner", hot: int = HOT_ROWS) -> DataFrame:
    """``left`` joined with ``keys``, which has each key once and in ``rows`` how many rows of ``left`` have it.

    Hot keys, at most one for every ``hot`` rows of left, are counted and broadcast; where they are too many for that,
    they are salted by the hash of the whole row. All other keys are joined by a shuffle. ``how`` is inner or left_semi.
    Null keys match nothing; a key may be a struct with nulls in it, which are equal.
    ``keys`` should be checkpointed: it is read three times.
    """
    few, many = keys.where(F.col(rows) < hot).drop(rows), keys.where(F.col(rows) >= hot).drop(rows)
    if many.isEmpty():
        return left.join(few, on, how)
    small = bounded_broadcast(many)
    if small is not many:
        hot_rows = left.join(small, on, how)
    else:
        salted = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        hot_rows = left.withColumn("salt", F.pmod(F.xxhash64(*left.columns), F.lit(PARTS)).cast("int")).join(salted, [*on, "salt"], how).drop("salt")
    # Rows of hot keys would all meet in one task of the shuffle below, though none matches there.
    rest = left.join(small, on, "left_anti") if small is not many else left
    return rest.join(few, on, how).unionByName(hot_rows)
