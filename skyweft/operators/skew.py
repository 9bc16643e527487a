"""Joins whose left side may hold a large share of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so that there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``weight`` the left rows of that key.

    Rows of hot keys meet a broadcast of at most HOT_SHARE rows where they stand; only the others are
    dealt by key. Both tables are read twice, so they should be written tables. Null keys match nothing.
    """
    right = right.where(F.col(key).isNotNull())
    total = right.agg(F.sum(weight).alias("n")).first()["n"] or 0
    hot = F.broadcast(right.where(F.col(weight) * HOT_SHARE > total).drop(weight))
    cold = right.where(F.col(weight) * HOT_SHARE <= total).drop(weight)
    keys = hot.select(key)
    some = left.join(hot, key)
    rest = left.where(F.col(key).isNotNull()).join(keys, key, "left_anti").join(cold, key, how)
    out = some.unionByName(rest)
    if how == "left":
        extra = [c for c in right.columns if c not in (key, weight)]
        types = dict(right.dtypes)
        out = out.unionByName(left.where(F.col(key).isNull()).withColumns({c: F.lit(None).cast(types[c]) for c in extra}))
    return out
