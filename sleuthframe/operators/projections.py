"""Read models that follow a ledger by what has changed in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.operators.rollups import latest_per


def rebuilt(ledger: DataFrame, key: str, values: list[str], shown: str = "true", time: str = "computed_at", tie: str = "id") -> DataFrame:
    """The whole projection: ``key`` and ``values`` of each key's newest row, where ``shown`` (SQL over that row) holds."""
    return latest_per(ledger, key, time, tie).where(shown).select(key, *values)


def changes(projected: DataFrame, ledger: DataFrame, new: DataFrame, key: str, values: list[str], shown: str = "true", time: str = "computed_at", tie: str = "id") -> DataFrame:
    """What ``new`` rows of the ledger (already in it) do to a projection: ``action, key, values``; ``insert``, ``change`` or ``remove``.

    Only keys with new rows are looked up in ledger and projection; a late row that
    isn't its key's newest changes nothing. Removed keys keep the values they had.
    """
    touched = new.select(key).distinct()
    now = latest_per(ledger.join(touched, key, "left_semi"), key, time, tie)
    now = now.where(shown).select(F.col(key).alias("_key"), F.struct(*values).alias("_now"))
    was = projected.join(touched, key, "left_semi").select(F.col(key).alias("_old"), F.struct(*values).alias("_was"))
    both = now.join(was, F.col("_key") == F.col("_old"), "full_outer")
    action = F.when(F.col("_was").isNull(), "insert").when(F.col("_now").isNull(), "remove").when(~F.col("_now").eqNullSafe(F.col("_was")), "change")
    row = both.select(action.alias("action"), F.coalesce("_key", "_old").alias(key), F.coalesce("_now", "_was").alias("_row")).where("action is not null")
    return row.select("action", key, *[F.col(f"_row.{v}").alias(v) for v in values])


def applied(projected: DataFrame, delta: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The projection after a delta; giving the same delta twice changes nothing more."""
    kept = projected.select(key, *values).join(delta.select(key), key, "left_anti")
    return reduce(DataFrame.unionByName, [kept, delta.where("action <> 'remove'").select(key, *values)])
