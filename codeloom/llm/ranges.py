"""Places and running totals in an order over all rows, however hot a key is.

Rows are dealt by ranges of (key, order), so a key with a third of all rows spans many
parts.  Only the first key of a part can have begun in an earlier one, so what a part takes
over from those before it is one row a part at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


def dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """A written copy of ``rows`` in ranges of ``by`` (ascending, nulls first), with columns part and at (ascending in that order)."""
    order = [F.col(c).asc_nulls_first() for c in by]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return staged(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ranges")


def placed(ranged: DataFrame, key: list[str], value: str | None = None) -> DataFrame:
    """Adds pos, a row's place in its key from 0, and with ``value`` upto, the key's running total with this row.

    ``ranged`` is from :func:`dealt`, with ``key`` (which may be empty) first in its order.
    """
    told = F.struct(*[F.col(c) for c in key], F.lit(0).alias("all"))
    sums = {"pos": F.count("*"), **({"upto": F.sum(value)} if value else {})}
    here = Window.partitionBy("part", *key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    runs = ranged.groupBy("part", *key).agg(F.min("at").alias("first"), *[x.alias(f"run_{c}") for c, x in sums.items()])
    past = Window.partitionBy(*key or [F.lit(0)]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    past = runs.select("part", told.alias("told"), "first", *[F.sum(f"run_{c}").over(past).alias(f"past_{c}") for c in sums])
    heads = past.where("past_pos > 0 and first = shiftleft(cast(part as bigint), 33)").drop("first")  # monotonically_increasing_id begins there
    both = ranged.withColumns({c: x.over(here) for c, x in sums.items()}).join(F.broadcast(heads), "part", "left")
    over = {c: F.col(c) + F.when(F.col("told").eqNullSafe(told), F.col(f"past_{c}")).otherwise(0) for c in sums}
    over["pos"] = over["pos"] - 1
    return both.withColumns(over).drop("told", *[f"past_{c}" for c in sums], "part", "at")
