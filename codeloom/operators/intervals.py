"""Which interval a point lies in, without a join on a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(length: Column) -> Column:
    """The least k with 4^k >= length, by integers: half the binary digits of length - 1, rounded up."""
    return F.when(length <= 1, F.lit(0)).otherwise(F.floor((F.length(F.bin(length - 1)) + 1) / 2).cast("int"))


def first_scope(points: DataFrame, scopes: DataFrame, by: list[str], at: str, start: str, end: str, order: list[str]) -> DataFrame:
    """``points`` with the struct scope of all other columns of the first scope, by ``order``, of their key that they lie in; null where there is none.

    Both ends belong to a scope.  Points and scopes meet by equal (key, level, bin): a scope of length
    n lies on the level whose bins are the least power of 4 of at least n, in two bins at most;
    a point asks once on each level that any scope lies on, of which there are 31 at most.  So neither
    a long scope nor a key with many of both is met pair by pair, and a hot key is
    spread over its bins.  A null key, place or end meets nothing, nor does a scope that ends before it starts.
    """
    spread = scopes.where(F.col(start) <= F.col(end)).withColumn("_level", _level(F.col(end) - F.col(start) + 1))
    levels = [r[0] for r in spread.select("_level").distinct().collect()]
    bin_of = lambda x, level: F.floor(x / F.call_function("shiftleft", F.lit(1).cast("bigint"), 2 * level)).cast("bigint")
    own = [c for c in scopes.columns if c not in by]
    rows = points.select("*", F.monotonically_increasing_id().alias("_point"))
    told = spread.select(*by, F.struct(*own).alias("scope"), "_level", F.explode(F.sequence(bin_of(F.col(start), F.col("_level")), bin_of(F.col(end), F.col("_level")))).alias("_bin"))
    asked = rows.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels or [0]]))).withColumn("_bin", bin_of(F.col(at), F.col("_level")))
    met = asked.join(told, [*by, "_level", "_bin"], "left")  # once: a point's number may differ where it is worked out again
    inside = F.col("scope").isNotNull() & (F.col(at) >= F.col(f"scope.{start}")) & (F.col(at) <= F.col(f"scope.{end}"))
    best = F.min_by("scope", F.when(inside, F.struct(*[F.col(f"scope.{c}") for c in order])))
    return met.groupBy(*points.columns, "_point").agg(best.alias("scope")).drop("_point")
