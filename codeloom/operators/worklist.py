"""Work units of a file tree: directories small enough to be read as one, from paths alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import IGNORED_DIRECTORIES
from ..plans.staging import few, released, staged

#: A directory of so many files is a unit; how deep units, and files that count, may lie.
UNIT_FILES, UNIT_DEPTH, FILE_DEPTH, LISTED = 150, 6, 8, 300


def _folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def seen_files(files: DataFrame) -> DataFrame:
    """Distinct paths outside of directories that scans skip or whose name begins with a dot."""
    hidden = F.exists(_folders(F.col("path")), lambda f: f.isin(IGNORED_DIRECTORIES) | F.startswith(f, F.lit(".")))
    return files.select("path").where("path is not null").distinct().where(~hidden)


def work_units(files: DataFrame, most: int | None = 500) -> DataFrame:
    """(unit, place): the units of a tree of files (path, relative to its root), the first ``most`` by path, places from 1.

    From each directory of the root: a single subdirectory is entered; a directory of up to
    150 files (down to eight levels below it) is a unit, as is any seven levels down; a
    larger one is taken apart into its subdirectories.  Where the way down ends in a directory
    without subdirectories, the one that the way began with is the unit.  Files of the
    root itself are in no unit.

    Directories are counted once, bottom-up, by an explode of each path's ancestors that is
    summed before it moves; each of the seven rounds then joins its frontier to the directories below it.
    """
    folders = seen_files(files).select(_folders(F.col("path")).alias("f")).where(F.size("f") > 0)
    depth = F.size("f")
    # a file counts for the directories up to eight levels above its own
    above = F.transform(F.sequence(F.lit(1), depth), lambda n: F.struct(F.array_join(F.slice("f", F.lit(1), n), "/").alias("dir"), (depth - n <= FILE_DEPTH).cast("int").alias("counts")))
    counted = folders.select(F.explode(above).alias("x")).groupBy("x.dir").agg(F.sum("x.counts").alias("n_files"))
    own = staged(counted, "directories")
    parent = F.regexp_extract("dir", "^(.*)/[^/]*$", 1)
    below = own.where(F.contains("dir", F.lit("/"))).select(parent.alias("dir"), F.col("dir").alias("child"))
    dirs = staged(own.join(below.groupBy("dir").agg(F.count("*").alias("n_below")), "dir", "left").fillna(0, ["n_below"]), "directories")
    now = dirs.where(~F.contains("dir", F.lit("/"))).select("dir", F.col("dir").alias("top"))
    units = None
    for level in range(UNIT_DEPTH + 2):
        met = now.join(dirs, "dir")
        deep = F.lit(level > UNIT_DEPTH)
        ends = F.when(deep, F.col("dir")).when(F.col("n_below") == 0, F.col("top")).when((F.col("n_below") > 1) & (F.col("n_files") <= UNIT_FILES), F.col("dir"))
        met = staged(met.withColumn("unit", ends), "units")
        found = met.where("unit is not null").select("unit")
        units = found if units is None else units.unionByName(found)
        open_ = met.where("unit is null")
        if open_.isEmpty():
            break
        now = open_.select("dir", "top", "n_below").join(below, "dir").select(F.col("child").alias("dir"), F.when(F.col("n_below") == 1, F.col("top")).otherwise(F.col("child")).alias("top"))
    released(own)
    units = units.distinct()
    if most:
        units = units.orderBy("unit").limit(most)
        return units.withColumn("place", F.row_number().over(Window.orderBy("unit")))  # ``most`` rows
    return units


def unit_files(files: DataFrame, units: DataFrame, most: int = LISTED) -> DataFrame:
    """(unit, path): the first ``most`` files, by path, that lie up to eight levels below each unit (unit)."""
    own = seen_files(files)
    above = F.transform(F.sequence(F.lit(1), F.size("f")), lambda n: F.array_join(F.slice("f", F.lit(1), n), "/"))
    placed = own.withColumn("f", _folders(F.col("path"))).where(F.size("f") > 0).select("path", F.size("f").alias("depth"), F.explode(above).alias("unit"))
    asked = few(staged(units.select("unit").distinct(), "units"))
    within = placed.where(F.col("depth") - F.size(F.split("unit", "/")) <= FILE_DEPTH).join(asked, "unit")
    return within.withColumn("n", F.row_number().over(Window.partitionBy("unit").orderBy("path"))).where(F.col("n") <= most).select("unit", "path")
