"""Where a passage stands in a file, white space aside, and which line comes nearest to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a line that can stand for a passage, least likeness of a nearest line, lines that are shown from three before it on.
ANCHOR, LIKENESS, SHOWN = 6, 0.4, 14


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+", " ")


def _lines(rows: DataFrame, key: str, content: str) -> DataFrame:
    return rows.select(key, F.posexplode(F.split(content, "\n")).alias("at", "raw")).withColumn("line", _trimmed(F.col("raw")))


def tolerant_matches(files: DataFrame, searches: DataFrame) -> DataFrame:
    """(search, file, at, start, length, n): the place of a search's lines in files, with white space trimmed and its runs as one space.

    files (file, content), searches (search, passage); blank lines at a passage's ends don't
    count, a passage of blank lines matches nothing.  n is the number of places in the file: with more than one the match is
    ambiguous, and at, the first line from 0, start and length in characters are those of the first.  Nulls match nothing.

    A place is found by the passage's first line, by equality, then held against its other
    lines one by one, so a line that all files have costs as many rows as it has places, not pairs of them.
    """
    own = files.where("file is not null and content is not null")
    asked = _lines(searches.where("search is not null and passage is not null"), "search", "passage")
    full = asked.where("line <> ''").groupBy("search").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    asked = asked.join(full, "search").where("at between first and last").select("search", (F.col("at") - F.col("first")).alias("k"), F.col("line"), (F.col("last") - F.col("first") + 1).alias("size"))
    lines = _lines(own, "file", "content").select("file", "at", "line", F.length("raw").alias("width"))
    begun = asked.where("k = 0").join(lines, "line").select("search", "file", F.col("at").alias("begin"), "size")
    rest = begun.join(asked.select("search", "k", "line"), "search").withColumn("at", F.col("begin") + F.col("k"))
    met = rest.join(lines.select("file", "at", "line", "width"), ["file", "at", "line"])
    places = met.groupBy("search", "file", "begin", "size").agg(F.count("*").alias("hits"), (F.sum("width") + F.count("*") - 1).alias("length")).where("hits = size")
    first = places.groupBy("search", "file").agg(F.min(F.struct("begin", "length")).alias("p"), F.count("*").alias("n"))
    before = first.select("search", "file", "p.begin", "p.length", "n").join(own.select("file", F.split("content", "\n").alias("all")), "file")
    start = F.aggregate(F.slice("all", F.lit(1), F.col("begin")), F.lit(0), lambda total, x: total + F.length(x) + 1)
    return before.select("search", "file", F.col("begin").alias("at"), start.alias("start"), "length", "n")


def nearest_lines(files: DataFrame, searches: DataFrame) -> DataFrame:
    """(search, at, likeness, shown): the line of the search's own file that comes nearest to the passage's first line of six characters or more.

    files (file, content), searches (search, file, passage).  Likeness is the share of common words of two letters or more
    in the larger set of the two; the first of equal lines counts, from a likeness of 0.4.  shown are up to
    14 numbered lines, from three before it.  Searches without such a line have no row.
    """
    words = lambda line: F.array_distinct(F.filter(F.split(F.lower(line), "[^a-z0-9_]+"), lambda w: F.length(w) >= 2))
    asked = _lines(searches.where("search is not null and passage is not null"), "search", "passage").where(F.length(F.regexp_replace("raw", r"^\s+|\s+$", "")) >= ANCHOR)
    anchor = asked.groupBy("search").agg(F.min_by("raw", "at").alias("raw")).select("search", words(F.col("raw")).alias("words")).where(F.size("words") > 0)
    anchor = anchor.join(searches.select("search", "file"), "search").where("file is not null").select("search", "file", F.size("words").alias("wanted"), F.explode("words").alias("word"))
    lines = _lines(files.where("content is not null"), "file", "content").select("file", "at", words(F.col("raw")).alias("words"))
    lines = lines.select("file", "at", F.size("words").alias("size"), F.explode("words").alias("word"))
    met = anchor.join(lines, ["file", "word"]).groupBy("search", "file", "at", "wanted", "size").agg(F.count("*").alias("common"))
    scored = met.withColumn("likeness", F.col("common") / F.greatest("wanted", "size"))
    best = scored.groupBy("search", "file").agg(F.min(F.struct((-F.col("likeness")).alias("less"), "at")).alias("b")).where(-F.col("b.less") >= LIKENESS)
    near = best.select("search", "file", "b.at", (-F.col("b.less")).alias("likeness")).join(files.select("file", F.split("content", "\n").alias("all")), "file")
    first = F.greatest(F.col("at") - 3, F.lit(0))
    shown = F.transform(F.slice("all", first + 1, F.lit(SHOWN)), lambda line, i: F.concat((first + i + 1).cast("string"), F.lit(": "), line))
    return near.select("search", "at", "likeness", F.array_join(shown, "\n").alias("shown"))
