"""Sections of structured text, their running text and their bullets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What begins a section, and what begins a bullet.
HEADING, BULLET = r"^##\s+(.+)$", r"^[-*•]"


def sections(docs: DataFrame, id_column: str = "doc_id", content: str = "text", most: int = 4) -> DataFrame:
    """(id, section, body, said, bullets): a row for each section of a text, under its name.

    A section begins with a line of two number signs and goes to the next one; what comes before the
    first is none.  A text without line breaks has those that are written as ``\\n``.  A section without
    a line has no row; of several of one name the last one that has lines counts.  said joins
    the lines that are no bullets, bullets are the first ``most`` that aren't empty.  A null text has no sections.

    Sections are islands of lines: their running number is a count of headings, in place order.
    """
    text = F.when(~F.contains(content, F.lit("\n")) & F.contains(content, F.lit("\\n")), F.replace(content, F.lit("\\n"), F.lit("\n"))).otherwise(F.col(content))
    line = docs.select(F.col(id_column).alias("id"), F.posexplode(F.split(text, "\n")).alias("at", "raw")).withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    line = line.withColumn("name", F.when(F.col("line").rlike(HEADING), F.trim(F.regexp_extract("line", HEADING, 1))))
    numbered = line.withColumn("part", F.count("name").over(Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).where("part > 0")
    whole = numbered.groupBy("id", "part").agg(F.max("name").alias("section"), F.array_sort(F.collect_list(F.when(F.col("name").isNull(), F.struct("at", "raw", "line")))).alias("lines")).where(F.size("lines") > 0)
    last = whole.groupBy("id", "section").agg(F.max_by("lines", "part").alias("lines"))
    bullet = F.filter(F.transform("lines", lambda x: x["line"]), lambda x: x.rlike(BULLET))
    said = F.filter(F.transform("lines", lambda x: x["line"]), lambda x: (F.length(x) > 0) & ~x.rlike(BULLET))
    body = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["raw"]), "\n"), r"^\s+|\s+$", "")
    items = F.filter(F.transform(bullet, lambda x: F.trim(F.regexp_replace(x, BULLET + r"\s*", ""))), lambda x: x != "")
    return last.select(F.col("id").alias(id_column), "section", body.alias("body"), F.array_join(said, " ").alias("said"), F.slice(items, 1, most).alias("bullets"))
