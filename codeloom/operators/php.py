"""Relations inside PHP methods: calls of services, static calls, types of parameters, reads and writes at run time.

All are joins over :func:`codeloom.sources.php.php_marks`.  A point belongs to the first method scope it
lies in.  A name is qualified by the file's imports; it means a symbol of the same
file, else the application's file of that class, else a dependency.  Null paths have no marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged
from .build import _id, php_file
from .intervals import first_scope

#: Types that name no class, and what a static call does by its method's name; other methods use the class.
BUILT_IN = ["string", "int", "float", "bool", "array", "object", "mixed", "callable", "iterable", "self", "parent", "static"]
VERBS = {
    "CREATES": ["create", "make", "factory"],
    "WRITES": ["put", "save", "update", "delete", "forget", "pull", "revoke"],
    "READS": ["find", "findorfail", "first", "firstorfail", "where", "query", "get", "has", "remember", "driver", "user"],
}


def static_type(method: Column) -> Column:
    out = F.lit("USES")
    for kind, verbs in VERBS.items():
        out = F.when(F.lower(method).isin(verbs), F.lit(kind)).otherwise(out)
    return out


def php_relations(marks: DataFrame, files: DataFrame) -> DataFrame:
    """(path, type, source_id, target_id, source, target, semantic, detail, at) of all PHP files.

    ``files`` (path) are all files there are.  source is Class.method or the path, target the name that
    was meant.  A call of a property whose class is neither declared here nor a file is left out, as is a
    static call outside of methods.  Of several types of a property the last counts, those of
    promoted parameters after the others; of several imports of a name, and methods of a name, the last.
    """
    marks = staged(marks, "marks")  # files are scanned once, not by each of the joins below
    of = lambda what: marks.where(F.col("what") == what)
    paths = files.select(F.col("path").alias("candidate")).where("candidate is not null").distinct()
    file_id = _id(F.lit("file"), F.col("path"))
    scopes = of("scope").select("path", "at", "end", "line", F.col("a").alias("container"), F.col("b").alias("method"))
    method_id = _id(F.col("path"), F.lit("method"), F.col("method"), F.col("line"))
    methods = scopes.groupBy("path", "container", "method").agg(F.max_by("line", "at").alias("line"), F.min("at").alias("first"))
    types = of("type").groupBy("path", F.col("a").alias("name")).agg(F.max_by(F.struct("line", F.col("b").alias("kind")), "at").alias("last"), F.min("at").alias("first"))
    aliases = of("alias").groupBy("path", F.col("a").alias("name")).agg(F.max_by("b", "at").alias("full"))

    def meant(rows: DataFrame, name: str) -> DataFrame:
        """Adds full, the qualified name, and short, its last part."""
        met = rows.join(aliases.withColumnRenamed("name", name), ["path", name], "left")
        full = F.when(F.contains(name, F.lit("\\")), F.col(name)).otherwise(F.coalesce("full", F.col(name)))
        return met.withColumn("full", full).withColumn("short", F.element_at(F.split("full", r"\\"), -1))

    points = marks.where(F.col("what").isin("call", "static", "header", "config", "locale")).select("path", "what", "at", "a", "b")
    placed = first_scope(points, scopes.withColumnRenamed("at", "start"), ["path"], "at", "start", "end", ["start", "end"])
    placed = staged(placed.select("path", "what", "at", "a", "b", "scope.container", "scope.method", "scope.line"), "placed")
    own_id = F.when(F.col("method").isNotNull(), method_id).otherwise(file_id)
    own_name = F.when(F.col("method").isNotNull(), F.concat_ws(".", "container", "method")).otherwise(F.col("path"))

    typed = of("property").select("path", F.lit(0).alias("kind"), "at", "a", "b").unionByName(of("parameter").where("c is not null").select("path", F.lit(1).alias("kind"), "end", "a", "b").withColumnRenamed("end", "at"))
    typed = typed.where(~F.lower("b").isin(BUILT_IN)).groupBy("path", "a").agg(F.max_by("b", F.struct("kind", "at")).alias("service"))
    calls = meant(placed.where("what = 'call'").withColumn("source_id", own_id).withColumn("source", own_name).join(typed, ["path", "a"]), "service")
    there = methods.select("path", F.col("container").alias("short"), F.col("method").alias("b"), _id(F.col("path"), F.lit("method"), F.col("method"), F.col("line")).alias("called"))
    calls = calls.join(there, ["path", "short", "b"], "left").withColumn("candidate", php_file(F.col("full"))).join(paths.withColumn("there", F.lit(True)), "candidate", "left")
    calls = calls.withColumn("target_id", F.coalesce("called", F.when(F.col("there"), _id(F.lit("file"), F.col("candidate"))))).where("target_id is not null")
    # outside of a method, the first declared class with a method of that name is the source
    declared = methods.join(types.select("path", F.col("name").alias("container"), F.col("first").alias("class_at")), ["path", "container"]).groupBy("path", F.col("method").alias("b")).agg(F.min_by(F.struct(method_id.alias("id"), F.concat_ws(".", "container", "method").alias("name")), F.struct("class_at", "first")).alias("same"))
    calls = calls.join(declared, ["path", "b"], "left").withColumns({"source_id": F.when(F.col("method").isNull(), F.coalesce("same.id", "source_id")).otherwise(F.col("source_id")), "source": F.when(F.col("method").isNull(), F.coalesce("same.name", "source")).otherwise(F.col("source"))})
    row = lambda rows, type_, target, semantic, detail: rows.select("path", type_.alias("type"), "source_id", "target_id", "source", target.alias("target"), semantic.alias("semantic"), detail.alias("detail"), "at")
    out = row(calls, F.lit("CALLS"), F.when(F.col("there"), F.col("candidate")).otherwise(F.concat("full", F.lit("@"), "b")), F.lit("service-call"), F.col("b"))

    known = types.select("path", F.col("name").alias("short"), _id(F.col("path"), F.col("last.kind"), F.col("name"), F.col("last.line")).alias("symbol"))

    def named(rows: DataFrame, name: str) -> DataFrame:
        """target_id: the class of the file that a name's last part names, else the dependency of the name as it stands."""
        return meant(rows, name).join(known, ["path", "short"], "left").withColumn("target_id", F.coalesce("symbol", _id(F.lit("dependency"), F.col(name))))

    static = named(placed.where("what = 'static' and method is not null").withColumn("source_id", own_id).withColumn("source", own_name), "a")
    out = out.unionByName(row(static, static_type(F.col("b")), F.col("a"), F.lit("static-call"), F.col("b")))
    params = of("parameter").where(~F.lower("b").isin(BUILT_IN)).select("path", "at", F.col("a").alias("parameter"), "b", "line")
    params = params.join(scopes.select("path", "at", "container", "method"), ["path", "at"]).withColumn("source_id", method_id).withColumn("source", F.concat_ws(".", "container", "method"))
    out = out.unionByName(row(named(params, "b"), F.lit("USES"), F.col("b"), F.lit("parameter-type"), F.col("parameter")))
    signals = placed.where(F.col("what").isin("header", "config", "locale")).withColumns({"source_id": own_id, "source": own_name, "target_id": file_id})
    kind = F.when(F.col("what") == "header", F.lit("request-header")).when(F.col("what") == "locale", F.lit("locale-set")).when(F.contains("a", F.lit("locale")), F.lit("locale-config")).otherwise(F.lit("config-read"))
    detail = F.when(F.col("what") == "locale", F.coalesce("a", F.lit("unknown"))).otherwise(F.col("a"))
    target = F.when(F.col("what") == "locale", F.lit("application-locale")).otherwise(F.col("a"))
    return out.unionByName(row(signals, F.when(F.col("what") == "locale", F.lit("WRITES")).otherwise(F.lit("READS")), target, kind, detail))


def with_relations(nodes: DataFrame, edges: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with the relations as edges, once each, and a dependency node for each name that is no node."""
    lost = relations.join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_anti").groupBy(F.col("target_id").alias("id")).agg(F.min("target").alias("label"))
    more = lost.select("id", F.lit("dependency").alias("kind"), "label", F.lit(None).cast("string").alias("file_path"))
    own = relations.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    links = own.select(_id(*[F.col(c) for c in ("type", "source_id", "target_id", "semantic", "detail")]).alias("id"), "type", "source_id", "target_id", F.col("path").alias("file_path")).distinct()
    return nodes.unionByName(more), edges.unionByName(links)
