"""Plans of changes: groups of files, what they depend on, their order, the module most files lie in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words

#: What parts of a path name its group, the first that holds.
PREFIXES = [("email-verification", r"verifyemail|emailverification"), ("auth", "/auth/|authcontroller"), ("google-account", "googleaccount"), ("user", "/user"), ("servers", "/servers/|/models/server"), ("vault", "/vault/|/models/password|credential|private_key|passphrase")]
SUFFIXES = [("routes", "^routes/"), ("controllers", "/http/controllers/"), ("requests", "/http/requests/"), ("services", "/services/"), ("models", "/models/"), ("repositories", "/repositories/|/repository/"), ("migrations", "/migrations/")]


def group_label(path: Column, modules: list[str]) -> Column:
    """The planning group of a path: what it is about and what kind of file it is, else the first module that it names, else its first three parts."""
    low = F.lower(path)
    module = F.coalesce(*[F.when(F.contains(low, F.lit(m.lower())), F.lit(m)) for m in modules], F.lit(None).cast("string"))
    both = (F.contains(low, F.lit("server")) & F.contains(low, F.lit("credential"))) | (F.contains(low, F.lit("forwarding")) & F.contains(low, F.lit("port")))
    about = F.coalesce(*[F.when(low.rlike(p) | both if name == "servers" else low.rlike(p), F.lit(name)) for name, p in PREFIXES], F.when(words.is_config(low), "config"), F.when(words.is_localization(low), "localization"), module)
    kind = F.coalesce(*[F.when(low.rlike(p), F.lit(name)) for name, p in SUFFIXES], F.when(words.is_config(low), "config"), F.when(words.is_localization(low), "localization"), F.when(F.contains(low, F.lit("/enums/")), "enums"))
    named = F.when(kind.isNotNull(), F.when(about.isNotNull(), F.concat_ws("-", about, kind)).otherwise(kind))
    return F.coalesce(named, module, words.planning_label(path))


def groups(files: DataFrame, label: Column) -> DataFrame:
    """(label, files sorted, n) of the distinct paths of ``files``; for the files of one plan."""
    return files.select(label.alias("label"), "path").distinct().groupBy("label").agg(F.array_sort(F.collect_list("path")).alias("files"), F.count("*").alias("n"))


def chains(dependencies: DataFrame, labels: DataFrame) -> DataFrame:
    """(from_label, to_label, path, needs): of each pair of groups one dependency (path, needs) of a file on another, that of shortest names, then the least."""
    a = labels.select("path", F.col("label").alias("from_label"))
    b = labels.select(F.col("path").alias("needs"), F.col("label").alias("to_label"))
    met = dependencies.select("path", "needs").join(a, "path").join(b, "needs").where("from_label <> to_label")
    least = F.min(F.struct((F.length("path") + F.length("needs")).alias("n"), "path", "needs")).alias("m")
    return met.groupBy("from_label", "to_label").agg(least).select("from_label", "to_label", "m.path", "m.needs")


def group_order(grouped: DataFrame, chained: DataFrame) -> DataFrame:
    """Groups (label, n) in the order to do them: those that fewest depend on, then the largest, then by label; with ``needed_by``."""
    into = chained.groupBy(F.col("to_label").alias("label")).agg(F.count("*").alias("needed_by"))
    return grouped.join(into, "label", "left").withColumn("needed_by", F.coalesce("needed_by", F.lit(0))).orderBy("needed_by", F.col("n").desc(), "label")


def prefers_hybrid(profile: Column, n_groups: Column, n_files: Column, n_risks: Column, n_chains: Column) -> Column:
    """Whether groups may be worked on side by side: several of them, one risk at most, few chains, and a profile that follows entry points."""
    inventory = profile.isin("storage-topology", "config-inventory", "localization-inventory", "broad-scan")
    return ~inventory & (n_groups > 1) & (n_files > 1) & (n_risks < 2) & (n_chains < F.greatest(n_files - 1, F.lit(2)))


def dominant_module(files: DataFrame, key: str = "plan", share: float = 0.6) -> DataFrame:
    """(key, module) of files (key, path): the deepest folder, layout folders aside, of the deepest prefix that ``share`` of a key's rows lie in, else the folder that most rows have.

    Of prefixes of one depth the least wins, of folders the more frequent, then the
    least; 'none' where no folder is left.
    """
    own = files.select(key, words.folders(F.col("path")).alias("f"))
    total = own.groupBy(key).agg(F.ceil(share * F.count("*")).alias("need"))
    prefix = F.transform(F.sequence(F.lit(1), F.size("f")), lambda n: F.slice("f", F.lit(1), n))
    counted = own.where(F.size("f") > 0).select(key, F.explode(prefix).alias("p")).groupBy(key, "p").agg(F.count("*").alias("n")).join(total, key)
    deepest = counted.where("n >= need").groupBy(key).agg(F.min_by("p", F.struct((-F.size("p")).alias("d"), "p")).alias("p"))
    plain = lambda a: F.filter(a, lambda x: ~F.lower(x).isin(words.LAYOUT_FOLDERS))
    inner = deepest.select(key, F.try_element_at(plain(F.col("p")), F.lit(-1)).alias("inner"))
    often = own.select(key, F.explode(F.array_distinct(plain(F.col("f")))).alias("s")).groupBy(key, "s").agg(F.count("*").alias("n"))
    often = often.groupBy(key).agg(F.min_by("s", F.struct((-F.col("n")).alias("n"), "s")).alias("often"))
    return total.select(key).join(inner, key, "left").join(often, key, "left").select(key, F.coalesce("inner", "often", F.lit("none")).alias("module"))
