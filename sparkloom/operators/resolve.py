"""Symbol resolution as joins over facts and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import last_dotted, module_id
from .spans import least_met

_EDGE = ["repo_id", "source_id", "target_id", "type", "file_path", "line"]
#: Bases that never resolve to a superclass.
NO_BASE = ("ABC", "object", "Protocol")


def _first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def symbols(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(repo_id, file_path, local, target_id): what an imported name stands for; modules outside give no row.

    A module is looked up as written, then by suffix, then by its last part; relative
    ones start at the importing file's package. A name that its module does not have
    stands for the module.
    """
    imports = facts.filter("kind = 'import'")
    package = F.split(F.regexp_replace(F.col("id"), r"\.?[^.]*$", ""), r"\.")
    up = F.slice(package, 1, F.greatest(F.lit(0), F.size(package) - F.col("level") + 1))
    relative = F.concat_ws(".", F.array_join(up, "."), F.nullif(F.col("module"), F.lit("")))
    ts = F.col("file_path").rlike(r"\.tsx?$")
    absolute = F.when(ts, module_id(F.col("module"), F.lit("typescript"))).otherwise(F.concat(F.lit("py."), F.col("module")))
    imports = imports.withColumn("want", F.when(F.col("level") > 0, relative).otherwise(absolute))
    imports = imports.select("repo_id", "file_path", "seq", "name", "local", "want", "level", "module", "line", F.col("id").alias("source_id"))
    mods = entities.filter("type = 'module'").select("repo_id", F.col("id").alias("module_id"))
    # Every dotted suffix of a module's id is a key, so that no tier needs a range join.
    parts = F.split("module_id", r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = mods.select("repo_id", "module_id", F.explode(tails).alias("key"))
    exact = imports.join(mods, (imports.repo_id == mods.repo_id) & (imports.want == mods.module_id)).select(imports["*"], "module_id", F.lit(1).alias("tier"))
    plain = imports.filter("level = 0 and not file_path rlike '[.]tsx?$'")
    suffix = plain.join(keys.withColumnRenamed("key", "module"), ["repo_id", "module"]).select(*imports.columns, "module_id", F.lit(2).alias("tier"))
    last = plain.withColumn("_k", last_dotted(F.col("module"))).join(keys.select("repo_id", "module_id", F.col("key").alias("_k")), ["repo_id", "_k"]).select(*imports.columns, "module_id", F.lit(3).alias("tier"))
    found = _first(exact.unionByName(suffix).unionByName(last), ["repo_id", "file_path", "seq"], "tier", "module_id")
    child = entities.select("repo_id", F.col("parent_id").alias("module_id"), "name", F.col("id").alias("child_id"))
    found = found.join(child, ["repo_id", "module_id", "name"], "left")
    found = found.withColumn("target_id", F.coalesce("child_id", "module_id"))
    return _first(found, ["repo_id", "file_path", "local"], F.desc("seq")).select("repo_id", "file_path", "local", "target_id", "source_id", "line", "name")


def imports(found: DataFrame) -> DataFrame:
    """IMPORTS edges; a bare import gives none."""
    rows = found.filter("name is not null")
    return rows.select("repo_id", "source_id", "target_id", F.lit("IMPORTS").alias("type"), "file_path", "line")


def names(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(repo_id, file_path, name, target_id): imported names first, then the last of that name in the file."""
    local = _first(entities, ["repo_id", "file_path", "name"], F.desc("start_line"), F.desc("id")).select("repo_id", "file_path", "name", F.col("id").alias("target_id"), F.lit(2).alias("tier"))
    known = found.select("repo_id", "file_path", F.col("local").alias("name"), "target_id", F.lit(1).alias("tier"))
    return _first(known.unionByName(local), ["repo_id", "file_path", "name"], "tier").drop("tier")


def _typed(facts: DataFrame, kind: str, named: DataFrame, classes: DataFrame, keep_all: bool) -> DataFrame:
    rows = facts.filter(F.col("kind") == kind).select("repo_id", "file_path", "id", "local", "name", "seq").join(named, ["repo_id", "file_path", "name"])
    rows = rows if keep_all else rows.join(classes.select("repo_id", F.col("id").alias("target_id")), ["repo_id", "target_id"], "left_semi")
    return _first(rows, ["repo_id", "id", "local"], F.desc("seq")).select("repo_id", "id", "local", F.col("target_id").alias("class_id"))


def bases(facts: DataFrame, named: DataFrame) -> DataFrame:
    """(repo_id, id, base_id, line, file_path, seq) of bases that resolve."""
    b = facts.filter("kind = 'base'").withColumn("name", F.substring_index("name", ".", 1))
    return b.select("repo_id", "file_path", "id", "name", "line", "seq").join(named, ["repo_id", "file_path", "name"]).select("repo_id", "file_path", "id", "name", F.col("target_id").alias("base_id"), "line", "seq")


def calls(facts: DataFrame, entities: DataFrame, named: DataFrame) -> DataFrame:
    """CALLS edges: six rules, each a join; the first that gives a target counts.

    1 a typed attribute of self, 2 a sibling, 3 a typed variable or else a method name
    that one entity alone has, 4 super, 5 a constructor, 6 a plain name (a class stands
    for its constructor, or itself).
    """
    e = entities.select("repo_id", "id", "type", "parent_id")
    classes = e.filter(F.col("type").isin("class", "interface"))
    methods = _first(entities.filter("type = 'method'"), ["repo_id", "parent_id", "name"], "start_line", "id").select("repo_id", F.col("parent_id").alias("class_id"), "name", F.col("id").alias("method_id"))
    c = facts.filter("kind = 'call'").select("repo_id", "file_path", "seq", "id", "name", "receiver", "on_self", "line")
    c = c.join(e.filter(F.col("type").isin("function", "method", "module")).select("repo_id", "id", "parent_id"), ["repo_id", "id"])
    key = ["repo_id", "file_path", "seq"]
    attrs = _typed(facts, "attr", named, classes, True).select("repo_id", F.col("id").alias("parent_id"), F.col("local").alias("receiver"), "class_id")
    local = _typed(facts, "var", named, classes, False).select("repo_id", "id", F.col("local").alias("receiver"), "class_id")
    supers = _first(bases(facts, named).filter(~F.col("name").isin(*NO_BASE)), ["repo_id", "id"], "seq").select("repo_id", F.col("id").alias("parent_id"), F.col("base_id").alias("class_id"))
    only = entities.filter("type = 'method' and name not in ('__init__', 'constructor')").groupBy("repo_id", "name").agg(F.count("*").alias("n"), F.min("id").alias("method_id")).filter("n = 1").drop("n")

    def hit(rows: DataFrame, rule: int) -> DataFrame:
        return rows.join(methods, ["repo_id", "class_id", "name"]).select(*key, F.col("method_id").alias(f"r{rule}"))

    one = hit(c.filter("on_self and receiver is not null").join(attrs, ["repo_id", "parent_id", "receiver"]), 1)
    two = hit(c.filter("on_self and receiver is null and parent_id is not null").withColumn("class_id", F.col("parent_id")), 2)
    on = c.filter("receiver is not null and not on_self")
    typed = on.join(local, ["repo_id", "id", "receiver"])
    loose = on.join(local, ["repo_id", "id", "receiver"], "left_anti").join(only, ["repo_id", "name"]).select(*key, F.col("method_id").alias("r3"))
    three = hit(typed, 3).unionByName(loose)
    plain_ctor = F.col("name").isin("__init__", "constructor") & ~F.col("on_self") & F.col("receiver").isNull()
    four = hit(c.filter((F.col("receiver") == "super") | plain_ctor).join(supers, ["repo_id", "parent_id"]), 4)
    ctor = methods.filter(F.col("name").isin("__init__", "constructor")).groupBy("repo_id", "class_id").agg(F.min("method_id").alias("ctor"))
    new = c.filter("name = 'constructor' and receiver is not null").join(named.withColumnRenamed("name", "receiver"), ["repo_id", "file_path", "receiver"])
    five = new.join(ctor.withColumnRenamed("class_id", "target_id"), ["repo_id", "target_id"]).select(*key, F.col("ctor").alias("r5"))
    plain = c.filter("receiver is null and not on_self").join(named, ["repo_id", "file_path", "name"])
    plain = plain.join(classes.select("repo_id", F.col("id").alias("target_id"), F.lit(True).alias("is_class")), ["repo_id", "target_id"], "left")
    plain = plain.join(ctor.withColumnRenamed("class_id", "target_id"), ["repo_id", "target_id"], "left")
    six = plain.select(*key, F.when(F.col("is_class"), F.coalesce("ctor", "target_id")).otherwise(F.col("target_id")).alias("r6"))
    out = c
    for rule in (one, two, three, four, five, six):
        out = out.join(rule, key, "left")
    out = out.withColumn("target_id", F.coalesce(*[f"r{i}" for i in range(1, 7)])).filter("target_id is not null")
    out = out.join(e.select("repo_id", F.col("id").alias("target_id")), ["repo_id", "target_id"], "left_semi")
    return _first(out.withColumnRenamed("id", "source_id"), ["repo_id", "source_id", "target_id"], "seq").withColumn("type", F.lit("CALLS")).select(*_EDGE)


def inheritance(facts: DataFrame, entities: DataFrame, named: DataFrame) -> DataFrame:
    """INHERITS edges, and IMPLEMENTS where the base is an interface."""
    kinds = entities.select("repo_id", F.col("id").alias("base_id"), F.col("type").alias("base_type"))
    rows = bases(facts, named).join(kinds, ["repo_id", "base_id"]).filter(F.col("base_type").isin("class", "interface"))
    kind: Column = F.when(F.col("base_type") == "interface", "IMPLEMENTS").otherwise("INHERITS")
    rows = rows.withColumn("type", kind).withColumnRenamed("id", "source_id").withColumnRenamed("base_id", "target_id")
    return _first(rows, ["repo_id", "source_id", "target_id"], "seq").select(*_EDGE)


def instantiates(facts: DataFrame, entities: DataFrame, named: DataFrame) -> DataFrame:
    """INSTANTIATES edges of functions, methods and what of a module is outside its children."""
    e = entities.select("repo_id", "id", "type", "parent_id", "start_line")
    sites = facts.filter("kind = 'site'").select("repo_id", "file_path", "seq", "id", "name", "line").join(e.filter(F.col("type").isin("function", "method", "module")).select("repo_id", "id", "parent_id", "start_line", F.col("type").alias("owner")), ["repo_id", "id"])
    # Sites of Python are counted from the start of their owner, those of TypeScript from that of the file.
    own = F.col("file_path").rlike(r"\.py$")
    sites = sites.withColumn("line", F.when(own, F.col("start_line") + F.col("line")).otherwise(F.col("line")).cast("int"))
    spans = entities.filter("parent_id is not null and type <> 'variable'").select("repo_id", F.col("parent_id").alias("id"), "start_line", "end_line", F.lit(True).alias("in"))
    of_modules = sites.filter("owner = 'module'").select("repo_id", "file_path", "seq", "id", "line")
    inside = least_met(of_modules.select("repo_id", "id", F.col("line").alias("start_line"), F.col("line").alias("end_line")), spans, ["repo_id", "id"], "in").select("repo_id", "id", F.col("start_line").alias("line"))
    inside = of_modules.join(inside, ["repo_id", "id", "line"]).select("repo_id", "file_path", "seq")
    sites = sites.join(inside, ["repo_id", "file_path", "seq"], "left_anti").join(named, ["repo_id", "file_path", "name"])
    sites = sites.join(e.filter(F.col("type").isin("class", "interface")).select("repo_id", F.col("id").alias("target_id")), ["repo_id", "target_id"], "left_semi")
    sites = sites.filter("target_id <> id and not (target_id <=> parent_id)").withColumnRenamed("id", "source_id").withColumn("type", F.lit("INSTANTIATES"))
    return _first(sites, ["repo_id", "source_id", "target_id"], "seq").select(*_EDGE)


def resolve(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """All resolved edges, in the order imports, calls, inheritance, instantiations."""
    found = symbols(facts, entities)
    named = names(found, entities)
    out = imports(found)
    for more in (calls(facts, entities, named), inheritance(facts, entities, named), instantiates(facts, entities, named)):
        out = out.unionByName(more)
    return out
