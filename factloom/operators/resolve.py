"""Links from uses to declarations by ordered rules: the first rule with exactly one answer wins.

Rules are functions of Scope, which holds the pre-aggregated lookups (one row per key, so that every rule is a plain
equality join), and return (use_id, target_id, resolution). A visible alias whose target isn't indexed blocks the
fallbacks behind it: outcomes have three values (found, blocked, nothing), never a bare null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import lookup, match

CLASS_KINDS = ("class", "interface", "enum")
TS_TYPE_KINDS = (*CLASS_KINDS, "type_alias")


class Scope:
    """Facts of one language and their unique lookups. symbols need parent_id and lookup_name."""

    def __init__(self, language: str, symbols: DataFrame, uses: DataFrame, imports: DataFrame, files: DataFrame, locals_: DataFrame | None = None) -> None:
        self.locals = None if locals_ is None else locals_.where(F.col("language") == language)
        self.symbols = symbols.where(F.col("language") == language)
        self.uses = uses.where(F.col("language") == language)
        self.imports = imports.where(F.col("language") == language)
        self.files = files.where(F.col("language") == language)
        self.folded = S.ascii_fold(F.col("qualified_name"))

    def unique_classes(self) -> DataFrame:
        return match.unique_by(self.symbols.where(F.col("kind").isin(*CLASS_KINDS)).withColumn("key", self.folded), ["key"]).withColumnRenamed("id", "target_id")

    def unique_functions(self) -> DataFrame:
        return match.unique_by(self.symbols.where("kind = 'function' AND parent_id IS NULL").withColumn("key", self.folded), ["key"]).withColumnRenamed("id", "target_id")

    def unique_members(self) -> DataFrame:
        return match.unique_by(self.symbols.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("class_id"), F.col("kind").alias("member_kind"), F.col("lookup_name").alias("member"), "id"), ["class_id", "member_kind", "member"]).withColumnRenamed("id", "target_id")

    def enclosing_classes(self) -> DataFrame:
        """(containing_symbol, class_id): the nearest class-like symbol, the container itself included."""
        parents = self.symbols.select("id", "kind", "parent_id")
        known = parents.select(F.col("id").alias("containing_symbol"), F.col("id").alias("at"))
        found = None
        for _ in range(4):  # members nest in classes, classes in modules
            here = known.join(parents.withColumnRenamed("id", "at"), "at")
            hit = here.where(F.col("kind").isin(*CLASS_KINDS)).select("containing_symbol", F.col("at").alias("class_id"))
            found = hit if found is None else found.unionByName(hit)
            known = here.where(~F.col("kind").isin(*CLASS_KINDS) & F.col("parent_id").isNotNull()).select("containing_symbol", F.col("parent_id").alias("at"))
        return found


def php_class_names(scope: Scope, names: DataFrame) -> DataFrame:
    """names (file, namespace, spelling) with key, the folded qualified class name that PHP means: a fully qualified name
    as it is, an alias of its first part, else relative to the namespace."""
    first = S.ascii_fold(F.substring_index("spelling", "\\", 1))
    alias = scope.imports.where("kind = 'class'").groupBy("file", "namespace", S.ascii_fold(F.col("alias")).alias("first")).agg(F.count_distinct("target").alias("n_targets"), F.min("target").alias("target"))
    joined = names.withColumn("first", first).join(alias, ["file", "namespace", "first"], "left")
    rest = F.expr("substring(spelling, length(substring_index(spelling, '\\\\', 1)) + 1)")
    relative = F.when(F.col("namespace") == "", F.col("spelling")).otherwise(F.concat("namespace", F.lit("\\"), "spelling"))
    name = (
        F.when(F.col("spelling").startswith("\\"), F.expr("substring(spelling, 2)"))
        .when(F.col("spelling").startswith("namespace\\"), F.concat(F.when(F.col("namespace") == "", "").otherwise(F.concat("namespace", F.lit("\\"))), F.expr("substring(spelling, 11)")))
        .when(F.col("n_targets") == 1, F.concat("target", rest))
        .when(F.col("n_targets") > 1, F.lit(None))
        .otherwise(relative)
    )
    return joined.withColumn("key", S.ascii_fold(name)).drop("first", "n_targets", "target")


def php_imports(scope: Scope) -> DataFrame:
    """Class names in type position, after new, and in use statements."""
    typed = scope.uses.where("ref_kind = 'type'")
    direct = php_class_names(scope, typed.select("use_id", "file", "namespace", "spelling")).join(scope.unique_classes(), "key").select("use_id", "target_id")
    of_import = scope.uses.where("ref_kind = 'import'").join(scope.imports.select("file", "start_byte", "end_byte", F.col("kind").alias("import_kind"), S.ascii_fold(F.col("target")).alias("key")), ["file", "start_byte", "end_byte"])
    classes = of_import.where("import_kind = 'class'").join(scope.unique_classes(), "key").select("use_id", "target_id")
    functions = of_import.where("import_kind = 'function'").join(scope.unique_functions(), "key").select("use_id", "target_id")
    return direct.unionByName(classes).unionByName(functions).withColumn("resolution", F.lit("exact"))


def php_functions(scope: Scope) -> DataFrame:
    """Calls of functions: fully qualified, by alias, in the namespace, then global. A visible alias ends the search, and an
    unindexed PHP file anywhere could declare the nearer name, which ends the global fallback."""
    calls = scope.uses.where("ref_kind = 'call' AND receiver IS NULL").select("use_id", "file", "namespace", "spelling")
    known = scope.unique_functions()
    alias = scope.imports.where("kind = 'function'").groupBy("file", "namespace", S.ascii_fold(F.col("alias")).alias("first")).agg(F.when(F.count_distinct("target") == 1, S.ascii_fold(F.min("target"))).alias("by_alias"), F.lit(True).alias("visible"))
    gaps = scope.files.agg(F.coalesce(F.bool_or(F.col("parse_status") != "ok"), F.lit(False)).alias("gaps"))
    asked = calls.withColumn("first", S.ascii_fold(F.col("spelling"))).join(alias, ["file", "namespace", "first"], "left").crossJoin(F.broadcast(gaps))  # one row
    full = F.col("spelling").startswith("\\")
    plain = ~F.contains("spelling", F.lit("\\"))
    here = S.ascii_fold(F.when(F.col("namespace") == "", F.col("spelling")).otherwise(F.concat("namespace", F.lit("\\"), "spelling")))
    step = F.when(full, F.array(S.ascii_fold(F.expr("substring(spelling, 2)")))).when(F.col("visible"), F.array("by_alias")).when(plain & (F.col("namespace") != "") & ~F.col("gaps"), F.array(here, S.ascii_fold(F.col("spelling")))).otherwise(F.array(here))
    tried = asked.select("use_id", F.posexplode(step).alias("step", "key"))
    declared = scope.symbols.where("kind = 'function'").select(scope.folded.alias("key")).distinct().withColumn("declared", F.lit(True))
    hits = tried.join(declared, "key", "left_semi").join(known, "key", "left")
    first = hits.groupBy("use_id").agg(F.min_by(F.struct("target_id"), "step").alias("t"))
    return first.select("use_id", F.col("t.target_id").alias("target_id"), F.lit("exact").alias("resolution")).where("target_id IS NOT NULL")


def php_receivers(scope: Scope) -> DataFrame:
    """Members of $this, self and static in the enclosing class, and of a class named before ::."""
    member = scope.uses.where("receiver IS NOT NULL AND ref_kind IN ('call', 'read', 'write')")
    bare = F.regexp_replace("spelling", "^[$]", "")
    name = F.when(F.col("ref_kind") == "call", S.ascii_fold(F.col("spelling"))).otherwise(bare)
    keyed = member.withColumn("member", name)
    own = keyed.where("receiver IN ('$this', 'self', 'static')").join(scope.enclosing_classes(), "containing_symbol").select("use_id", "class_id", "ref_kind", "member")
    named = keyed.where("NOT startswith(receiver, '$') AND receiver NOT IN ('self', 'static', 'parent')").select("use_id", "file", "namespace", F.col("receiver").alias("spelling"), "ref_kind", "member")
    named = php_class_names(scope, named).join(scope.unique_classes().withColumnRenamed("target_id", "class_id"), "key").select("use_id", "class_id", "ref_kind", "member")
    kinds = F.when(F.col("ref_kind") == "call", F.array(F.lit("method"))).otherwise(F.array(F.lit("property"), F.lit("const")))
    asked = own.unionByName(named).select("use_id", "class_id", "member", F.explode(kinds).alias("member_kind"))
    members = scope.unique_members().withColumn("member", F.when(F.col("member_kind") == "method", F.col("member")).otherwise(F.regexp_replace("member", "^[$]", "")))
    found = asked.join(members, ["class_id", "member_kind", "member"])
    return found.groupBy("use_id").agg(F.count_distinct("target_id").alias("n"), F.min("target_id").alias("target_id")).where("n = 1").select("use_id", "target_id", F.lit("scoped").alias("resolution"))


def php_typed(scope: Scope) -> DataFrame:
    """Methods and properties of variables with one known class: a typed parameter that nothing else may set, a sole
    `new` before the use in the same block, or a typed property of $this."""
    if scope.locals is None:
        return scope.uses.limit(0).select("use_id", F.lit("").alias("target_id"), F.lit("").alias("resolution"))
    member = scope.uses.where("receiver IS NOT NULL AND ref_kind IN ('call', 'read', 'write') AND containing_symbol IS NOT NULL").select("use_id", "containing_symbol", "receiver", "ref_kind", "spelling", F.col("start_byte").alias("at"))
    facts = scope.locals.where("containing_symbol IS NOT NULL")
    whole = facts.where("how <> 'property'").groupBy("containing_symbol", F.col("variable").alias("receiver")).agg(F.count("*").alias("n"), F.first("how").alias("how"), F.first("type").alias("type"), F.first("start_byte").alias("since"), F.first("block_end").alias("until"), F.first("file").alias("file"), F.first("namespace").alias("namespace"))
    sole = whole.where("n = 1 AND type IS NOT NULL")
    plain = member.join(sole, ["containing_symbol", "receiver"]).where((F.col("how") == "param") | ((F.col("since") < F.col("at")) & (F.col("at") < F.col("until"))))
    fields = facts.where("how = 'property'").groupBy(F.col("containing_symbol").alias("class_of"), F.concat(F.lit("$this->"), F.expr("substring(variable, 2)")).alias("receiver")).agg(F.count("*").alias("n"), F.first("type").alias("type"), F.first("file").alias("file"), F.first("namespace").alias("namespace")).where("n = 1 AND type IS NOT NULL")
    owned = member.join(scope.enclosing_classes().withColumnRenamed("class_id", "class_of"), "containing_symbol").join(fields, ["class_of", "receiver"])
    columns = ["use_id", "ref_kind", F.col("spelling").alias("member_name"), "file", "namespace", F.col("type").alias("spelling")]
    typed = php_class_names(scope, plain.select(*columns).unionByName(owned.select(*columns))).join(scope.unique_classes().withColumnRenamed("target_id", "class_id"), "key")
    name = F.when(F.col("ref_kind") == "call", S.ascii_fold(F.col("member_name"))).otherwise(F.col("member_name"))
    asked = typed.select("use_id", "class_id", name.alias("member"), F.when(F.col("ref_kind") == "call", "method").otherwise("property").alias("member_kind"))
    return asked.join(scope.unique_members(), ["class_id", "member_kind", "member"]).select("use_id", "target_id", F.lit("scoped").alias("resolution"))


def _exports(scope: Scope) -> DataFrame:
    """(path, name, target_id): top-level declarations that have exactly one body under their name."""
    return match.unique_by(scope.symbols.where("parent_id IS NULL").select(F.col("file").alias("path"), "name", "id"), ["path", "name"]).withColumnRenamed("id", "target_id")


def _module_imports(scope: Scope) -> DataFrame:
    """(file, alias, path, name) of imports whose module is exactly one known file."""
    cut = scope.imports.withColumn("specifier", F.substring_index("target", "#", 1)).withColumn("name", F.substring_index("target", "#", -1))
    modules = lookup.resolved_modules(cut.select("file", "specifier").distinct(), scope.files)
    return cut.join(modules, ["file", "specifier"]).select("file", "alias", "path", "name", "start_byte", "end_byte")


def ts_lexical(scope: Scope) -> DataFrame:
    """Imported names and names of the same file's top level; a name that both import and declare is no answer."""
    imported = _module_imports(scope).join(_exports(scope), ["path", "name"])
    at_import = scope.uses.where("ref_kind = 'import'").join(imported.select("file", "start_byte", "end_byte", "target_id"), ["file", "start_byte", "end_byte"]).select("use_id", "target_id")
    plain = scope.uses.where("ref_kind <> 'import' AND receiver IS NULL").select("use_id", "file", F.col("spelling").alias("alias"))
    names = imported.select("file", "alias", "target_id").unionByName(_exports(scope).select(F.col("path").alias("file"), F.col("name").alias("alias"), "target_id"))
    blocked = scope.imports.select("file", "alias").distinct().join(imported.select("file", "alias"), ["file", "alias"], "left_anti")
    one = names.groupBy("file", "alias").agg(F.count_distinct("target_id").alias("n"), F.min("target_id").alias("target_id")).where("n = 1").join(blocked, ["file", "alias"], "left_anti")
    local = plain.join(one, ["file", "alias"]).select("use_id", "target_id")
    return at_import.unionByName(local).withColumn("resolution", F.lit("exact"))


def ts_namespace(scope: Scope) -> DataFrame:
    """Members of a namespace import."""
    spaces = _module_imports(scope).where("name = '*'").select("file", F.col("alias").alias("receiver"), "path")
    asked = scope.uses.where("receiver IS NOT NULL").select("use_id", "file", "receiver", F.col("spelling").alias("name"))
    return asked.join(spaces, ["file", "receiver"]).join(_exports(scope), ["path", "name"]).select("use_id", "target_id", F.lit("exact").alias("resolution"))


def ts_receivers(scope: Scope) -> DataFrame:
    """Own members of this."""
    asked = scope.uses.where("receiver = 'this'").join(scope.enclosing_classes(), "containing_symbol").select("use_id", "class_id", F.col("spelling").alias("member"))
    one = scope.unique_members().groupBy("class_id", "member").agg(F.count("*").alias("n"), F.min("target_id").alias("target_id")).where("n = 1")
    return asked.join(one, ["class_id", "member"]).select("use_id", "target_id", F.lit("scoped").alias("resolution"))


RULES: dict[str, list[Callable[[Scope], DataFrame]]] = {"php": [php_imports, php_functions, php_receivers, php_typed], "typescript": [ts_lexical, ts_namespace, ts_receivers]}


def resolve_links(symbols: DataFrame, uses: DataFrame, imports: DataFrame, files: DataFrame, locals_: DataFrame | None = None) -> DataFrame:
    """bindings(use_id, target_id, resolution, rule). A language's rules see declarations of that language only."""
    found = None
    for language, rules in RULES.items():
        scope = Scope(language, symbols, uses, imports, files, locals_)
        for k, rule in enumerate(rules):
            rows = rule(scope).withColumns({"rank": F.lit(k), "rule": F.lit(rule.__name__)})
            one = rows.withColumn("n", F.count("*").over(Window.partitionBy("use_id"))).where("n = 1").drop("n")
            found = one if found is None else found.unionByName(one)
    best = found.groupBy("use_id").agg(F.min_by(F.struct("target_id", "resolution", "rule"), "rank").alias("b"))
    return best.select("use_id", "b.*")


def supertype_edges(symbols: DataFrame, uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """edges (child, relation, qname, parent) from extends and implements uses, unresolved ones with their spelling."""
    named = uses.where("relation IN ('extends', 'implements')").join(bindings.select("use_id", "target_id"), "use_id", "left")
    names = symbols.select(F.col("id").alias("target_id"), "qualified_name")
    return named.join(names, "target_id", "left").select(F.col("containing_symbol").alias("child"), "relation", F.coalesce("qualified_name", F.regexp_replace("spelling", r"^\\", "")).alias("qname"), F.col("target_id").alias("parent"))
