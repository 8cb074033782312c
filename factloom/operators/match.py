"""References, calls and candidates of many targets at once.

Fact columns: symbols(id, file, language, kind, name, ...), uses(use_id, file, language, spelling, ref_kind,
containing_symbol, start_byte, end_byte, receiver), bindings(use_id, target_id, resolution).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scalars as S


def first_per_site(uses: DataFrame) -> DataFrame:
    """One row per (file, start, end, ref_kind): that of the smallest use_id."""
    order = Window.partitionBy("file", "start_byte", "end_byte", "ref_kind").orderBy("use_id")
    return uses.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def bound_uses(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """uses with target_id and resolution, both null for unbound ones."""
    return uses.join(bindings, "use_id", "left")


def reference_counts(symbols: DataFrame, uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """id, n_exact, n_scoped, n_name_match, total of every symbol.

    Names fan out to tens of millions of pairs, so unbound uses are counted by key before they meet the symbols, and
    bound ones by target: both sides of either join have one row per key.
    """
    linked = bound_uses(uses, bindings)
    bound = linked.where("target_id IS NOT NULL").groupBy(F.col("target_id").alias("id")).agg(*(F.count_if(F.col("resolution") == r).alias(f"n_{r}") for r in ("exact", "scoped")))
    by_name = linked.where("target_id IS NULL").groupBy("language", "spelling").agg(F.count("*").alias("n"))
    kinds = symbols.select("language", "kind").distinct()
    keyed = by_name.join(F.broadcast(kinds), "language").select("language", "kind", S.match_key(F.col("language"), F.col("kind"), F.col("spelling")).alias("key"), "n").groupBy("language", "kind", "key").agg(F.sum("n").alias("n_name_match"))
    wanted = symbols.select("id", "language", "kind", S.match_key(F.col("language"), F.col("kind"), F.col("name")).alias("key"))
    both = wanted.join(bound, "id", "left").join(keyed, ["language", "kind", "key"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    counts = [zero("n_exact").alias("n_exact"), zero("n_scoped").alias("n_scoped"), zero("n_name_match").alias("n_name_match")]
    return both.select("id", *counts).withColumn("total", F.expr("n_exact + n_scoped + n_name_match"))


def references(symbols: DataFrame, uses: DataFrame, bindings: DataFrame, mode: str = "references", kinds: list[str] | None = None, minimum: str = "name_match") -> DataFrame:
    """One row per target and use: use columns, target (the symbol asked for), resolution, resolved_target.

    mode references: uses bound to the target, and unbound ones of its name. mode candidates: also uses of its name that
    are bound elsewhere, as name_match. Restrict symbols to the targets of interest: names of common symbols fan out.
    Two equality joins, one per branch, never one join on either condition.
    """
    linked = bound_uses(uses, bindings)
    if kinds:
        linked = linked.where(F.col("ref_kind").isin(kinds))
    columns = [F.col(c) for c in uses.columns]
    direct = linked.join(symbols.select(F.col("id").alias("target")), F.col("target_id") == F.col("target")).select(*columns, "target", "resolution", F.col("target_id").alias("resolved_target"))
    free = linked.where("target_id IS NULL") if mode == "references" else linked
    key = S.match_key(F.col("language"), F.col("_kind"), F.col("spelling"))
    wanted = symbols.select(F.col("id").alias("target"), F.col("language"), F.col("kind").alias("_kind"), S.match_key(F.col("language"), F.col("kind"), F.col("name")).alias("_key"))
    keyed = free.join(F.broadcast(wanted.select("language", "_kind").distinct()), "language").withColumn("_key", key)
    named = keyed.join(wanted, ["language", "_kind", "_key"]).where(F.col("target_id").isNull() | (F.col("target_id") != F.col("target")))
    named = named.select(*columns, "target", F.lit("name_match").alias("resolution"), F.col("target_id").alias("resolved_target"))
    return direct.unionByName(named).where(S.at_least(F.col("resolution"), minimum))


def counts_by_resolution(matches: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts per target before any page is cut; targets without matches have zeros."""
    n = matches.groupBy("target").agg(*(F.count_if(F.col("resolution") == r).alias(f"n_{r}") for r in S.RESOLUTIONS), F.count("*").alias("total"))
    out = targets.select(F.col("id").alias("target")).join(n, "target", "left")
    return out.na.fill(0)


def _keyed_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.select("id", F.col("language").alias("_language"), F.col("kind").alias("_kind"), S.match_key(F.col("language"), F.col("kind"), F.col("name")).alias("_key"))


def _by_key(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """uses once per kind of their language, with the key that a symbol of that kind would have."""
    kinds = symbols.select("language", F.col("kind").alias("_kind")).distinct()
    keyed = uses.join(F.broadcast(kinds), "language").withColumn("_key", S.match_key(F.col("language"), F.col("_kind"), F.col("spelling")))
    return keyed.withColumnRenamed("language", "_language")


def candidate_counts(symbols: DataFrame, uses: DataFrame, bindings: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """target, n_exact, n_scoped, n_name_match, total of every symbol in mode candidates, as counts_by_resolution of
    references has them. Uses are counted by key and by target before they meet the symbols; a symbol's own bound uses
    of its name are taken off again."""
    linked = bound_uses(uses, bindings)
    if kinds:
        linked = linked.where(F.col("ref_kind").isin(kinds))
    wanted = _keyed_symbols(symbols)
    named = _by_key(linked.groupBy("language", "spelling").agg(F.count("*").alias("n")), symbols).groupBy("_language", "_kind", "_key").agg(F.sum("n").alias("_named"))
    per_target = linked.where("target_id IS NOT NULL").groupBy("target_id", "language", "spelling", "resolution").agg(F.count("*").alias("n"))
    bound = per_target.join(wanted, F.col("target_id") == F.col("id"))
    same = (F.col("language") == F.col("_language")) & (S.match_key(F.col("_language"), F.col("_kind"), F.col("spelling")) == F.col("_key"))
    own = bound.groupBy("id").agg(*(F.sum(F.when(F.col("resolution") == r, F.col("n"))).alias(f"_{r}") for r in S.RESOLUTIONS), F.sum("n").alias("_bound"), F.sum(F.when(same, F.col("n"))).alias("_same"))
    both = wanted.join(own, "id", "left").join(named, ["_language", "_kind", "_key"], "left").na.fill(0)
    others = F.col("_named") - F.col("_same")
    return both.select(F.col("id").alias("target"), F.col("_exact").alias("n_exact"), F.col("_scoped").alias("n_scoped"), (F.col("_name_match") + others).alias("n_name_match"), (F.col("_bound") + others).alias("total"))


def reference_order() -> list[Column]:
    return [F.col("file"), F.col("start_byte"), F.col("end_byte"), F.col("ref_kind"), F.coalesce("resolved_target", F.lit(""))]


def pages(matches: DataFrame, by: str, order: list, offset: int, limit: int) -> DataFrame:
    """Rows offset..offset+limit of every group, with total and next_offset (null on the last page)."""
    place = Window.partitionBy(by).orderBy(*order)
    total = F.count("*").over(Window.partitionBy(by))
    numbered = matches.withColumn("total", total).withColumn("_n", F.row_number().over(place) - 1)
    cut = numbered.where((F.col("_n") >= offset) & (F.col("_n") < offset + limit)).drop("_n")
    return cut.withColumn("next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit)))


def call_lists(matches: DataFrame, minimum: str = "scoped") -> DataFrame:
    """Per target: calls shown at the minimum tier, and how many weaker ones are hidden."""
    shown = S.at_least(F.col("resolution"), minimum)
    return matches.groupBy("target").agg(F.count_if(shown).alias("shown"), F.count_if(~shown).alias("hidden"))


def contained_uses(symbols: DataFrame, uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """What each symbol uses: container, use_id, ref_kind, resolved_target, resolution."""
    inside = bound_uses(uses, bindings).join(symbols.select(F.col("id").alias("containing_symbol")), "containing_symbol")
    return inside.select(F.col("containing_symbol").alias("container"), "use_id", "ref_kind", F.col("target_id").alias("resolved_target"), F.coalesce("resolution", F.lit("name_match")).alias("resolution"))


def unique_by(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """keys and id of the lookups that have exactly one answer; ambiguity is no answer."""
    return symbols.groupBy(*keys).agg(F.count_distinct("id").alias("_n"), F.min("id").alias("id")).where("_n = 1").drop("_n")


def form_compatible(kind: Column, ref_kind: Column, has_receiver: Column, in_class: Column | None = None) -> Column:
    """Whether a PHP use of this form can name a declaration of this kind at all. in_class: the target's parent is class-like.
    A read of a property may reach a method; kinds and forms that aren't told apart are compatible with all."""
    in_class = F.lit(False) if in_class is None else in_class
    return (
        F.when(ref_kind.isin("unknown", "assignment"), F.lit(True))
        .when(kind == "method", ref_kind.isin("call", "read") & has_receiver)
        .when(kind == "function", ((ref_kind == "call") & ~has_receiver) | (ref_kind == "import"))
        .when(kind == "property", ref_kind.isin("read", "write") & has_receiver)
        .when((kind == "const") & in_class, (ref_kind == "read") & has_receiver)
        .when(kind == "const", ref_kind == "import")
        .when(kind.isin("class", "interface", "enum"), ref_kind.isin("type", "import"))
        .otherwise(F.lit(True))
    )


def exclusion_counts(matches: DataFrame, kind: Column, unrelated: Column) -> DataFrame:
    """Per target the unbound name matches that evidence excludes: by form first, then by an unrelated receiver."""
    open_ = F.col("resolution") == "name_match"
    form = open_ & ~form_compatible(kind, F.col("ref_kind"), F.col("receiver").isNotNull())
    return matches.groupBy("target").agg(F.count_if(form).alias("by_form"), F.count_if(open_ & ~form & unrelated).alias("by_receiver"), F.count_if(~form & ~(open_ & unrelated)).alias("kept"))


def exclusion_counts_of_all(symbols: DataFrame, uses: DataFrame, bindings: DataFrame, unrelated: Column) -> DataFrame:
    """exclusion_counts of the references of every symbol, counted by key and by target before they meet the symbols.
    unrelated may use columns of uses and _kind."""
    linked = bound_uses(uses, bindings)
    names = ["by_form", "by_receiver", "kept"]
    form = ~form_compatible(F.col("_kind"), F.col("ref_kind"), F.col("receiver").isNotNull())
    free = _by_key(linked.where("target_id IS NULL"), symbols).groupBy("_language", "_kind", "_key").agg(F.count_if(form).alias("by_form"), F.count_if(~form & unrelated).alias("by_receiver"), F.count_if(~form & ~unrelated).alias("kept"))
    named = _keyed_symbols(symbols).join(free, ["_language", "_kind", "_key"]).select(F.col("id").alias("target"), *names)
    targets = symbols.select(F.col("id").alias("target"), F.col("kind").alias("_kind"))
    direct = exclusion_counts(linked.join(targets, F.col("target_id") == F.col("target")), F.col("_kind"), unrelated)
    return direct.unionByName(named).groupBy("target").agg(*(F.sum(c).alias(c) for c in names))
